"""Writes without row locks: upserts, histories and checks, each as a new version of a table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_delivery(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per record the columns of its earliest row."""
    value = F.min_by(F.struct(*columns), F.struct("ingested_at", *columns))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(value.alias("_v")).select(key, *[F.col("_v")[c].alias(c) for c in columns])


def upsert(old: DataFrame, new: DataFrame, key: str, rules: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """New version of ``old``: rows of one side stay, rows of both follow the rule of each column
    (a function of the old and the new value). Both sides have unique keys."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    gone, fresh = F.col(f"b.{key}").isNull(), F.col(f"a.{key}").isNull()
    columns = [F.when(gone, F.col(f"a.{c}")).when(fresh, F.col(f"b.{c}")).otherwise(rule(F.col(f"a.{c}"), F.col(f"b.{c}"))).alias(c) for c, rule in rules.items()]
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *columns)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with those rows of ``new`` whose key it does not have."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def drifted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that both sides have with different values: the read-back check of an idempotent insert."""
    common = new.join(old.select(key), key, "left_semi")
    return common.select(old.columns).exceptAll(old).select(key).distinct()


def history(rows: DataFrame, key: str, columns: list[str], at: str) -> DataFrame:
    """``key, columns, valid_from, valid_to``: an interval for every change of the columns in the
    order of ``at``; repeated deliveries of the same values do not open a new one."""
    order = Window.partitionBy(key).orderBy(at)
    value = F.struct(*columns)
    changed = rows.select(key, *columns, at).withColumn("_before", F.lag(value).over(order)).where(F.col("_before").isNull() | (F.col("_before") != value))
    return changed.select(key, *columns, F.col(at).alias("valid_from"), F.lead(at).over(order).alias("valid_to"))


def activate(open_rows: DataFrame, selected: DataFrame, key: str, at: Column) -> DataFrame:
    """Supersede-then-insert: the open row of each selected key is closed at ``at`` and the
    selected one becomes the open row. Both sides have ``key``, ``selected_at``, ``superseded_at``."""
    hit = selected.select(F.col(key).alias("_k"))
    closed = open_rows.join(hit, open_rows[key] == hit["_k"], "left").withColumn(
        "superseded_at", F.when(F.col("_k").isNotNull() & F.col("superseded_at").isNull(), at).otherwise(F.col("superseded_at"))
    ).drop("_k")
    return closed.unionByName(selected.withColumn("selected_at", at).withColumn("superseded_at", F.lit(None).cast("timestamp")), allowMissingColumns=True)


def check_rows(tables: dict[str, DataFrame], checks: dict[str, tuple[str, str]]) -> DataFrame:
    """``check_name, table_name, violations, n`` of named predicates that hold for bad rows."""
    parts = []
    for table, df in tables.items():
        own = {name: predicate for name, (t, predicate) in checks.items() if t == table}
        counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.expr(p)).alias(name) for name, p in own.items()])
        rows = F.explode(F.array(*[F.struct(F.lit(name).alias("check_name"), F.col(name).alias("violations")) for name in own]))
        parts.append(counts.select(rows.alias("c"), "n").select("c.check_name", F.lit(table).alias("table_name"), "c.violations", "n"))
    return reduce(DataFrame.unionByName, parts)


def insert_absent_where(old: DataFrame, new: DataFrame, keys: list[str], applies: Column, order: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` that do not conflict with it or each other under a partial
    unique index: of rows for which ``applies`` only the first in ``order`` per key is taken, and only
    if ``old`` has no such row of that key. Rows outside the index are all taken. A null key conflicts
    with nothing."""
    indexed = F.coalesce(applies, F.lit(False))
    for key in keys:
        indexed = indexed & F.col(key).isNotNull()
    first = F.row_number().over(Window.partitionBy("_in", *keys).orderBy(*order))
    marked = new.withColumn("_in", indexed)
    taken = marked.where("_in").withColumn("_k", first).where("_k = 1").drop("_k", "_in").join(old.where(indexed).select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(taken.select(old.columns)).unionByName(marked.where("NOT _in").drop("_in").select(old.columns))


def coverage(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are ``wanted`` and ``present``, ``missing`` and ``unexpected``, and whether
    both are the same set. Each side is shuffled once; nulls are left out."""
    both = wanted.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(present.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).where(F.col(key).isNotNull())
    per = both.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counts = per.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("wanted", F.col("a")), ("present", F.col("b")), ("missing", F.col("a") * (1 - F.col("b"))), ("unexpected", F.col("b") * (1 - F.col("a"))))])
    return counts.withColumn("covered", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def partition_check(members: DataFrame, assigned: DataFrame, member: str, cluster: str) -> DataFrame:
    """One row: of the distinct ``members`` how many are in no cluster of ``assigned``, in exactly one
    (``once``) or in ``several``."""
    per = assigned.groupBy(member).agg(F.countDistinct(cluster).alias("n"))
    both = members.select(member).distinct().join(per, member, "left")
    return both.agg(F.count("*").alias("members"), F.count_if(F.col("n").isNull()).alias("unassigned"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("several"))
