"""Selections, pair statistics and graph steps that are compositions of built-in operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import cut


def overlaps(start: str, end: str, low: int, high: int) -> Column:
    """Whether the closed interval of two columns overlaps ``[low, high]``; null ends do not."""
    return (F.col(start) <= high) & (F.col(end) >= low)


def first_of(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """Per key the columns of the row that is first in ``order``, as an aggregate that combines before the
    shuffle instead of a window. Nulls in the order come first."""
    value = F.min(F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)], F.struct(*columns).alias("_row")))
    picked = df.groupBy(*keys).agg(value.alias("_first"))
    return picked.select(*keys, *[F.col("_first._row")[c].alias(c) for c in columns])


def ready(items: DataFrame, parent: str, unfinished: DataFrame) -> DataFrame:
    """Items whose parent is not unfinished; items without a parent are ready."""
    return items.join(unfinished.distinct(), parent, "left_anti")


def missing_numbers(df: DataFrame, first: int, last: int) -> DataFrame:
    """Numbers of a sequence that the (only) column of ``df`` does not have."""
    name = df.columns[0]
    wanted = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(name))
    return wanted.join(df.distinct(), name, "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree``: distinct neighbours in either direction; self-loops count as a neighbour."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    return both.where("src IS NOT NULL AND dst IS NOT NULL").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def pairwise_jaccard(items: DataFrame, run: str, keys: list[str]) -> DataFrame:
    """``left_run, right_run, agreed, jaccard`` of every pair of runs; pairs that share nothing stay.

    ``items`` has few runs and many keys: the runs of a key are collected (at most one entry per
    run), so the keys are shuffled once and never joined with themselves.
    """
    distinct = items.select(run, *keys).distinct()
    sets = distinct.groupBy(*keys).agg(F.array_sort(F.collect_set(run)).alias("runs"))
    sizes = sets.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    pair = F.flatten(F.transform("runs", lambda a: F.transform(F.filter("runs", lambda b: b > a), lambda b: F.struct(a.alias("left_run"), b.alias("right_run")))))
    shared = sets.select(F.explode(pair).alias("p")).groupBy("p").agg(F.count("*").alias("agreed")).select("p.*", "agreed")
    left = sizes.select(F.col("run").alias("left_run"), F.col("n").alias("left_n"))
    right = sizes.select(F.col("run").alias("right_run"), F.col("n").alias("right_n"))
    agreed = F.coalesce("agreed", F.lit(0))
    union = F.col("left_n") + F.col("right_n") - agreed
    return left.join(right, F.col("left_run") < F.col("right_run")).join(shared, ["left_run", "right_run"], "left").select(
        "left_run", "right_run", agreed.alias("agreed"), F.when(union == 0, 1.0).otherwise(F.round(agreed / union, 6)).alias("jaccard")
    )


def follow(edges: DataFrame) -> DataFrame:
    """``src, end, hops`` of chains ``src -> dst``: where each chain ends and after how many steps.

    The reach doubles in every round until it exceeds the number of vertices with a way, so a chain
    of n steps takes log n rounds and only what runs into a cycle stays open. A vertex with
    several ways goes the one with the smallest end; chains that run into a cycle have no row.
    Self-loops and null ends are dropped.
    """
    steps = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()
    reach = cut(steps.groupBy("src").agg(F.min("dst").alias("end")).withColumn("hops", F.lit(1).cast("bigint")))
    starts, most, reached = reach.select(F.col("src").alias("_s")), reach.count(), 1
    while reached <= most:
        onward = reach.select(F.col("src").alias("_s"), F.col("end").alias("_end"), F.col("hops").alias("_hops"))
        open_ends = reach.join(starts, reach["end"] == starts["_s"], "left_semi")
        if open_ends.isEmpty():
            break
        reach = cut(
            reach.join(onward, reach["end"] == onward["_s"], "left").select(
                "src", F.coalesce("_end", "end").alias("end"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).cast("bigint").alias("hops")
            )
        )
        reached *= 2
    # what is still open runs into a cycle; its steps, which may exceed an int, are dropped with it
    return reach.join(starts, reach["end"] == starts["_s"], "left_anti").withColumn("hops", F.col("hops").cast("int"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """``node`` of all vertices whose chain of first ways never ends."""
    nodes = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src").distinct()
    return nodes.join(follow(edges).select("src"), "src", "left_anti").select(F.col("src").alias("node"))


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """Of each group ``count`` evenly spaced rows, both ends included; all of a group that has no more.
    Places that fall together by rounding are filled up by the next rows in order, so a group never
    gives fewer than it could."""
    per = Window.partitionBy(*keys)
    rows = df.withColumns({"_i": F.row_number().over(per.orderBy(*order)), "_n": F.count("*").over(per)})
    steps = max(1, count - 1)
    places = F.transform(F.array(*map(F.lit, range(count))), lambda k: F.bround(k * (F.col("_n") - 1) / float(steps)).cast("int") + 1)
    rows = rows.withColumn("_hit", F.array_contains(places, F.col("_i")))
    hits = F.count_if("_hit").over(per)
    spare = F.row_number().over(Window.partitionBy(*keys, "_hit").orderBy("_i"))
    return rows.withColumns({"_hits": hits, "_spare": spare}).where((F.col("_n") <= count) | F.col("_hit") | (F.col("_spare") <= count - F.col("_hits"))).drop("_i", "_n", "_hit", "_hits", "_spare")


def quota(df: DataFrame, key: str, reasons: str, order: str, most: int, total: int) -> DataFrame:
    """``key, reason``: of each reason in the array ``reasons`` the first ``most`` rows by ``order``; a row
    that is drawn for several reasons has the smallest. Up to ``total`` further rows (reason ``fill``)
    make up what is lacking. Both bounds are small, so only they are ordered in one task."""
    spread = df.select(key, order, F.explode(reasons).alias("reason"))
    drawn = spread.withColumn("_k", F.row_number().over(Window.partitionBy("reason").orderBy(order, key))).where(F.col("_k") <= most)
    chosen = cut(drawn.groupBy(key).agg(F.min("reason").alias("reason")))
    lacking = max(0, total - chosen.count())
    rest = df.select(key, order).distinct().join(chosen, key, "left_anti").orderBy(order, key).limit(lacking)
    return chosen.unionByName(rest.select(key, F.lit("fill").alias("reason")))
