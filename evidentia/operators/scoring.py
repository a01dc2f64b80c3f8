"""Scores of predictions, agreement and uncertainty."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def prf(tp: str, predicted: str, expected: str) -> list[Column]:
    """Precision, recall and F1 as reports have them: 0 for an empty denominator, but 1 where
    nothing was predicted and nothing expected."""
    nothing = (F.col(predicted) == 0) & (F.col(expected) == 0)
    p = F.when(nothing, 1.0).otherwise(ratio(F.col(tp), F.col(predicted)))
    r = F.when(nothing, 1.0).otherwise(ratio(F.col(tp), F.col(expected)))
    f = F.when(nothing, 1.0).otherwise(ratio(2 * F.col(tp), F.col(predicted) + F.col(expected)))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1")]


def decade(year: str) -> Column:
    return F.coalesce(F.concat((F.floor(F.col(year) / 10) * 10).cast("string"), F.lit("s")), F.lit("unknown"))


def bootstrap_sums(clusters: DataFrame, cluster: str, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """``replicate`` and the sums of ``columns`` over clusters drawn with replacement.

    ``clusters`` has one row per cluster. Draws are digests of seed, replicate and position, so
    they do not depend on the partitioning; every draw joins the cluster of that number. All columns
    of a replicate come from the same draws, which makes comparisons of them paired.
    """
    numbered = clusters.withColumn("_i", F.row_number().over(Window.orderBy(cluster)) - 1)
    n = clusters.agg(F.count("*").alias("n"))
    draws = clusters.sparkSession.range(replicates).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(n)).select("replicate", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    digest = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "replicate", "k"), 256), 1, 7), 16, 10).cast("bigint")
    drawn = draws.select("replicate", (digest % F.col("n")).alias("_i"))
    return drawn.join(numbered, "_i").groupBy("replicate").agg(*[F.sum(c).alias(c) for c in columns])


def cluster_bootstrap(clusters: DataFrame, cluster: str, hit: str, total: str, replicates: int, seed: int) -> DataFrame:
    """``replicate, score``: the ratio of two sums over drawn clusters; 1 for an empty denominator."""
    sums = bootstrap_sums(clusters, cluster, [hit, total], replicates, seed)
    return sums.select("replicate", F.round(ratio(F.col(hit), F.col(total), 1.0), 9).alias("score"))


def retrieval_report(questions: list[str], search: Callable[[str], DataFrame], about: DataFrame, key: str, expected: DataFrame, place: str, rates: list[str]) -> DataFrame:
    """Evaluation of a search: a row per question and one called ``all``.

    ``search`` gives ``question, key, hit`` of a question, ``about`` has for each ``key`` the places it
    may stand for (a hit with several sources takes as many ranks) and the flags ``rates``, and
    ``expected`` has ``question, place``. A question without hits has rates of 1, one whose places are
    not found a reciprocal rank of 0. The row ``all`` has the means of recall and reciprocal rank over
    questions with an expectation, and the rates weighted by hits.
    """
    hits = reduce(DataFrame.unionByName, [search(q) for q in questions])
    spread = hits.join(about, key).withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("hit", place)))
    wanted = expected.select("question", place).distinct().withColumn("_wanted", F.lit(1))
    judged = spread.join(wanted, ["question", place], "left")
    found = judged.groupBy("question").agg(
        F.countDistinct(F.when(F.col("_wanted") == 1, F.col(place))).alias("found"), F.min(F.when(F.col("_wanted") == 1, F.col("rank"))).alias("first"), F.countDistinct(key).alias("hits")
    )
    flags = judged.groupBy("question", key).agg(*[F.bool_and(r).alias(r) for r in rates]).groupBy("question").agg(*[F.count_if(r).alias(r) for r in rates])
    per = wanted.groupBy("question").agg(F.count("*").alias("expected")).join(found, "question", "left").join(flags, "question", "left").fillna(0, ["found", "hits", *rates])
    rank = F.coalesce(1.0 / F.col("first"), F.lit(0.0))
    each = per.select("question", F.round(F.col("found") / F.col("expected"), 6).alias("recall"), F.round(rank, 6).alias("reciprocal_rank"), "hits", *[F.round(ratio(F.col(r), F.col("hits"), 1.0), 6).alias(f"{r}_rate") for r in rates])
    whole = per.agg(F.round(F.avg(F.col("found") / F.col("expected")), 6).alias("recall"), F.round(F.avg(rank), 6).alias("reciprocal_rank"), F.sum("hits").alias("hits"), *[F.round(ratio(F.sum(r), F.sum("hits"), 1.0), 6).alias(f"{r}_rate") for r in rates])
    return each.unionByName(whole.select(F.lit("all").alias("question"), "*"))
