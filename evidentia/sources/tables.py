"""Parquet tables of the archive and the rule that turns deliveries into records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; a file or a directory of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current(df: DataFrame, key: str, *columns: str, extra: list[Column] | None = None) -> DataFrame:
    """The state of every record: per ``key`` the ``columns`` of the row that arrived last.

    Rows with a null key are dropped. Rows that arrived at the same instant are ordered by a digest
    of their values, so the choice does not depend on the partitioning. ``extra`` are more
    aggregates, such as the first arrival. Only ``columns`` are scanned; the aggregate combines
    before the shuffle (sorted by key, as its value is a struct), so a record that was delivered
    very often sends one row per task.
    """
    state = F.max_by(F.struct(*columns), F.struct("ingested_at", F.xxhash64(*columns))).alias("_state")
    grouped = df.where(F.col(key).isNotNull()).groupBy(key).agg(state, *(extra or []))
    names = [c for c in grouped.columns if c not in (key, "_state")]
    return grouped.select(key, *[F.col("_state")[c].alias(c) for c in columns], *names)
