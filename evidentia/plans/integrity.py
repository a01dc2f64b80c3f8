"""Queries on references between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.references import orphan_references, orphan_report, parent_states, reference_states
from evidentia.sources.tables import load

#: referring table, its key, referring field, parent table, parent key, parent's deletion mark
LINKS = [
    ("candidate_record", "candidate_id", "text_version_id", "text_version", "text_version_id", "deleted_at"),
    ("candidate_record", "candidate_id", "region_id", "ocr_region", "region_id", "deleted_at"),
    ("event_participant", "event_participant_id", "mention_id", "mention_queue", "mention_id", "deleted_at"),
]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for table, key, field, parent, parent_key, deleted in LINKS:
        parents = load(spark, folder, parent)
        found = orphan_references(
            reference_states(load(spark, folder, table), key, field),
            parent_states(parents, parent_key, deleted),
            parents.count(),
        )
        parts.append(
            found.select(
                F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), "record_id", "cause",
                F.date_format("created_at", "yyyy-MM").alias("period"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(p2_found(spark, folder))


def _found_sql() -> str:
    parts = []
    for table, key, field, parent, parent_key, deleted in LINKS:
        parts.append(f"""
        SELECT '{table}' AS table_name, '{field}' AS field_name, r.k AS record_id,
               CASE WHEN p.k IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' ELSE 'late' END AS cause,
               strftime(r.created_at, '%Y-%m') AS period
        FROM (SELECT {key} AS k, lower(arg_max({field}, ingested_at)) AS ref, arg_max(created_at, ingested_at) AS created_at,
                     min(ingested_at) AS first_at, max_by({field} IS NULL, ingested_at) AS noref
              FROM {table} GROUP BY 1) r
        LEFT JOIN (SELECT lower({parent_key}) AS k, max_by({deleted} IS NOT NULL, ingested_at) AS gone,
                          min(ingested_at) AS first_at
                   FROM {parent} GROUP BY 1) p ON p.k = r.ref
        WHERE NOT r.noref AND (p.k IS NULL OR p.gone OR p.first_at > r.first_at)""")
    return " UNION ALL ".join(parts)


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
ORACLE = {
    "p2_found": _found_sql(),
    "p2_report": f"SELECT table_name, field_name, cause, period, count(*) AS misses FROM ({_found_sql()}) GROUP BY ALL",
}
