import duckdb
import pytest

import __spark_entry__ as entry
from evidentia.plans import archive, evaluation, graphs, integrity, relational, spans, texts

CORE = [integrity, relational, texts, graphs, spans, evaluation, archive]


def normal(rows):
    def cell(v):
        if v is None or v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


@pytest.fixture(scope="session")
def database(folder):
    import os

    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        connection.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return connection


@pytest.mark.parametrize("name", [n for m in CORE for n in m.ORACLE])
def test_query_equals_sql(spark, folder, database, name):
    module = next(m for m in CORE if name in m.QUERIES)
    df = module.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    expected = database.execute(module.ORACLE[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert normal(df.select(*[f"`{c}`" for c in columns]).collect()) == normal([[r[i] for i in order] for r in expected.fetchall()])


def test_entry_works_without_the_optional_subpackage(spark):
    assert {n for m in CORE for n in m.QUERIES} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["table_name", "field_name", "cause", "period", "misses"]


@pytest.mark.parametrize("partitions", [1, 17])
def test_results_do_not_depend_on_partitions(spark, folder, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    names = ["p2_report", "pairwise_agreement", "rank_fusion", "bootstrap_interval"]
    usual = {n: normal(entry.queries()[n](spark, folder).collect()) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert {n: normal(entry.queries()[n](spark, folder).collect()) for n in names} == usual
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_plans_have_no_cartesian_product(spark, folder):
    for name in ("theme_leads", "reverse_evidence", "region_projection", "star_revenue"):
        plan = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = entry.queries()["genres_since"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(publication_year), GreaterThanOrEqual(publication_year,1910)]" in plan


def test_states_read_only_what_is_asked(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = entry.queries()["status_pivot"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert sorted(part.split(":")[0] for part in schema.split(",")) == ["deleted_at", "entity_type", "ingested_at", "mention_id", "mention_status"]
