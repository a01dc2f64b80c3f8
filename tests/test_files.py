import pytest
from pyspark.sql import functions as F

from evidentia.operators import spans
from evidentia.sources import files, sinks
from evidentia.streaming import logs


def test_xref_and_djvu():
    table = b"xref\n0 3\n0000000000 65535 f \n0000000017 00000 n \n0000000042 00000 n \ntrailer << /Root 2 0 R >>"
    assert files.classic_xref(table) == ({1: 17, 2: 42}, 2)
    assert files.page_count(b"AT&TFORM\0\0\0\0DJVMDIRM\0\0\0\x10\x81\x03\x49") == 841
    assert files.page_count(b"nothing") is None


def test_json_lines_are_strict(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2, "b": 3}\n')
    assert files.read_jsonl(spark, str(tmp_path), "a int").count() == 2
    raw = spark.read.text(str(tmp_path))
    assert sorted(r[0] for r in raw.select(files.unknown_keys("value", ["a"])).collect()) == [[], ["b"]]
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path), "a int").collect()


def test_versions_and_pointer(spark, tmp_path):
    root = str(tmp_path / "t")
    first = sinks.publish(spark.range(3), root)
    second = sinks.publish(spark.range(5), root, expected=first, rows=5)
    assert sinks.current_version(spark, root).count() == 5
    with pytest.raises(ValueError):
        sinks.publish(spark.range(7), root, expected=first)
    assert sinks.current_version(spark, root).count() == 5
    sinks.restore(spark, root, first)
    assert sinks.current_version(spark, root).count() == 3 and second != first


def test_citation_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "r1", "富紳"), ("p", 2, "r2", "淑女")], "page_id string, o int, region_id string, t string")
    placed, pages = spans.running_offsets(df, "page_id", ["o"], "t"), spans.assemble(df, "page_id", ["o"], "t")
    sinks.export_citations(placed, pages, str(tmp_path))
    assert sinks.invalid_citations(spark, str(tmp_path)).count() == 0
    sinks.export_citations(placed.withColumn("start", F.col("start") + 1), pages, str(tmp_path))
    assert sinks.invalid_citations(spark, str(tmp_path)).count() == 2


def test_binary_files(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\nendobj\n%%EOF")
    (tmp_path / "y.pdf").write_bytes(b"%PDF-1.4 cut")
    found = files.binary_files(spark, str(tmp_path), "*.pdf").select(files.signature_status("content").alias("s"), files.pages_of("content").alias("n")).collect()
    assert sorted(r.s for r in found) == ["pdf", "truncated"] and {r.n for r in found} == {None}


def test_stream_equals_batch(spark, folder, tmp_path):
    from evidentia.operators.timeline import latest_states

    events = spark.read.parquet(f"{folder}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    log = logs.read_log(spark, str(tmp_path / "in"), files=1)
    states = logs.latest_states(log)
    query = states.writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = spark.sql("SELECT user_id, max_by(last_type, last_event) AS t, count(*) AS n FROM states GROUP BY user_id")
    assert streamed.count() == events.select("user_id").distinct().count()
    batch = {r.user_id: r.last_event for r in latest_states(events, "user_id", "2024-01-31 00:00:00", 86_400).collect()}
    emitted = {(r.user_id, r.last_event) for r in spark.sql("SELECT user_id, last_event FROM states").collect()}
    assert all((u, e) in emitted for u, e in batch.items())
    logs.run_available(logs.deduplicated(log, late="60 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("event_id").distinct().count()


def test_readers_of_other_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,t\n1,x\n2,\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), "k int, t string").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "b.csv").write_text("k,other\n1,x\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "b.csv"), "k int, t string").collect()
    (tmp_path / "run.json").write_text('{\n "run": {"id": "r"},\n "pages": [{"n": 1},\n {"n": 2}]\n}')
    artifact = files.read_artifacts(spark, str(tmp_path / "run.json"), "run struct<id:string>, pages array<struct<n:int>>")
    assert [tuple(r) for r in artifact.select("run.id", F.explode("pages.n")).collect()] == [("r", 1), ("r", 2)]
    assert [tuple(r) for r in files.parameters(spark, a=["x", "y"], b=[1, 2]).collect()] == [("x", 1), ("y", 2)]
    assert files.parameters(spark, a=[]).count() == 0
    with pytest.raises(ValueError):
        files.parameters(spark, a=["x"], b=[])


def test_database_scan_is_partitioned(spark):
    url = "jdbc:derby:memory:evidentia;create=true"
    spark.range(100).withColumnRenamed("id", "K").coalesce(1).write.jdbc(url, "T", mode="overwrite", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    df = files.read_jdbc(spark, url, "T", "K", 0, 100, 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert df.rdd.getNumPartitions() == 4 and sorted(r[0] for r in df.collect()) == list(range(100))


def test_graph_rebuild(spark, tmp_path):
    vertices = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "z")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "e"), ("a", "b", "e"), ("a", "gone", "e")], "src string, dst string, label string")
    sinks.publish_graph(vertices, edges, str(tmp_path))
    assert sinks.current_version(spark, f"{tmp_path}/vertices").count() == 2 and [tuple(r) for r in sinks.current_version(spark, f"{tmp_path}/edges").collect()] == [("a", "b", "e")]
