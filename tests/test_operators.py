import datetime as dt
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import ids, text
from evidentia.operators import matching, merges, retrieval, scoring, selection, spans, timeline
from evidentia.operators.references import orphan_references, parent_states, reference_states

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_orphans_by_cause(spark):
    schema = "id string, deleted_at timestamp, ingested_at timestamp"
    parents = spark.createDataFrame([("a", None, DAY), ("b", None, DAY), ("b", DAY, DAY + dt.timedelta(days=9)), ("c", None, DAY + dt.timedelta(days=5)), (None, None, DAY)], schema)
    schema = "k string, ref string, created_at timestamp, ingested_at timestamp, extra int"
    at = DAY + dt.timedelta(days=1)
    children = spark.createDataFrame([("1", "A", at, at, 0), ("2", "b", at, at, 0), ("3", "C", at, at, 0), ("4", "x", at, at, 0), ("5", None, at, at, 0), ("6", "zz", at, at, 1), ("6", "a", at, at + dt.timedelta(days=1), 1), ("7", "", None, at, 1)], schema)
    found = orphan_references(reference_states(children, "k", "ref"), parent_states(parents, "id"), parents.count())
    assert rows(found.select("record_id", "cause")) == [("2", "deleted"), ("3", "late"), ("4", "missing"), ("7", "missing")]
    empty = orphan_references(reference_states(children, "k", "ref"), parent_states(parents.limit(0), "id"), 0)
    assert empty.count() == 6
    assert orphan_references(reference_states(children.limit(0), "k", "ref"), parent_states(parents, "id"), 5).count() == 0


def test_orphans_hot_parent_in_many_ranges(spark, monkeypatch):
    from evidentia.operators import references

    monkeypatch.setattr(references, "RANGE_KEYS", 7)
    monkeypatch.setattr(references, "PROBE_ROWS", 5)
    parents = spark.range(100).select(F.concat(F.lit("k"), "id").alias("id"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(DAY).alias("ingested_at"))
    children = spark.range(300).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") < 200, "K7").otherwise(F.concat(F.lit("k"), F.col("id") - 150)).alias("ref"), F.lit(DAY).alias("created_at"), F.lit(DAY).alias("ingested_at"))
    found = orphan_references(reference_states(children, "k", "ref"), parent_states(parents, "id"), 100)
    assert rows(found.select("record_id")) == sorted((str(i),) for i in range(250, 300))


def test_windows_of_pages(spark):
    page = spark.createDataFrame([("p", o, "字字") for o in (3, 1, 2, 4)], "page string, o int, t string")
    assert rows(spans.pack_windows(page, "page", ["o"], "t", 2, 20)) == [("p", 0, 2, 4), ("p", 1, 2, 4)]
    page = spark.createDataFrame([("p", 1, "女子學校"), ("p", 2, "教育"), ("p", 3, "新聞"), ("q", 1, None), ("q", 2, "")], "page string, o int, t string")
    assert rows(spans.pack_windows(page, "page", ["o"], "t", 10, 6)) == [("p", 0, 1, 4), ("p", 1, 2, 4), ("q", 0, 2, 0)]


def test_page_documents_and_offsets(spark):
    df = spark.createDataFrame([("p", 1, "富紳"), ("p", 2, ""), ("p", 3, "淑女"), ("p", 4, None)], "page string, o int, t string")
    assert rows(spans.running_offsets(df, "page", ["o"], "t").select("start", "end")) == [(0, 2), (3, 5)]
    assert rows(spans.assemble(df, "page", ["o"], "t")) == [("p", "富紳\n淑女", 2)]


def test_gaps_and_occurrences(spark):
    df = spark.createDataFrame([("a", 0, 2), ("a", 2, 4), ("b", 0, 2), ("b", 3, 4), ("b", 3, 5)], "u string, s int, e int")
    assert rows(spans.gaps(df, "u", "s", "e")) == [("a", 0, 0), ("b", 1, 1)]
    df = spark.createDataFrame([("aaa", "aa"), ("abc", "x"), ("a", "ab"), ("abc", "")], "t string, p string")
    assert [r[0] for r in df.select(spans.occurrences("t", "p")).collect()] == [2, 0, 0, 0]


def test_sliding_windows(spark):
    starts = spark.createDataFrame([(7,), (11,), (0,), (6,)], "n int").select(spans.sliding(F.col("n"), 6, 5).alias("s")).collect()
    assert [r.s for r in starts] == [[0, 5], [0, 5], [0], [0]]


def test_polygons(spark):
    box = [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (0.0, 5.0)]
    df = spark.createDataFrame([(box,), (box[:2],)], "p array<struct<x double, y double>>")
    assert [r[0] for r in df.select(spans.polygon_area("p")).collect()] == [50.0, None]
    a, b = (pd.Series({"x0": x, "y0": 0, "x1": x + 10, "y1": 10}) for x in (0, 5))
    assert matching.box_overlap(a, b) == pytest.approx(1 / 3)


@pytest.mark.parametrize(("expected", "read", "edits"), [("甲乙丙", "甲戊丙", (1, 0, 0)), ("中央大戲院", "中央戲院", (0, 1, 0)), ("中央戲院", "中央大戲院", (0, 0, 1)), ("", "", (0, 0, 0)), ("", "ab", (0, 0, 2))])
def test_edit_counts(expected, read, edits):
    assert text.count_edits(expected, read) == edits


def test_text_functions(spark):
    df = spark.createDataFrame([(" Hans Holbein （霍爾平） ", "英皇時召雷臨宮中", "英皇時召霍臨宮中"), (None, None, "x")], "a string, b string, c string")
    assert [r[0] for r in df.select(text.identity_key("a")).collect()] == ["hansholbein霍爾平", None]
    ops = df.select(text.alignment("b", "c").alias("o")).first().o
    assert [(o.a_start, o.a_end, o.b_start, o.b_end) for o in ops if o.op == "replace"] == [(4, 5, 4, 5)]
    assert df.select(F.levenshtein(F.lit("王氏入學女塾"), F.lit("王民入學"))).first()[0] == 3
    assert text.chunk_ranges("x" * 27, [(14, 17)], 16) == [(0, 14), (14, 27)]


def test_identity_functions(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "é"}',), ('{"a":"é","b":1}',), (None,)], "p string")
    a, b, c = (r[0] for r in df.select(ids.canonical_digest("p")).collect())
    assert a == b and c is None
    import uuid

    made = df.select(ids.name_uuid(str(uuid.NAMESPACE_DNS))("p")).first()[0]
    assert made == str(uuid.uuid5(uuid.NAMESPACE_DNS, '{"b": 1, "a": "é"}'))


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=14))
@settings(max_examples=60, deadline=None)
def test_maximum_matching_is_maximum(pairs):
    edges: dict[int, list[int]] = {}
    for a, b in pairs:
        edges.setdefault(a, []).append(b)

    def brute(nodes, used):
        if not nodes:
            return 0
        head, rest = nodes[0], nodes[1:]
        return max([brute(rest, used)] + [1 + brute(rest, used | {b}) for b in edges[head] if b not in used])

    owner = matching.maximum_pairs(edges)
    assert len(owner) == brute(sorted(edges), frozenset())
    assert len(set(owner.values())) == len(owner)


def test_degree_cap_equals_sequential(spark):
    rng = random.Random(3)
    data = list({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}"): rng.randrange(4) for _ in range(60)}.items())
    pairs = [("k", a, b, float(s)) for (a, b), s in data]
    best: dict[tuple[str, str], float] = {}
    for _, a, b, s in pairs:
        if a != b:
            key = (min(a, b), max(a, b))
            best[key] = max(best.get(key, -1), s)
    have: dict[str, int] = {}
    expected = set()
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if have.get(a, 0) < 2 and have.get(b, 0) < 2:
            expected.add((a, b))
            have[a], have[b] = have.get(a, 0) + 1, have.get(b, 0) + 1
    got = matching.degree_capped(spark.createDataFrame(pairs, "kind string, a string, b string, score double"), "kind", 2)
    assert {(r.a, r.b) for r in got.collect()} == expected


def test_chains_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("q", "q"), ("n", None)], "src string, dst string")
    assert rows(selection.follow(edges)) == [("a", "d", 3), ("b", "d", 2), ("c", "d", 1)]
    assert rows(selection.on_cycles(edges)) == [("x",), ("y",)]
    assert rows(timeline.descendants(edges.where("src < 'x' AND dst IS NOT NULL AND src <> dst"), spark.createDataFrame([("a",), ("c",)], "node string"))) == [("b", "a"), ("c", "a"), ("d", "a")]


def test_long_chains_are_followed_to_the_end(spark):
    chain = [(f"v{k:03}", f"v{k + 1:03}") for k in range(150)]
    edges = spark.createDataFrame(chain + [("x", "y"), ("y", "z"), ("z", "x"), ("in", "x")], "src string, dst string")
    assert rows(selection.follow(edges)) == [(f"v{k:03}", "v150", 150 - k) for k in range(150)]
    assert rows(selection.on_cycles(edges)) == [("in",), ("x",), ("y",), ("z",)]


def test_history_and_upsert(spark):
    at = [DAY + dt.timedelta(days=k) for k in range(4)]
    deliveries = spark.createDataFrame([("r", False, at[0]), ("r", False, at[1]), ("r", True, at[2])], "k string, m boolean, ingested_at timestamp")
    got = merges.history(deliveries, "k", ["m"], "ingested_at").orderBy("valid_from").select("m", F.col("valid_to").isNull()).collect()
    assert [tuple(r) for r in got] == [(False, False), (True, True)]
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, None), (3, "c")]))
    assert rows(merges.upsert(old, new, "k", {"v": lambda a, b: F.coalesce(b, a)})) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(merges.insert_absent(old, new, "k")) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(merges.drifted(old, new, "k")) == [(2,)]


def test_asof(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(5)]
    left = spark.createDataFrame([("u", t[0], 1), ("u", t[2], 2), ("u", t[4], 3), ("w", t[4], 4)], "u string, t timestamp, i int")
    right = spark.createDataFrame([("u", t[1], "x"), ("u", t[2], "y")], "u string, t timestamp, v string")
    assert rows(timeline.asof(left, right, ["u"], "t", ["v"]).select("i", F.coalesce("v", F.lit("-")))) == [(1, "-"), (2, "y"), (3, "y"), (4, "-")]


def test_nearest_and_scores(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "id bigint, v array<float>")
    assert [(r.id, r["rank"]) for r in retrieval.nearest(v.where("id = 0"), v, "id", "v", 5).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    df = spark.createDataFrame([(1, 3, 2), (0, 0, 0), (0, 0, 2)], "tp int, p int, e int")
    assert rows(df.select(*scoring.prf("tp", "p", "e"))) == [(0.0, 0.0, 0.0), (0.333333, 0.5, 0.4), (1.0, 1.0, 1.0)]
    sets = spark.createDataFrame([("1", "t", list("孫文")), ("2", "t", list("孫中山")), ("3", "t", list("孫文"))], "id string, b string, items array<string>")
    assert rows(retrieval.jaccard_pairs(sets, "b", 0.25)) == [("1", "2", 0.25), ("1", "3", 1.0), ("2", "3", 0.25)]


def test_evenly_spaced_places(spark):
    k = spark.range(5).select((F.bround(F.col("id") * 99 / 4.0) + 1).cast("int").alias("p"))
    assert [r.p for r in k.orderBy("id").collect()] == [1, 26, 51, 75, 100]
