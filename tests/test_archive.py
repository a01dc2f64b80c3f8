"""Operators of the archive against brute force and on odd inputs."""

import difflib
import itertools
import json
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.functions.text import chunk_ranges, nfc
from evidentia.operators import identity, matching, merges, models, retrieval, scoring, selection, spans, timeline
from evidentia.sources import manifests, sinks
from evidentia.streaming import logs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_places_and_contexts(spark):
    df = spark.createDataFrame([("aXa aXb", "aX", 4), ("aaaa", "aa", 0), ("", "a", 0), (None, "a", 0), ("abc", "", 1)], "t string, s string, k int")
    got = df.select(C.places_of("t", "s"), C.only_place("t", "s", F.lit(" "), F.lit("b")), C.times_apart("t", "s"), C.left_context("t", "k", 2), C.right_context("t", "k", 2)).collect()
    assert [r[0] for r in got] == [[0, 4], [0, 1, 2], [], [], []]
    assert got[0][1] == 4 and got[1][1] is None and [r[2] for r in got] == [2, 2, 0, None, 0]
    assert (got[0][3], got[0][4], got[1][3]) == ("a ", "aX", "")


def test_small_columns(spark):
    df = spark.createDataFrame([(None, None), (0.4, 3), (0.9, 12)], "x double, n int")
    assert [r[0] for r in df.select(C.passes("x", 0.5)).collect()] == [True, False, True]
    assert [r[0] for r in df.select(C.page_label("n", F.lit(8))).collect()] == [None, "v003-p0008", "v012-p0008"]
    assert [r[0] for r in df.select(C.clamp(F.col("n") / 10, -1, 1)).collect()] == [None, 0.3, 1.0]
    paths = spark.createDataFrame([("a/vol-0012.PDF",), ("x.bin",), ("vol-9",)], "p string")
    assert [tuple(r) for r in paths.select(C.number_after("p", "vol-"), C.media_type("p")).collect()] == [(12, "application/pdf"), (None, "application/octet-stream"), (9, "application/octet-stream")]
    texts = spark.createDataFrame([("One. Two.",), ("Two. One.",), ("none",)], "t string")
    missing, ordered = C.sections("t", ["One", "Two"])
    assert [tuple(r) for r in texts.select(missing, ordered).collect()] == [("", True), ("", False), ("One,Two", True)]
    assert spark.range(1).select(C.failed({"a": F.lit(False), "b": F.lit(None).cast("boolean"), "c": F.lit(True)})).first()[0] == "a,b"
    assert spark.range(1).select(C.first_reason({"a": F.lit(False), "b": F.lit(True), "c": F.lit(True)}, "x"), C.first_reason({"a": F.lit(False)}, "x")).first()[:] == ("b", "x")


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None), (5, [float("inf"), 1.0])], "k int, v array<double>")
    got = df.select(C.is_finite("v"), C.unit("v")).collect()
    assert [r[0] for r in got] == [True, True, True, False, False, False] and got[0][1] == [0.6, 0.8] and [r[1] for r in got[2:]] == [None] * 4
    assert rows(spans.mean_by_place(df.where("k < 3"), "k", "v")) == [(1, 0, 2.0), (1, 1, 2.0), (2, 0, 0.0), (2, 1, 0.0)]


def test_comparison_text(spark):
    texts = ["  a, b!\n(12, 3), (4,5) ", "<b>é</b>é\x00", "１２ 字。", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")

    def plain(t):
        pair = r"\(?\d{1,4}\s*,\s*\d{1,4}\)?\s*"
        t = "\n".join(re.sub(rf"(?:\s*{pair},\s*{pair})+$", "", line) for line in t.splitlines())
        return "".join(c for c in unicodedata.normalize("NFC", re.sub("<[^>]+>", "", t)) if unicodedata.category(c)[0] not in "CPSZ")

    assert [r[0] for r in df.orderBy("k").select(C.comparison_text("t", nfc)).collect()] == [plain(t) for t in texts]


def test_boundaries_through_alignments(spark):
    from evidentia.functions.text import alignment

    df = spark.createDataFrame([("the cat sat", "the dog sat", k) for k in range(13)], "a string, b string, k int")
    got = [r[0] for r in df.select(C.map_boundary(alignment("a", "b"), "k")).collect()]
    ops = difflib.SequenceMatcher(None, "the cat sat", "the dog sat", autojunk=False).get_opcodes()

    def brute(k):
        for op, a, b, c, d in ops:
            if k in (a, b):
                return c if k == a else d
            if a < k < b:
                return c + k - a if op == "equal" else None
        return None

    assert got == [brute(k) for k in range(13)]


def test_articles(spark):
    import hashlib

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    raw, fixed = "the cat sat", "the dog sat"
    rows_ = [
        ("whole", "r1", 0, raw, 0, 11, fixed, sha(fixed)), ("whole", "r2", 1, raw, 4, 7, raw, sha(raw)),
        ("part", "r1", 0, raw, 0, 4, fixed, sha(fixed)), ("inside", "r1", 0, raw, 0, 5, fixed, sha(fixed)),
        ("gap", "r1", 0, raw, 0, 11, raw, sha(raw)), ("gap", "r2", 2, raw, 0, 11, raw, sha(raw)),
        ("digest", "r1", 0, raw, 0, 11, raw, "x"), ("empty", "r1", 0, raw, 3, 3, raw, sha(raw)),
    ]
    df = spark.createDataFrame(rows_, "article_id string, region_id string, sequence int, raw_text string, raw_start int, raw_end int, selected_text string, selected_sha256 string")
    got = {r.article_id: (r.status, r.reason, r.content) for r in timeline.materialize(df).collect()}
    assert got["whole"] == ("ok", None, "the dog sat\ncat") and got["part"] == ("ok", None, "the ")
    assert {k: got[k][1] for k in ("inside", "gap", "digest", "empty")} == {
        "inside": "stretch ends within a correction", "gap": "sequence numbers are not contiguous", "digest": "digest disagrees", "empty": "raw stretch is empty or outside",
    }
    placed = {r.article_id: r.placed for r in timeline.materialize(df).collect()}["whole"]
    assert [(p["region_id"], p["start"], p["end"]) for p in placed] == [("r1", 0, 11), ("r2", 12, 15)]
    assert timeline.materialize(df.limit(0)).count() == 0


def test_chunks_cut_through_nothing():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab .。") for _ in range(rng.randrange(60)))
        protected = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(4)))]
        got = chunk_ranges(text, protected, 20)
        if got is None:  # only where spans that overlap make a stretch longer than the limit
            assert len(protected) > 1
            continue
        assert all(0 < b - a <= 20 for a, b in got) and "".join(text[a:b] for a, b in got) == text
        assert not any(a < cut < b for _, cut in got[:-1] for a, b in protected)
    assert chunk_ranges("x" * 30, [(0, 25)], 10) is None and chunk_ranges("x" * 30, [(3, 6), (5, 12)], 10) == [(0, 3), (3, 13), (13, 23), (23, 30)]
    assert chunk_ranges("one two three", [], 9) == [(0, 8), (8, 13)] and chunk_ranges("", [], 9) == []


def test_polygons():
    square, shifted = [(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (3, 1), (3, 3), (1, 3)]
    assert spans.overlap_of(square, shifted) == pytest.approx(1 / 7) and spans.overlap_of(square, shifted[::-1]) == pytest.approx(1 / 7)
    assert spans.overlap_of(square, [(5, 5), (6, 5), (6, 6)]) == 0 and spans.overlap_of(square, square) == 1
    assert not spans.convex([(0, 0), (4, 0), (1, 1), (0, 4)]) and spans.overlap_of(square, [(0, 0), (4, 0), (1, 1), (0, 4)]) is None
    assert spans.overlap_of(square, [(0, 0), (1, 0), (2, 0)]) is None
    rng = random.Random(1)
    for _ in range(20):  # triangles, against points on a grid
        a, b = ([(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3)] for _ in range(2))
        if not spans.convex(a) or not spans.convex(b):
            continue

        def inside(p, q):
            s = [spans._corner(q[k], q[(k + 1) % 3], p) > 0 for k in range(3)]
            return all(s) or not any(s)

        grid = [(x / 12, y / 12) for x in range(120) for y in range(120)]
        x, y = [inside(p, a) for p in grid], [inside(p, b) for p in grid]
        union = sum(map(max, x, y))
        if union > 500:
            assert spans.overlap_of(a, b) == pytest.approx(sum(map(min, x, y)) / union, abs=0.04)


def test_bags(spark):
    df = spark.createDataFrame([(1, "a b b", "bbc"), (2, " ", ""), (3, "x", " "), (4, None, None), (5, "aa", "aa")], "k int, a string, b string")
    got = {r.k: r.f1 for r in spans.bag_f1(df.where("a IS NOT NULL"), "k", "a", "b").collect()}
    assert got == {1: pytest.approx(4 / 6), 2: 1.0, 3: 0.0, 5: 1.0}


def test_selections(spark):
    df = spark.createDataFrame([("a", k) for k in range(1, 8)] + [("b", 1)], "g string, k int")
    for count in range(1, 9):
        got = [r.k for r in selection.evenly_spaced(df.where("g = 'a'"), ["g"], ["k"], count).orderBy("k").collect()]
        assert len(got) == min(7, count) and (count < 2 or (got[0], got[-1]) == (1, 7))
    items = spark.createDataFrame([(f"m{k:02}", ["x", "y"] if k % 2 else ["y"], f"h{(k * 7) % 30:02}") for k in range(30)], "id string, r array<string>, h string")
    got = {r.id: r.reason for r in selection.quota(items, "id", "r", "h", 4, 12).collect()}
    assert len(got) == 12 and Counter(got.values())["x"] == 4 and set(got.values()) == {"x", "y", "fill"}
    runs = spark.createDataFrame([("p", k, v) for k, v in enumerate(["a", "a", None, None, "a"])], "p string, k int, v string")
    assert [r.island for r in timeline.islands(runs, ["p"], ["k"], "v").orderBy("k").collect()] == [1, 1, 2, 2, 3]


def test_merges(spark):
    old = spark.createDataFrame([("a", None, "1")], "k string, p string, v string")
    new = spark.createDataFrame([("a", None, "2"), ("b", None, "4"), ("b", None, "3"), ("a", "x", "5"), (None, None, "6")], "k string, p string, v string")
    got = merges.insert_absent_where(old, new, ["k"], F.col("p").isNull(), ["v"])
    assert sorted(r.v for r in got.collect()) == ["1", "3", "5", "6"]
    a, b = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert tuple(merges.coverage(a, b, "k").first()) == (2, 2, 1, 1, False) and merges.coverage(a, a, "k").first().covered
    members = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "m string")
    assigned = spark.createDataFrame([("m1", "c"), ("m1", "c"), ("m2", "c"), ("m2", "d")], "m string, c string")
    assert tuple(merges.partition_check(members, assigned, "m", "c").first()) == (3, 1, 1, 1)
    state = spark.createDataFrame([("r", None, True), ("a", "r", False), ("b", "a", False), ("c", "a", True), ("d", "c", False)], "k string, p string, f boolean")
    assert rows(timeline.reopened(state, "k", "p", "f")) == [("a",), ("d",)]


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    catalogue = spark.createDataFrame([(f"e{k}", "t", names[k], [names[k + 1]] if k % 3 else None) for k in range(25)] + [("u0", "u", "abcd", None)], "entity_id string, entity_type string, canonical_name string, aliases array<string>")
    typed = names[20:] + [" ", "Abcd"]
    got = {}
    for r in identity.link_candidates(spark.createDataFrame([("t", n) for n in typed + typed[:3]] + [("t", None)], "entity_type string, name string"), catalogue).collect():
        got.setdefault(r.name, []).append((r["rank"], r.entity_id, r.score))

    def key(n):
        return re.sub(r"\s", "", n.lower())

    known = {}
    for r in catalogue.where("entity_type = 't'").collect():
        known[r.entity_id] = [k for n in [r.canonical_name, *(r.aliases or [])] if (k := key(n))]
    for n in typed:
        scores = {e: max([difflib.SequenceMatcher(None, key(n), k).ratio() for k in ks] or [0]) for e, ks in known.items()} if key(n) else {}
        best = sorted(((-s, e) for e, s in scores.items() if s >= 0.72))[:5]
        expected = [(i + 1, e, round(-s, 6)) for i, (s, e) in enumerate(best)]
        expected.append((len(best) + 1, None, round(max(0.05, 1 + (best[0][0] if best else 0)), 6)))
        assert sorted(got[n], key=lambda x: x[0]) == expected, n
    assert identity.link_candidates(spark.createDataFrame([("t", "x")], "entity_type string, name string"), catalogue.limit(0)).collect()[0][2:] == (1, None, 1.0)


def test_identity_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    profiles = [(f"p{k:02}", "t" if k % 4 else "u", ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 3))]) for k in range(30)]
    df = spark.createDataFrame(profiles + [("p98", "t", []), ("p99", "t", ["--", None])], "profile_id string, entity_type string, names array<string>")
    pairs = []
    for (a, t, x), (b, u, y) in itertools.combinations(profiles, 2):
        if t == u:
            exact = bool(set(x) & set(y))
            best = max(len(set(m) & set(n)) / len(set(m) | set(n)) for m in x for n in y)
            if exact or best >= 0.35:
                pairs.append((t, a, b, exact, 1.0 if exact else best))
    kept, degree = set(), Counter()
    for t, a, b, _, score in sorted(pairs, key=lambda p: (-p[4], p[1], p[2])):
        if degree[a] < 3 and degree[b] < 3:
            kept.add((t, a, b))
            degree.update([a, b])
    got = identity.candidate_pairs(df, most=3).collect()
    assert {(r.entity_type, r.left_id, r.right_id) for r in got} == kept
    exact = {(a, b): e for _, a, b, e, _ in pairs}
    assert all(exact[r.left_id, r.right_id] == r.exact for r in got)
    scored = identity.candidate_pairs(df, most=50, scorer=lambda p: models.score_pairs(p.select("left_id", "right_id"), "left_id", "right_id", lambda: lambda a, b: [float(len(x) == 3) for x in a]))
    assert {(r.left_id, r.right_id) for r in scored.collect()} == {(a, b) for _, a, b, _, _ in pairs} and {r.score for r in scored.collect()} == {1.0}


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties
    data = [(k, v[k].tolist(), "ab"[k % 2]) for k in range(60)] + [(98, None, "a"), (99, [0.0] * 4, "a"), (97, [float("nan")] * 4, "a"), (96, [1.0, 0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(data, "id bigint, v array<double>, g string").repartition(5)
    good = {k: np.array(x) / np.linalg.norm(x) for k, x, _ in data if x is not None and np.isfinite(x).all() and np.any(x)}
    group = {k: g for k, _, g in data}
    for same in (None, "g"):
        got = {}
        for r in retrieval.nearest(df.where("id % 3 = 0"), df, "id", "v", 5, same=same).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id, r.cosine))
        expected = {}
        for q in (k for k in good if k % 3 == 0):
            found = sorted((-round(float(good[q] @ x), 6), k) for k, x in good.items() if k != q and (same is None or (group[k] is not None and group[k] == group[q])))[:5]
            if found:
                expected[q] = [(i + 1, k, -c) for i, (c, k) in enumerate(found)]
        assert {q: [k for _, k, _ in sorted(x)] for q, x in got.items()} == {q: [k for _, k, _ in x] for q, x in expected.items()}, same
    assert retrieval.nearest(df.limit(0), df, "id", "v", 5).count() == 0 and retrieval.nearest(df.where("id = 1"), df.limit(0), "id", "v", 5).count() == 0
    plan = retrieval.nearest(df, df, "id", "v", 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_terms(spark):
    df = spark.createDataFrame([("The École, 女子學校 a字b 2nd",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(retrieval.terms_of("t")).collect()]
    assert got == [["the", "école", "女子", "子學", "學校", "a", "字", "b", "2nd"], [], []]


def test_search_report(spark):
    about = spark.createDataFrame([(1, "s1", True), (1, "s2", True), (2, "s3", False)], "id int, place string, good boolean")
    hits = {"a": [(1, 1), (2, 2)], "b": []}
    expected = spark.createDataFrame([("a", "s2"), ("a", "s9"), ("b", "s1")], "question string, place string")
    search = lambda q: spark.createDataFrame([(q, k, h) for k, h in hits[q]], "question string, id int, hit int")
    got = {r.question: tuple(r)[1:] for r in scoring.retrieval_report(["a", "b"], search, about, "id", expected, "place", ["good"]).collect()}
    assert got == {"a": (0.5, 0.5, 2, 0.5), "b": (0.0, 0.0, 0, 1.0), "all": (0.25, 0.25, 2, 0.5)}


def test_models(spark):
    df = spark.createDataFrame([(1, "Ann met Bob"), (2, None), (3, "")], "id int, text string")

    def factory():
        return lambda texts, least: [[(m.start(), m.end(), "person", 0.9) for m in re.finditer("[A-Z][a-z]+", t)] for t in texts]

    got = rows(models.predict_spans(df, "id", "text", factory, 0.5, batch=1))
    assert got == [(1, 0, 3, "person", 0.9, "Ann"), (1, 8, 11, "person", 0.9, "Bob")]
    for bad in (lambda texts, least: [], lambda texts, least: [[(0, 99, "x", 0.9)]] * len(texts)):
        with pytest.raises(Exception, match="predictor"):
            models.predict_spans(df, "id", "text", lambda bad=bad: bad).collect()
    with pytest.raises(Exception, match="scorer"):
        models.score_pairs(df.coalesce(1), "id", "text", lambda: lambda a, b: [1.0]).collect()
    encoder = lambda: lambda texts: [[float(t.count("a")) + 1, float(t.count("b"))] for t in texts]
    vectors = {r.id: r for r in models.encode_texts(spark.createDataFrame([(1, "a b a b"), (2, " "), (3, None), (4, "bbbb")], "id int, text string"), "id", "text", encoder, limit=2, step=1).collect()}
    assert (vectors[1].windows, vectors[2].windows, vectors[4].windows) == (3, 0, 3) and vectors[2].embedding is None and vectors[3].embedding is None
    assert math.isclose(sum(x * x for x in vectors[1].embedding), 1)
    with pytest.raises(Exception, match="encoder"):
        models.encode_texts(df, "id", "text", lambda: lambda texts: [[0.0]] * len(texts)).collect()
    assert spark.range(1).select(models.embedded_query("x", lambda t: [1, 2], 2)).first()[0] == [1.0, 2.0]
    with pytest.raises(ValueError):
        models.embedded_query("x", lambda t: [1.0], 2)
    stages = models.Stages()
    stages.add("twice", ["base"], lambda b: b.union(b))
    stages.add("count", ["twice", "base"], lambda t, b: t.groupBy().count())
    assert stages.order("count") == ["base", "twice", "count"][1:] and stages.run(["count"], base=df)["count"].first()[0] == 6
    stages.add("loop", ["loop"], lambda x: x)
    for wanted, tables in ((["loop"], {}), (["count"], {})):
        with pytest.raises(ValueError):
            stages.run(wanted, **tables)


def test_leases_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    events = []
    for job in range(12):
        at = rng.randrange(50)
        for _ in range(rng.randrange(1, 9)):
            events.append((f"j{job}", at, rng.choice(["claim", "claim", "heartbeat", "done"] if rng.random() < 0.4 else ["claim", "heartbeat"])))
            at += rng.randrange(1, 40)
    events.append(("end", 5000, "claim"))  # moves the watermark past all leases
    df = spark.createDataFrame(events + events[:5], "job_id string, s int, event string").select("job_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"), "event")
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    spark.range(1).select(F.lit("end").alias("job_id"), F.timestamp_seconds(F.lit(1_700_009_000)).alias("ts"), F.lit("heartbeat").alias("event")).write.parquet(str(tmp_path / "in" / "b"))
    batch = {r.job_id: (r.status, r.attempts) for r in logs.lease_states(df, 30, 2, "2023-11-15 00:00:00").collect()}

    def brute(job):
        attempts, until, status = 0, 0, "pending"
        for s, e in sorted({(s, e) for j, s, e in events if j == job}) + [(10**9, "")]:
            if status == "running" and s >= until:
                status = "failed" if attempts >= 2 else "pending"
            if status == "pending" and e == "claim":
                attempts, until, status = attempts + 1, s + 30, "running"
            elif status == "running" and e == "heartbeat":
                until = max(until, s + 30)
            elif status == "running" and e == "done":
                status = "done"
        return status, attempts

    assert batch == {j: brute(j) for j in {j for j, _, _ in events}}
    schema = "job_id string, ts timestamp, event string"
    for part in ("a", "b"):
        for file in (tmp_path / "in" / part).glob("*.parquet"):
            file.rename(tmp_path / "in" / f"{part}-{file.name}")
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*.parquet"))
    query = logs.leases(log, 30, 2).writeStream.format("memory").queryName("leases").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r.job_id: (r.status, r.attempts) for r in spark.sql("SELECT job_id, max_by(struct(status, attempts), at).status AS status, max(attempts) AS attempts FROM leases GROUP BY job_id").collect()}
    assert {j: s for j, s in last.items() if j != "end"} == {j: s for j, s in batch.items() if j != "end" and s[1] > 0}


def test_windows_and_sessions_stream_equal_batch(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    log = logs.read_log(spark, str(tmp_path / "in"), files=1)
    plain = events.withColumn("ts", F.col("ts").cast("timestamp"))
    for name, query in (("tumbling", logs.windowed_counts), ("sessions", logs.sessions)):
        stream = query(log, late="90 days").writeStream.format("memory").queryName(name).outputMode("complete" if name == "tumbling" else "append").trigger(availableNow=True).start()
        stream.awaitTermination()
        batch = query(plain, late="90 days")
        if name == "tumbling":
            count = lambda df: rows(df.select("w.start", "event_type", "n", F.round("total", 4)))
            assert count(spark.table(name)) == count(batch)
        else:  # what the watermark has closed is a part of all sessions
            assert set(rows(spark.table(name).select("user_id", "w.start", "n"))) <= set(rows(batch.select("user_id", "w.start", "n")))
    kept = logs.latest_states(log, keep="1 day").writeStream.format("memory").queryName("kept").outputMode("update").trigger(availableNow=True).start()
    kept.awaitTermination()
    assert spark.table("kept").select("user_id").distinct().count() == events.select("user_id").distinct().count()


def _pdf(count: int) -> bytes:
    out, offsets = b"%PDF-1.4\n", []
    for k, body in enumerate([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [] >>" % count], 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = len(out)
    out += b"xref\n0 3\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % o for o in offsets) + b"trailer << /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % table
    return out


def test_manifest_of_files(spark, tmp_path):
    files = {
        "vol-0007.pdf": _pdf(41), "vol-8.PDF": b"%PDF-1.4 cut", "vol-9.djvu": b"AT&TFORM\0\0\0\0DJVMDIRM\0\0\0\x10\x81\x03\x49", "vol-10.djvu": b"nothing",
        "a.jpg": b"\xff\xd8\xff..\xff\xd9", "b.jpeg": b"\xff\xd8\xff", "c.txt": b"x",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in manifests.file_manifest(spark, str(tmp_path)).collect()}
    assert {n: (r.status, r.page_count, r.volume_number) for n, r in got.items()} == {
        "vol-0007.pdf": ("ok", 41, 7), "vol-8.PDF": ("suspect", None, 8), "vol-9.djvu": ("ok", 841, 9), "vol-10.djvu": ("suspect", None, 10),
        "a.jpg": ("ok", None, None), "b.jpeg": ("suspect", None, None), "c.txt": ("unsupported", None, None),
    }
    assert got["vol-8.PDF"].issues == ["no startxref and end mark"] and got["a.jpg"].media_type == "image/jpeg" and got["vol-8.PDF"].page_count_source == "no startxref"
    ranges = spark.createDataFrame([(str(tmp_path / "a.jpg"), 1, 2), (str(tmp_path / "a.jpg"), 6, 9), (str(tmp_path / "a.jpg"), 99, 1)], "path string, start int, size int")
    assert [bytes(r.data) for r in manifests.read_ranges(ranges).collect()] == [b"\xd8\xff", b"\xd9", b""]


def test_search_answers(spark):
    def hit(k, **changes):
        return {"_index": "i", "_score": 1.5, "_source": {"revision_id": f"d{k}", "content": "t", "embedding_model": "m", "sources": [{"sequence_number": s, "region_id": f"r{s}", "document_start": 0, "document_end": 2} for s in range(k)], **changes}}

    def answers(*hits):
        return spark.createDataFrame([("q", json.dumps({"hits": {"hits": list(hits)}}))], "q string, j string")

    got = rows(manifests.search_hits(answers(hit(1), hit(2)), "q", "j", "m").select("rank", "document_id", "sequence"))
    assert got == [(1, "d1", 0), (2, "d2", 0), (2, "d2", 1)] and manifests.search_hits(answers(), "q", "j").count() == 0
    for bad in (answers(hit(1, embedding_model="other")), answers(hit(1, revision_id=None)), spark.createDataFrame([("q", "{}")], "q string, j string"), spark.createDataFrame([("q", "{oops")], "q string, j string")):
        with pytest.raises(Exception):
            manifests.search_hits(bad, "q", "j", "m").collect()


def test_export_faults(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "r1", "富紳"), ("p", 2, "r2", "淑女")], "page_id string, o int, region_id string, t string")
    placed, pages = spans.running_offsets(df, "page_id", ["o"], "t"), spans.assemble(df, "page_id", ["o"], "t")
    root = str(tmp_path / "x")
    sinks.export_citations(placed, pages, root)
    assert sinks.export_faults(spark, root).count() == 0
    placed.unionByName(placed.limit(1)).write.mode("append").json(f"{root}/citations")
    assert {r.fault for r in sinks.export_faults(spark, root).collect()} == {"differs from the manifest", "region is cited twice", "parts are not accounted for"}


def test_degree_caps_equal_the_sequential_result(spark):
    rng = random.Random(6)
    pairs = [("k", f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", float(rng.randrange(5))) for _ in range(90)]
    best = {}
    for _, a, b, s in pairs:
        if a != b:
            best[min(a, b), max(a, b)] = max(s, best.get((min(a, b), max(a, b)), 0.0))
    kept, degree = set(), Counter()
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if degree[a] < 2 and degree[b] < 2:
            kept.add((a, b))
            degree.update([a, b])
    got = matching.degree_capped(spark.createDataFrame(pairs, "t string, a string, b string, score double"), "t", 2)
    assert {(r.a, r.b) for r in got.collect()} == kept


def test_range_join_equals_brute_force(spark):
    rng = random.Random(9)
    a, b = ([(rng.choice("xy"), rng.randrange(-50, 200), k) for k in range(80)] for _ in range(2))
    left = spark.createDataFrame(a + [(None, 1, 98), ("x", None, 99)], "g string, e int, i int")
    right = spark.createDataFrame(b + [("x", None, 99)], "g string, s int, k int")
    for low, high in ((0, 40), (-5, 60), (3, 3), (-9, -2)):
        got = rows(spans.within(left, right, ["g"], "e", "s", low, high).select("i", "k"))
        assert got == sorted(((i, k) for g, e, i in a for h, s, k in b if g == h and low <= s - e <= high), key=repr)


def test_keys_of_one_digest_are_told_apart():
    import pyarrow as pa

    from evidentia.operators.references import _probe

    lists = {"keys": (["a", "b", "c"], pa.string()), "digests": ([1, 5, 5], pa.int64()), "firsts": ([10, 10, 10], pa.int64()), "gones": ([False, True, False], pa.bool_())}
    parents = pa.table({n: pa.array([v], pa.list_(t)) for n, (v, t) in lists.items()})
    refs = pa.table({"record_id": [f"r{k}" for k in range(6)], "ref": ["a", "b", "c", "d", "x" * 999, "a"], "digest": pa.array([1, 5, 5, 5, 9, 1], pa.int64()), "first_us": pa.array([20, 20, 20, 20, 20, 5], pa.int64()), "created_at": list(range(6))})
    got = _probe(refs, parents).to_pylist()
    assert [(r["record_id"], r["cause"]) for r in got] == [("r1", "deleted"), ("r3", "missing"), ("r4", "missing"), ("r5", "late")]
    assert _probe(refs, parents.slice(0, 0)).num_rows == 6 and _probe(refs.slice(0, 0), parents).num_rows == 0
