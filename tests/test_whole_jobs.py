"""Queries that take all rows where one with SQL takes a part, against brute force on small tables."""

import datetime as dt
import itertools
import random
import re
import unicodedata

from evidentia.functions.text import count_edits
from evidentia.operators import matching
from evidentia.plans import graphs, texts

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def write(spark, folder, tmp_path, table, data):
    """The table with its own columns; those not given are null."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    spark.createDataFrame([tuple(row.get(c) for c in schema.names) for row in data], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def test_error_rate_of_whole_texts(spark, folder, tmp_path):
    pairs = [
        ("懿秀女子中學校", "懿秀女予中學"), ("アサギデパート", "アサキデハート"), ("โรงเรียนสตรี", "โรงเรยนสตรี"), ("Женская школа", "Жeнская шкoла"), ("Élodie à l'école", "Elodie a l'ecole"),
        ("plain words", "plain wrods"), ("𠮷野", "吉野"), ("", "x"), ("gone", None),
    ]
    data = [{"text_version_id": f"p{k}", "variant": "read", "text_content": b, "ingested_at": DAY} for k, (b, _) in enumerate(pairs)]
    data += [{"text_version_id": f"c{k}", "parent_text_version_id": f"P{k}", "variant": "edited", "text_content": a, "ingested_at": DAY} for k, (_, a) in enumerate(pairs)]
    got = [tuple(r) for r in texts.character_error_rate_all(spark, write(spark, folder, tmp_path, "text_version", data)).collect()]
    whole = [(b, a) for b, a in pairs if a is not None]
    edits, chars = sum(sum(count_edits(b, a)) for b, a in whole), sum(len(b) for b, _ in whole)
    assert got == [("edited", len(whole), edits, chars, round(edits / chars, 6))]


def test_windows_of_every_language(spark, folder, tmp_path):
    langs = ["en", "EN", "eng", "zh-Hant", "fr", "ja", "de", "ru", "th", None]
    data = [{"doc_id": k, "lang": lang, "text": "woman 女子 " * 40 + "\n" * (k % 2)} for k, lang in enumerate(langs)] + [{"doc_id": 90, "lang": "ja", "text": ""}, {"doc_id": 91, "lang": "en"}]
    got = {tuple(r) for r in texts.token_windows_all(spark, write(spark, folder, tmp_path, "documents", data)).collect()}
    assert got == {(k, 80, 2, 56) for k in range(len(langs))} | {(90, 0, 1, 0)}


def test_pairs_of_all_names(spark, folder, tmp_path):
    catalogue = [
        ("1", "person", "柳芷淑", ["Liu Chih-shu"]), ("2", "person", "Liu Chih", None), ("3", "person", "湯嫻靜", ["T'ang", "柳芷"]), ("4", "organization", "アサギデパート", ["ｱｻｷﾞﾃﾞﾊﾟｰﾄ"]), ("5", "organization", "アサギ", []),
        ("6", "school", "懿秀女子中學校", [None, ""]), ("7", "school", "懿秀女塾", ["·"]), ("8", "person", "·", ["—"]), ("9", "person", None, ["Élodie"]), ("a", "person", "Elodie\u0301", []), ("b", "publication", "柳芷淑", []),
    ]
    data = [dict(zip(("entity_id", "entity_type", "canonical_name", "aliases"), row, strict=True)) for row in [*catalogue, catalogue[0]]]
    got = {tuple(r) for r in texts.character_jaccard_pairs_all(spark, write(spark, folder, tmp_path, "authority_entity", data)).collect()}

    def letters(value):
        return set(re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", value or "").casefold()))

    expected = set()
    for (i, kind, name, aliases), (j, other, second, more) in itertools.combinations(catalogue, 2):
        best = max((len(x & y) / len(x | y) for x in map(letters, [name, *(aliases or [])]) for y in map(letters, [second, *(more or [])]) if x | y), default=0)
        if kind == other and best >= 0.35:
            expected.add((i, j, round(best, 6)))
    assert got == expected and {p[:2] for p in got} >= {("1", "2"), ("1", "3"), ("4", "5"), ("6", "7"), ("9", "a")}


def test_greedy_boxes_equal_brute_force(spark):
    rng = random.Random(4)
    sides = []
    for side in "lr":
        corners = [(page, f"{side}{k}", rng.randrange(12), rng.randrange(12)) for page in "pq" for k in range(9)]
        sides.append([(page, i, float(x), float(y), float(x + rng.randrange(7)), float(y + rng.randrange(1, 7))) for page, i, x, y in corners])
    schema = "page string, id string, x0 double, y0 double, x1 double, y1 double"
    got = {tuple(r) for r in matching.greedy_boxes(*[spark.createDataFrame(x, schema) for x in sides], "page").collect()}

    def iou(a, b):
        cells = [{(x, y) for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1))} for _, _, x0, y0, x1, y1 in (a, b)]
        return len(cells[0] & cells[1]) / max(1, len(cells[0] | cells[1]))

    left, right, expected = list(sides[0]), list(sides[1]), set()
    while pairs := [(-iou(a, b), a[1], b[1], a, b) for a in left for b in right if a[0] == b[0] and iou(a, b) >= 0.05]:
        o, i, j, a, b = min(pairs)
        expected.add((a[0], i, j, round(-o, 6)))
        left.remove(a)
        right.remove(b)
    assert got == expected and len(got) > 6


def test_rule_spans(spark, folder, tmp_path):
    text = ["😀王芷淑女士 and Miss Élan, Mrs. Ockamore; Dr. Wu", "湯君", "", None, "Mr.Ng, 士 Rev. Lee's"]
    data = [{"region_id": f"r{k}", "raw_text": t, "ingested_at": DAY} for k, t in enumerate(text)]
    got = {tuple(r) for r in graphs.rule_spans(spark, write(spark, folder, tmp_path, "ocr_region", data)).collect()}
    named = [("r0", "王芷淑女士"), ("r0", "Mrs. Ockamore"), ("r0", "Dr. Wu"), ("r4", "Rev. Lee")]
    assert got == {(r, text[int(r[1])].index(s), text[int(r[1])].index(s) + len(s), s) for r, s in named}
