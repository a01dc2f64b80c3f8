import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.llm import boosting, groups, lookalikes, maxent, names, oversized, packing, reading, scans, sentences, tokens

LONG = "wort " * 40_000


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- groups


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"c{k}", f"c{k + 1}") for k in range(40)] + [("x", None), (None, "y"), ("z", "z")]
    parent: dict[str, str] = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a and b and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = groups.components(spark.createDataFrame([(a, b, 1) for a, b in edges], "src string, dst string, extra int"))
    expected = {(v, find(v)) for v in list(parent)}
    assert set(rows(got)) == {(v, min(u for u, r in expected if r == root)) for v, root in expected}


def test_large_frontiers_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(groups, "_SMALL", 2)
    star = spark.createDataFrame([("hub", f"l{k}") for k in range(30)] + [("p", "q")], "src string, dst string")
    assert Counter(r.label for r in groups.components(star).collect()) == {"hub": 31, "p": 2}


def test_components_of_nothing(spark):
    assert groups.components(spark.createDataFrame([], "src string, dst string")).count() == 0


# ---- names


@pytest.fixture(scope="module")
def catalogue(spark):
    data = [
        ("1", "person", "柳芷淑", ["Liu Chih-shu"]), ("2", "person", "湯嫻靜", ["T'ang Hsien-ching"]), ("3", "person", "Katherine Ruth Ockamore", None), ("4", "person", "Katherine Blythe Dunomere", []),
        ("5", "school", "廣州懿秀女子中學校", []), ("6", "school", "廣州懿秀女子師範學校", []), ("7", "organization", "Chefoo Widows' Temperance Association", []), ("8", "organization", "アサギデパート", []),
        ("9", "organization", "上海立誠救濟會", []), ("10", "organization", "天津崇本救濟會", []),
    ]
    return spark.createDataFrame(data, "entity_id string, entity_type string, canonical_name string, aliases array<string>")


def test_variants_are_linked(spark, catalogue):
    typed = {
        ("柳芝淑", "person"): "1", ("柳·芷淑女士", "person"): "1", ("SHU LIU CHIH", "person"): "1", ("汤娴静", "person"): "2", ("湯小姐嫻靜", "person"): "2", ("T'ang Hsien ching", "person"): "2",
        ("K. R. Ockamore", "person"): "3", ("Ockamore, Katherine", "person"): "3", ("Kitty Ockamore", "person"): "3", ("Katherine Ockamroe", "person"): "3", ("Katherine", "person"): None,
        ("Katherine Wistamore", "person"): None, ("懿秀女中（廣州）", "school"): "5", ("粵懿秀女師", "school"): "6", ("廣州懿秀女子", "school"): None, ("廣州明真女子中學校", "school"): None,
        ("C.W.T.A.", "organization"): "7", ("The Widows' Temperance Assn. (Chefoo)", "organization"): "7", ("ｱｻｷﾞﾃﾞﾊﾟｰﾄ本店", "organization"): "8", ("本埠崇本救濟社", "organization"): "10",
        ("天津立誠救濟會", "organization"): None, ("", "person"): None, (None, "person"): None,
    }
    nicknames = spark.createDataFrame([("Kitty", "Katherine"), (None, "x")], "short_name string, full_name string")
    values = spark.createDataFrame([(v, k) for v, k in typed], "value string, entity_type string")
    got = {(r.value, r.entity_type): r.entity_id for r in names.link_names(values.union(values), catalogue, nicknames).collect()}
    assert got == {k: v for k, v in typed.items() if v}


def test_similar_tokens_equal_brute_force(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(2, 8))) for _ in range(80)})
    left, right = words[::2], words[1::2]
    df = [spark.createDataFrame([(w,) for w in side], "token string") for side in (left, right)]

    def jaccard(a, b):
        x, y = set(names.q_grams(a)), set(names.q_grams(b))
        return len(x & y) / len(x | y)

    expected = {(a, b) for a in left for b in right if jaccard(a, b) >= 0.3}
    assert set(rows(names.similar_tokens(*df, 0.3))) == expected


# ---- look-alikes


def test_looks(spark):
    same = [
        ["Tarrazel", "T\u0430rrazel", "\uff34\uff41rrazel", "Tar\u200brazel"], ["\u00c9lodie", "E\u0301lodie"], ["文慧", "\u2f42慧", "文\ufe00慧"],
        ["デパート", "\uff83\uff9e\uff8a\uff9f\uff70\uff84", "テ\u3099ハ\u309aート"], ["A B", "A\u00a0B", "A\u2009B"],
    ]
    other = ["tarrazel", "Elodie", "AB", "乐", "樂", ""]
    data = [(v,) for group in same for v in group] + [(v,) for v in other] + [(None,)]
    got = {r.value: r.canonical for r in lookalikes.canonical_forms(spark.createDataFrame(data, "value string")).collect()}
    assert len(got) == len(data) - 1
    assert [len({got[v] for v in group}) for group in same] == [1] * len(same)
    assert len(set(got.values())) == len(same) + len(other)


def test_pairs_of_looks_equal_brute_force(spark):
    rng = random.Random(2)
    forms = ["Ada", "Аda", "Ａda", "Bea", "Веа", "Cy"]
    data = [(f"m{k:03}", f"r{rng.choice([1, 1, 1, 2, 3])}", "f", rng.choice([*forms, None])) for k in range(60)]
    df = spark.createDataFrame(data, "mention_id string, region_id string, field_name string, value string")
    canonical = lookalikes.canonical_forms(df.select("value"))
    form = {r.value: r.canonical for r in canonical.collect()}
    expected = sorted(("f", a[0], b[0]) for a, b in itertools.combinations(data, 2) if a[1] == b[1] and a[3] and b[3] and a[3] != b[3] and form[a[3]] == form[b[3]])
    assert rows(lookalikes.same_looks(df, canonical)) == expected


# ---- sizes


@given(st.text(alphabet=st.sampled_from(list("aB9 \n.,。大　-")), max_size=400), st.integers(2, 40), st.integers(0, 10))
@settings(max_examples=200, deadline=None)
def test_pieces_cover_the_text(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    pieces, hard = oversized.cut_points(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b, _ in pieces)
    assert "".join(text[a + (overlap if k else 0) : b] for k, (a, b, _) in enumerate(pieces)) == text
    assert all(b - overlap == c for (_, b, _), (c, _, _) in zip(pieces, pieces[1:]))
    values = oversized.strengths(text)
    assert all((values[b - 1] > 0) == (strength > 0) for _, b, strength in pieces[:-1])
    longest = max((len(list(g)) for k, g in itertools.groupby(values == 0) if k), default=0)
    assert hard == (len(text) > limit and longest > limit)


def test_range_maximum_is_rightmost():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 4, 200).astype(np.uint8)
    table = oversized.RangeMaximum(v, 64)
    for a in range(0, 150, 7):
        for b in range(a, a + 50, 11):
            at, best = table.rightmost(a, b)
            assert best == v[a : b + 1].max() and at == a + np.flatnonzero(v[a : b + 1] == best)[-1]


def test_pieces_of_odd_documents(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, LONG, 0), (4, "字" * 4000, 0), (3, LONG, 0)], "doc_id bigint, text string, starts int")
    got = {r.doc_id: (r.cut_kind, len(r.starts)) for r in oversized.split_documents(df).collect()}
    assert got[1] == got[2] == (None, 0) and got[3][0] == "natural" and got[4][0] == "hard"
    kinds = {r.doc_id: r.kinds for r in oversized.split_documents(df).collect()}
    assert kinds[1] == [] and set(kinds[4]) == {"hard", "end"} and kinds[3][-1] == "end" and set(kinds[3][:-1]) == {"natural"}


def test_symbols_are_no_boundaries():
    assert not oversized.strengths("\u22ef\u00d7\u2192a").any() and oversized.strengths("\u2026\u3000\u00a0").all()
    assert oversized.cut_points("\u22ef" * 1501)[1] and not oversized.cut_points("\u2026" * 1501)[1]


# ---- tokens and containers

_PIECES = ["'", "'s", "ll", " ", "  ", "\n", "a", "B", "é", "1", "23", "。", "大", "\xad", "　", "-", ".", "👩‍👧", "\t", "<|endoftext|>", "\x1c", "é"]


@given(st.lists(st.sampled_from(_PIECES), max_size=40).map("".join), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_tree_equals_plain_encoding(text, leaf):
    coder = tokens.encoder()
    codec = tokens.TreeCodec(coder, leaf)
    ids = codec.encode(text)
    assert ids == coder.encode_ordinary(text)
    assert codec.decode(ids) == text


def test_ids_equal_the_published_tokenizer(spark, folder):
    from tokenizers import Tokenizer

    published = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    published.encode_special_tokens = True
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, LONG), (-4, "字" * 30_000), (-4, "<|endoftext|>")], "doc_id bigint, text string")
    texts = {}
    for r in documents.unionByName(extra).collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    got: dict = {}
    for r in tokens.encode_documents(documents.unionByName(extra), leaf=512).collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    for doc, values in texts.items():
        expected = [published.encode(t, add_special_tokens=False).ids if t else [] for t in values]
        assert sorted(got[doc]) == sorted(expected)


@given(st.lists(st.integers(0, 50), max_size=120))
@settings(max_examples=150, deadline=None)
def test_windows_hold_everything(sizes):
    window = packing.pack(sizes, 50)
    load = Counter()
    for size, w in zip(sizes, window, strict=True):
        load[w] += size
    assert len(window) == len(sizes) and all(v <= 50 for v in load.values())


def test_windows_are_nearly_equal():
    rng = random.Random(7)
    sizes = [rng.randrange(1, 400) for _ in range(1500)]
    assert len(set(packing.pack(sizes, 2048))) <= 1.001 * sum(sizes) / 2048 + 1
    skewed = [round(30 * rng.paretovariate(0.6)) % 2048 + 1 for _ in range(1024)]
    assert len(set(packing.pack(skewed, 2048))) <= 1.01 * max(sum(skewed) / 2048, sum(s > 1024 for s in skewed)) + 1


def test_a_document_delivered_many_times_is_spread(spark):
    lengths = spark.range(600).select(F.lit(7).cast("long").alias("doc_id"), F.lit(1500).alias("tokens"))
    pieces = packing.pack_documents(lengths, batch=50)
    report = packing.fill_report(pieces).first()
    assert (report.documents, report.containers, report.fullest, report.lower_bound, report.unused) == (600, 600, 1500, 440, round(1 - 1500 / 2048, 6))
    assert pieces.select(F.split("container_id", "-")[0].alias("b")).distinct().count() > 6
    assert packing.fill_report(pieces.limit(0)).first().containers == 0


def test_containers_of_documents(spark):
    lengths = spark.createDataFrame([(1, 5000), (2, 0), (3, None), (4, 2048), (5, 700), (6, 1348), (6, 1348)], "doc_id bigint, tokens int")
    pieces = packing.pack_documents(lengths).collect()
    load = Counter()
    for p in pieces:
        load[p.container_id] += p.token_end - p.token_start
    assert max(load.values()) <= 2048 and sum(load.values()) == 5000 + 2048 + 700 + 2 * 1348
    assert sorted((p.piece_no, p.token_end - p.token_start) for p in pieces if p.doc_id == 1) == [(0, 2048), (1, 2048), (2, 904)]
    assert {p.doc_id for p in pieces} == {1, 2, 3, 4, 5, 6}
    assert packing.pack_documents(lengths.limit(0)).count() == 0


# ---- models


def test_models_learn():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = boosting.Booster().fit(x[:600], y[:600])
    assert ((trees.probability(x[600:]) > 0.5) == y[600:]).mean() > 0.85
    z = (x[:, 0] + x[:, 2] > 0).astype(int)
    w = maxent.fit(x[:600], z[:600], 2)
    assert (maxent.probabilities(x[600:], w).argmax(1) == z[600:]).mean() > 0.95
    assert maxent.fit(np.zeros((0, 3)), np.zeros(0, int), 2).shape == (4, 2)
    assert boosting.Booster().fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).max() < 0.5


# ---- sentences

_UNITS = {
    "en": ["Dr. A. Ambrcroft printed the names.", "The class meets at 7.30 p.m. on Mon. and Thurs. in Room No. 44.", "The card said, \"A small child sat by the door. Bring a friend.\" and nothing more.", "\"Is it true?\" she asked.", "She waited ... and waited until the gate opened."],
    "zh": ["「讀書會會員討論工廠時間問題！」母親大聲說。", "他說⋯⋯不必再等。", "她問：「大姐回家了？」", "白米每擔漲價19.3元，較前多三成。"],
    "th": ["วันนี้แม่ของฉันกลับบ้าน", "ครูกินข้าว"],
}


@pytest.fixture(scope="module")
def model(spark, folder):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("variant IN ('corrected_transcription', 'approved_reconstruction') AND text IS NOT NULL")
    corpus = sentences.corpus_of(sentences.corpus_counts(texts))
    return corpus, sentences.train(texts, corpus)


@pytest.mark.parametrize(("lang", "gap"), [("en", " "), ("zh", ""), ("th", " ")])
def test_known_units(model, lang, gap):
    text = "\n\n".join([gap.join(_UNITS[lang]), gap.join(_UNITS[lang][::-1])])
    got = [text[a:b] for a, b in sentences.units(text, *model)]
    assert got == _UNITS[lang] + _UNITS[lang][::-1]


def test_units_cover_all_but_white_space(spark, folder, model):
    for r in spark.read.parquet(f"{folder}/documents.parquet").where("text IS NOT NULL").collect():
        spans = sentences.units(r.text, *model)
        assert all(a < b <= c < d for (a, b), (c, d) in zip(spans, spans[1:]))
        left = "".join(r.text[a:b] for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(r.text)]))
        assert not left.strip()
    assert sentences.units("", *model) == sentences.units("　\n", *model) == []
    assert sentences.units(LONG, *model) == [(0, len(LONG) - 1)]


def test_units_of_odd_documents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "　　"), (4, "One."), (4, "One.")], "doc_id bigint, text string")
    assert rows(sentences.sentence_units(df)) == [(4, 0, 4), (4, 0, 4)]
    assert sentences.sentence_units(df.limit(0)).count() == 0


# ---- scans


def test_noise_of_planted_pages(spark):
    rng = random.Random(4)
    words = "the committee collected donations for flooded villages while headmistress published short account meeting reading circle agreed lower yearly fees council better road".split()
    edited = [(" ".join(rng.choice(words) for _ in range(60)) + ".",) for _ in range(200)]
    scans_ = []
    for k in range(120):
        body = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(6)]
        lines = ["THE EASTERN LANTERN. 1901", *body, f"- {k} -"] if k % 2 else [*body, str(k)]
        scans_.append(("t", str(k), "\n".join(lines)))
    scans_[5] = ("t", "5", "\n".join(["THE EASTERN LANTERN. 1901", "the comrnittee collected donations", "for the flooded vil-", "lages while the council agreed", "to lower the yearly fees", "- 5 -"]))
    scans_ += [("t", "null", None), ("t", "empty", ""), ("t", "lost", "the council ■ road\nand fees")]
    got = scans.scan_noise(spark.createDataFrame(scans_, "table_name string, record_id string, text string"), spark.createDataFrame(edited, "text string")).collect()
    found = {(r.record_id, r.line_no, r.noise) for r in got}
    assert {("5", 0, "running_header"), ("5", 2, "broken_word"), ("5", 5, "page_number"), ("lost", 0, "misread")} <= found
    heads = {(str(k), 0, "running_header") for k in range(120) if k % 2}
    assert heads <= found and not {r for r in found if r[0] in ("null", "empty")}


def habitual_misreadings(spark, rare=60):
    """Items and lexicon: 'l' was read as 'j' in 60 words and in 'balkonu'; ``rare`` right words have
    'j' where others have one of n, r, s, t and v."""
    rng = random.Random(7)
    lexicon, items = Counter(), Counter({"bajkonu": 1})
    for k in range(60 + rare):
        word, at = "".join(rng.choice("abcdefghikmopu") for _ in range(6)), rng.randrange(1, 6)
        lexicon[word[:at] + ("l" if k < 60 else "nrstv"[k % 5]) + word[at:]] = 20
        (items if k < 60 else lexicon)[word[:at] + "j" + word[at:]] = 1
    lexicon |= Counter({f"ba{c}konu": 1000 for c in "nrstv"}) | Counter({"balkonu": 20})
    schema = "kind string, item string, n bigint"
    return [spark.createDataFrame([("w", w, n) for w, n in counted.items()], schema) for counted in (items, lexicon)]


def test_candidates_behind_more_frequent_ones_are_judged(spark):
    items, lexicon = habitual_misreadings(spark)
    got = {r.item: r.correction for r in scans.judge(items, lexicon).collect()}
    assert got.get("bajkonu") == "balkonu"  # five other words are as near and more frequent


def test_habits_are_told_by_all_rare_items(spark, monkeypatch):
    monkeypatch.setattr(scans, "SAMPLE_PAIRS", 40)
    items, lexicon = habitual_misreadings(spark, rare=300)
    names = ["ogjapek", "cujimad", "figebjo"]  # right, and as 'j' for n, r, s, t and v in rare words
    items = items.unionByName(items.sparkSession.createDataFrame([("w", n, 1) for n in names], items.schema))
    lexicon = lexicon.unionByName(items.sparkSession.createDataFrame([("w", n.replace("j", c), 20) for n, c in zip(names, "nsv")], items.schema))
    misread = {r.item for r in scans.judge(items, lexicon).collect()}
    assert not misread & set(names) and len(misread) == 61


def test_weights_are_repeated_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)).round(1)
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    weight = np.where(y == 1, 3, 1)
    weighted = boosting.Booster(rounds=5, bins=500).fit(x, y, weight.astype(float))
    repeated = boosting.Booster(rounds=5, bins=500).fit(np.repeat(x, weight, 0), np.repeat(y, weight))
    assert np.isclose(weighted.base, repeated.base) and np.abs(weighted.probability(x) - repeated.probability(x)).max() < 0.1


def test_edits():
    assert scans.edit("comrnittee", "committee") == (2, 3, "rn>m")
    assert scans.edit("abc", "abc")[0] == 0
    assert scans.shape("THE EASTERN LANTERN.  1901") == "the eastern lantern"


# ---- reading


def test_reading_levels_of_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{folder}/documents.parquet").where("char_length(text) >= 200 AND lang IN ('en', 'zh-Hant')")
    labels = spark.read.parquet(f"{folder}/reading_label.parquet")
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = reading.reading_levels(documents, labels.where(~hidden))
    agreed = labels.where(hidden).groupBy("doc_id").agg(F.min("reading_level").alias("a"), F.max("reading_level").alias("b"), F.count("reading_level").alias("n")).where("n > 1 AND a = b")
    judged = got.join(agreed, "doc_id").agg(F.avg((F.col("reading_level") == F.col("a")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert judged.n > 30 and judged.right > 0.9


def test_words_on_no_list_are_outside_both(spark):
    df = spark.createDataFrame([(1, "The of law quixotry."), (2, "quixotry zyx the the"), (3, "...")], "doc_id bigint, text string")
    got = {r.doc_id: (r.out1, r.out2) for r in reading.demand_features(df, {"latin": {"the": 1, "of": 2, "law": 3}}, reading.LanguageModel([], np.zeros((0, 0)))).collect()}
    assert got == {1: (0.75, 0.5), 2: (0.5, 0.5), 3: (1.0, 0.0)}


def test_languages_are_told_by_trigrams(spark):
    en = "The committee collected donations for the flooded villages while the council agreed to lower the fees."
    de = "Der Ausschuss sammelte Spenden für die überschwemmten Dörfer und der Rat senkte die Gebühren."
    rows_ = [(k, code, text) for k, (code, text) in enumerate([("en", en), ("EN", en), ("eng", en), ("de", de), ("de", de), ("zh", en), ("zh", "女士捐款給水災地方"), ("zh", "學校公布姓名"), (None, de)] * 20)]
    model = reading.language_model(spark.createDataFrame(rows_, "doc_id bigint, lang string, text string"))
    assert sorted(model.names) == ["de", "en"]
    assert [model.language(t) for t in ("the flooded council", "die Gebühren und der Rat", "學校", "カタカナ", "123", "")] == ["en", "de", "zh", "ja", "other", "other"]
    assert reading.language_model(spark.createDataFrame([(1, "x")], "doc_id bigint, text string")).language("der Rat") == "latin"


def test_reading_levels_of_odd_documents(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, LONG, 1), (4, "der Rat", 1)], "doc_id bigint, text string, reading_level int")
    labels = spark.createDataFrame([(3, "r", 2), (4, "r", None), (9, "r", 7)], "doc_id bigint, rater string, reading_level int")
    assert {r.doc_id for r in reading.reading_levels(df, labels).collect()} == {2, 3, 4}
    assert {r.reading_level for r in reading.reading_levels(df, labels.limit(0)).collect()} == {2}


def test_repaired_paragraphs():
    text = "THE LANTERN\nThe comrnittee met in the vil-\nlage hall today.\n\n  A new line be-\ngins here\n- 3 -\nand ends."
    got = scans.repaired(text, {0, 6}, {1: 2, 4: 5}, {("w", "comrnittee"): "committee"})
    assert got == "The committee met in the village hall today.\n\nA new line begins here and ends."
    fixes = {("s", "報己出"): "報已出", ("s", "每□吃"): "每天吃"}
    assert scans.repaired("日報己出\n版。妹妹每■吃飯。", set(), {}, fixes) == "日報已出版。妹妹每天吃飯。"
    assert scans.repaired("", set(), {}, {}) == "" and scans.repaired(" \n ", set(), {}, {}) == ""
    assert scans.repaired("COMRNITTEE,", set(), {}, {("w", "comrnittee"): "committee"}) == "COMMITTEE,"


def test_texts_come_out_repaired(spark):
    scans_ = spark.createDataFrame([("t", "a", "the council ■ road\nand fees"), ("t", "none", None), ("t", "empty", ""), ("u", "a", "one\n\ntwo")], "table_name string, record_id string, text string")
    edited = spark.createDataFrame([("the council road and fees one two " * 9,)], "text string")
    got = {(r.table_name, r.record_id): r.text for r in scans.repaired_texts(scans_, edited).collect()}
    assert got == {("t", "a"): "the council ■ road and fees", ("t", "none"): None, ("t", "empty"): "", ("u", "a"): "one\n\ntwo"}
    assert scans.repaired_texts(scans_.limit(0), edited).count() == 0


def test_headers_of_a_small_source_and_not_of_copies(spark):
    page = scans.Page({"the": 9e4, "council": 5e3}, {}, {}, ())
    body = [f"the council met {k} times\nin the hall of the town\nand went away" for k in range(400)]
    rows_ = [("big", "the council met\n" + b) for b in body] + [("small", "THE MORNING STAR\n" + b) for b in body[:8]]
    rows_ += [("copies", "OUR WONDERFUL PRIZE GIVING\nthe council met\nin the hall\nand left")] * 6
    texts = spark.createDataFrame(rows_, "source string, text string")
    listed, local = scans.header_shapes(texts, page)
    assert "the morning star" in listed or {r.headers for r in local.collect()} == {"the morning star"}
    assert not any("wonderful" in name for name in listed)
    many = texts.unionByName(spark.range(20_000).select(F.lit("big").alias("source"), F.concat(F.lit("a\nb\nc\n"), "id").alias("text")))
    listed, local = scans.header_shapes(many, page)
    assert "the morning star" not in listed and [tuple(r) for r in local.collect()] == [("small", "the morning star")]


def test_likeness_is_the_same_for_many_lines_at_once():
    headers = scans.Headers(["the eastern lantern vol", "東燈日報 第 冊"])
    texts = ["THE EASTERN LANTERN, Vol. 12\nbody text of a line", "", "東■日報　第16冊\n某某", "x" * 300 + "\nThe Eastern Lantem 14"]
    alone = [[headers.likeness(line, range(2)) for line in text.split("\n")] for text in texts]
    assert headers.likenesses(texts, 0.45) == [[like if like >= 0.45 else 0.0 for like in likes] for likes in alone]
    assert scans.Headers([]).likenesses(texts, 0.45) == [[0.0, 0.0], [0.0], [0.0, 0.0], [0.0, 0.0]]
