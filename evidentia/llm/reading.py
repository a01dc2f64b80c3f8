"""Reading level of each document.

Method: a familiar-word formula. The list of familiar words of a language is derived from document
frequencies: words that occur in a fair share of its documents and are at least as frequent in
documents rated plain as in others. The demand of a text follows from the share of its words outside
the list (and outside the longer list of ordinary prose) and from its average sentence length; the
weights of the formula are fitted to the raters' opinions.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import maxent
from evidentia.session import cut
from evidentia.sources.tables import load

#: A listed word occurs in this share of the documents of its language at least. The number of words
#: above it is bounded by the words of an average document over the share, whatever the corpus' size.
MIN_SHARE = 0.004
#: Rated documents that the lists and the formula are fitted to, at most, taken in hash order.
LABELLED = 20_000
LEVELS = 3

#: Runs of letters and their marks.
_RUNS = re.compile("[A-Za-zª-ºÀ-ÖØ-öø-ʯ\u0300-\u1fff\u3005\u3041-\u30ff\u3400-\u9fff\uac00-\ud7ff\uf900-\ufaff]+")
#: What stands between end marks or line ends, from its first character that is not blank.
_SENTENCE = re.compile(r"[^\s.!?。！？…][^.!?。！？…\n]*")

#: Documents that the language model is fitted to, on average, and the share of them that a language
#: code has at least.
LANGUAGE_SAMPLE, LANGUAGE_SHARE = 4_000, 0.01
_SLOTS = 1 << 12
_SCRIPTS = ("other", "latin", "ru", "th", "han", "kana")


@cache
def _script_table() -> np.ndarray:
    """Number of the script of every character of the first planes."""
    table = np.zeros(0x32400, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x32400)]))
    for k, name in enumerate(("Latin", "Cyrillic", "Thai", "Han", "Hiragana", "Katakana"), 1):
        for m in regex.finditer(rf"\p{{{name}}}+", text):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = min(k, 5)
    return table


def script(text: str) -> str:
    """Script of evenly spaced characters: a language where the script tells it, else ``latin`` or
    ``other``."""
    spread = np.frombuffer(text[:: max(1, len(text) // 128)].encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = dict(zip(_SCRIPTS, np.bincount(_script_table()[np.minimum(spread, 0x323FF)], minlength=6).tolist(), strict=True))
    del counts["other"]
    japanese = counts["kana"] * 20 > counts["han"]
    counts["ja" if japanese else "zh"] = counts.pop("han") + counts.pop("kana")
    top = max(counts, key=counts.__getitem__)
    return top if counts[top] else "other"


def _trigrams(text: str) -> np.ndarray:
    """Slots of all hashed triples of neighbouring characters."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1]) * np.uint32(0x85EBCA6B) + codes[2:]) >> np.uint32(20)


class LanguageModel(NamedTuple):
    """Logarithmic odds of the trigrams of each language of Latin script."""

    names: list[str]
    odds: np.ndarray

    def language(self, text: str) -> str:
        """By script, for Latin script by the trigrams of the whole text; the ``lang`` column is not
        trusted for any single document."""
        top = script(text)
        if top != "latin" or len(self.names) < 2:
            return top
        return self.names[int((np.bincount(_trigrams(text), minlength=_SLOTS) @ self.odds).argmax())]


def language_model(documents: DataFrame) -> LanguageModel:
    """Trigram frequencies of the languages that the column ``lang`` names, counted on a sample by
    digest. A code counts by its first two letters, as ``EN`` or ``eng``; codes that few documents
    have are left out, and a code whose text is that of a more frequent one is one with it, so wrong
    and odd codes do no harm. Without the column there is one language."""
    if "lang" not in documents.columns:
        return LanguageModel([], np.zeros((_SLOTS, 0)))
    texts = documents.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.lower(F.substring("lang", 1, 2)).alias("lang"), "text")
    share = min(1.0, LANGUAGE_SAMPLE / max(1, texts.count()))
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    schema = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, np.ndarray] = {}
            documents_of: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                documents_of[lang, -2] += 1
                if script(text) == "latin":
                    documents_of[lang, -1] += 1
                    seen = np.bincount(_trigrams(text), minlength=_SLOTS)
                    counts[lang] = counts.get(lang, 0) + seen
            rows = [(lang, slot, n) for (lang, slot), n in documents_of.items()]
            rows += [(lang, int(slot), int(seen[slot])) for lang, seen in counts.items() for slot in np.flatnonzero(seen)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, schema, strict=True)], schema=schema)

    counted = cut(sample.select("lang", "text").mapInArrow(run, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    per_code = counted.where("slot < 0").groupBy("lang").agg(F.max(F.when(F.col("slot") == -1, F.col("n"))).alias("n"), F.max(F.when(F.col("slot") == -2, F.col("n"))).alias("whole"))
    per_code = per_code.where("2 * n > whole")  # else it is a language of another script, on wrong documents
    sizes = {r.lang: r.n for r in per_code.orderBy(F.desc("n"), "lang").limit(int(1 / LANGUAGE_SHARE)).collect()}
    usual = [lang for lang, n in sizes.items() if n >= LANGUAGE_SHARE * sum(sizes.values())]
    rows = counted.where(F.col("lang").isin(usual) & (F.col("slot") >= 0)).toPandas()  # at most one row for each code and slot
    profiles: dict[str, np.ndarray] = {}
    for lang in usual:
        own = rows[rows.lang == lang]
        profile = np.bincount(own.slot.to_numpy(), own.n.to_numpy(float), _SLOTS)
        like = next((k for k, p in profiles.items() if (p @ profile) / np.sqrt((p @ p) * (profile @ profile)) > 0.9), None)
        profiles[like or lang] = profile + profiles.get(like, 0)
    smooth = {lang: np.log((p + 0.5) / (p.sum() + 0.5 * _SLOTS)) for lang, p in profiles.items()}
    return LanguageModel(list(smooth), np.stack(list(smooth.values()), 1) if smooth else np.zeros((_SLOTS, 0)))


def words_of(text: str) -> list[str]:
    """Words in lower case; in scripts without spaces, pairs of neighbouring characters."""
    words: list[str] = []
    for run in _RUNS.findall(text.lower()):
        if run[0] >= "぀" or "฀" <= run[0] <= "๿":
            words += map(add, run, run[1:]) if len(run) > 1 else [run]
        else:
            words.append(run)
    return words


def _sentence_words(text: str, n_words: int) -> float:
    return n_words / max(1, len(_SENTENCE.findall(text)))


def document_frequencies(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """``lang, word, docs, docs_1 .. docs_3`` of ``text, level`` (level may be null): document
    frequencies over all texts and over those rated 1 to 3. The word '' counts the documents."""
    names = ["docs", *[f"docs_{k + 1}" for k in range(LEVELS)]]
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), *[(n, pa.int64()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, int], Counter] = defaultdict(Counter)
            for text, level in zip(batch.column("text"), batch.column("level").to_pylist(), strict=True):
                text = text.as_py()
                words, lang = words_of(text), model.language(text)
                counts[lang, level or 0].update({*words, ""})
            merged: dict[tuple[str, str], list[int]] = {}
            for (lang, level), words in counts.items():
                for word, n in words.items():
                    row = merged.setdefault((lang, word), [0] * (LEVELS + 1))
                    row[0] += n
                    if level:
                        row[level] += n
            columns = [[k[0] for k in merged], [k[1] for k in merged], *zip(*merged.values(), strict=True)] if merged else [[]] * (LEVELS + 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    partial = texts.select("text", "level").mapInArrow(run, "lang string, word string, " + ", ".join(f"{n} bigint" for n in names))
    return partial.groupBy("lang", "word").agg(*[F.sum(n).alias(n) for n in names])


def familiar_words(frequencies: DataFrame, min_share: float = MIN_SHARE) -> dict[str, dict[str, int]]:
    """Per language the listed words with the level up to which they are familiar: 1 if plain
    documents use them at least as often as others, 2 if plain and ordinary ones do, else 3."""
    totals = frequencies.where("word = ''").select("lang", *[F.col(n).alias(f"n{k}") for k, n in enumerate(["docs", "docs_1", "docs_2", "docs_3"])])
    listed = frequencies.where("word <> ''").join(F.broadcast(totals), "lang").where(F.col("docs") >= F.col("n0") * min_share)
    lists: dict[str, dict[str, int]] = defaultdict(dict)
    for row in listed.toLocalIterator():  # bounded by min_share
        rate = [(row[f"docs_{k}"] + 0.5) / (row[f"n{k}"] + 1.0) for k in (1, 2, 3)]
        lists[row.lang][row.word] = 1 + int(np.argmax(rate))
    return dict(lists)


_FEATURES = "doc_id bigint, lang string, out1 double, out2 double, length double"


def demand_features(documents: DataFrame, lists: dict[str, dict[str, int]], model: LanguageModel) -> DataFrame:
    """``doc_id, lang, out1, out2, length``: the share of words outside the list of plain words and
    outside the list of ordinary words, and the logarithm of the words per sentence."""
    lists_of = documents.sparkSession.sparkContext.broadcast(lists)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("out1", pa.float64()), ("out2", pa.float64()), ("length", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column("text"):
                text = text.as_py()
                words, lang = words_of(text), model.language(text)
                levels = list(map(lists_of.value.get(lang, {}).get, words))
                all_words = max(1, len(words))
                rows.append((lang, 1 - levels.count(1) / all_words, (levels.count(3) + levels.count(None)) / all_words, float(np.log1p(_sentence_words(text, len(words))))))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(run, _FEATURES)


def rated(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``doc_id, level``: the median opinion (the lower on ties) on at most ``limit`` documents;
    null levels and levels off the scale are no opinions."""
    opinions = labels.where(F.col("reading_level").between(1, LEVELS)).groupBy("doc_id").agg(F.percentile("reading_level", F.lit(0.5)).alias("m"))
    return opinions.select("doc_id", F.floor("m").cast("int").alias("level")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def reading_levels(documents: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``doc_id, reading_level`` (1 to 3) of every document with a text that is not null. The
    document frequencies are those of ``corpus``, by default of the documents themselves.

    Texts without words get the level of an average text of their language. Without any label all
    documents have level 2. Repeated rows are kept as they come.
    """
    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    known = cut(rated(labels))
    if known.isEmpty():
        return texts.select("doc_id", F.lit(2).alias("reading_level"))
    whole = documents if corpus is None else corpus
    counted = whole.select("doc_id", "text").where("text IS NOT NULL")
    model = language_model(whole)
    # read twice, for the sums and for the words, but counted once; known has at most LABELLED rows
    frequencies = cut(document_frequencies(counted.join(F.broadcast(known), "doc_id", "left"), model))
    lists = familiar_words(frequencies)
    features = cut(demand_features(texts, lists, model))
    parts = ["out1", "out2", "length"]
    stats = features.groupBy("lang").agg(*[f(c).alias(f"{n}_{c}") for c in parts for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = features.join(F.broadcast(stats), "lang").select(  # one row per language
        "doc_id", *[F.when(F.col(f"s_{c}") > 1e-9, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0).alias(c) for c in parts]
    )
    sample = scaled.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).toPandas()
    weights = maxent.fit(sample[parts].to_numpy(), sample.level.to_numpy(int) - 1, LEVELS)
    scores = [sum((F.col(c) * float(weights[i, k]) for i, c in enumerate(parts)), F.lit(float(weights[-1, k]))) for k in range(LEVELS)]
    best = F.greatest(*scores)
    level = F.when(scores[1] >= best, 2).when(scores[0] >= best, 1).otherwise(3)
    return scaled.select("doc_id", level.cast("int").alias("reading_level"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = load(spark, folder, "documents")
    asked = documents.where(
        (F.char_length("text") >= 200) & (F.col("variant") != "normalized_search") & ~F.col("page_genre").eqNullSafe("table_market_schedule")
    )
    return reading_levels(asked, load(spark, folder, "reading_label"), documents)


QUERIES = {"p10_found": p10_found}
ORACLE: dict[str, str] = {}
