"""Sentence boundaries across languages and scripts.

Method: candidate boundaries (end marks with their closing quotes, line ends, spaces of scripts
that part sentences by spaces) are classified by a maximum-entropy model on the tokens next to
them, case, length, digits, script, quotation and line layout. The model is trained on boundaries
that are reliable by themselves, such as the ends of paragraphs and marks within numbers or before
small letters. Frequencies of abbreviations, of openings and of endings are counted over all
documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import mul
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import maxent
from evidentia.session import cut
from evidentia.sources.tables import load

#: Documents (on average, by digest) and candidates (at most) that the model is fitted to.
SAMPLE_DOCUMENTS, SAMPLE_CANDIDATES = 2_000, 40_000
#: Listed abbreviations, openings and endings make up at least this share of all of their kind.
MIN_SHARE = 2e-5

_BLANK = regex.compile(r"[^\S\n]*\n(?:[^\S\n]*\n)+\s*")
_MARKS = r"[.!?。！？…．⋯‥।؟]"
_CANDIDATE = regex.compile(
    rf"(?P<mark>{_MARKS}+)(?P<close>(?:\s?»|[\"”’'」』）)\]“])*)(?P<gap>\s*)"
    r"|(?P<line>[^\S\n]*\n\s*)"
    r"|(?P<space>(?<=[\p{Thai}0-9”\"’)])[ \xa0]+(?=[\p{Thai}“\"‘(])|(?<=[\p{Han}\p{Hiragana}\p{Katakana}」』])　+(?=[\p{Han}\p{Hiragana}\p{Katakana}「『《]))"
)
_QUOTES = regex.compile("[「」『』“”„«»\"]")
_PAIRS = {"「": "」", "『": "』", "“": "”", "„": "“", "«": "»"}
_ABBREVIATION = re.compile(r"(?<![^\W\d_])([^\W\d_]{1,6})(?=(\.?))(?![^\W\d_])")
_LAST_WORD = regex.compile(r"(?<![\p{L}\p{M}])(\p{L}{1,6})\.[”’\"'」』）)»\s]*$")
_MARKED = re.compile(r"[.!?。！？]")
#: White space and punctuation.
_BETWEEN = frozenset(char for char in map(chr, [*range(0xD800), *range(0xE000, 0x12000)]) if char.isspace() or unicodedata.category(char)[0] == "P")
_TOKEN_END = regex.compile(r"(?r)[\p{L}\p{M}]+|[0-9]+|.")


class Corpus(NamedTuple):
    """Of short words the logarithmic odds of a period and of ending a paragraph with it, beside what
    is usual; frequencies of openings and of endings."""

    abbreviations: dict[str, tuple[float, float]]
    openings: dict[str, float]
    endings: dict[str, float]


NOTHING = Corpus({}, {}, {})


def abbreviation_odds(n: int, dotted: int, final: int) -> tuple[float, float]:
    return math.log((dotted + 0.5) / (n - dotted + 0.5)), math.log((final + 0.3) / (0.02 * dotted + 0.3))


#: Of a word that is not listed: it may well end a sentence.
_UNKNOWN = (-1.5, 0.5)


def _opening(text: str) -> str:
    k, size = 0, min(12, len(text))
    while k < size and text[k] in _BETWEEN:
        k += 1
    return text[k : min(k + (2 if text[k : k + 1] >= "฀" else 3), size)]


def _ending(text: str) -> str:
    k, least = len(text), max(0, len(text) - 12)
    while k > least and text[k - 1] in _BETWEEN:
        k -= 1
    return text[max(least, k - 3) : k]


def corpus_counts(texts: DataFrame) -> DataFrame:
    """``kind, item, n, dotted, final`` over all texts: short words (kind w), with how many of them
    have a period and how many end a paragraph with it, openings (o) and endings (e) of paragraphs. The item '' has the sum of a kind."""
    schema = pa.schema([("kind", pa.string()), ("item", pa.string()), ("n", pa.int64()), ("dotted", pa.int64()), ("final", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            final: Counter = Counter()
            ends: Counter = Counter()
            for text in batch.column("text"):
                text = text.as_py()
                found.update(_ABBREVIATION.findall(text))
                for part in _BLANK.split(text):
                    if part and not part.isspace():
                        ends["o", _opening(part)] += 1
                        ends["e", _ending(part)] += 1
                        if last := _LAST_WORD.search(part.rstrip()[-48:]):
                            final[last[1]] += 1
            words: Counter = Counter()
            for (word, _), n in found.items():
                words[word] += n
            rows = [("w", w, n, found[w, "."], final[w]) for w, n in words.items()] + [(k, w, n, 0, 0) for (k, w), n in ends.items() if w]
            rows += [("w", "", sum(words.values()), 0, 0), *[(k, "", sum(n for (x, _), n in ends.items() if x == k), 0, 0) for k in "oe"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    partial = texts.select("text").mapInArrow(run, "kind string, item string, n bigint, dotted bigint, final bigint")
    return partial.groupBy("kind", "item").agg(F.sum("n").alias("n"), F.sum("dotted").alias("dotted"), F.sum("final").alias("final"))


def corpus_of(counts: DataFrame) -> Corpus:
    """The listed items; their number is bounded by the share each of them has at least."""
    sums = counts.where("item = ''").select("kind", F.col("n").alias("total"))
    out = Corpus({}, {}, {})
    for r in counts.where("item <> ''").join(F.broadcast(sums), "kind").where(F.col("n") >= F.greatest(F.lit(3.0), F.col("total") * MIN_SHARE)).toLocalIterator():
        if r.kind == "w":
            out.abbreviations[r.item] = abbreviation_odds(r.n, r.dotted, r.final)
        else:
            (out.openings if r.kind == "o" else out.endings)[r.item] = math.log(1 + r.n / r.total * 1e4)
    return out


def _quotations(text: str) -> list[tuple[int, int]]:
    """Quotations of a paragraph, outermost only, as (position of the opening, of the closing mark)."""
    spans, opened, closing = [], -1, ""
    for match in _QUOTES.finditer(text):
        char = match[0]
        if opened >= 0:
            if char == closing or (closing == "“" and char in "”\""):
                spans.append((opened, match.start()))
                opened = -1
        elif char in _PAIRS or char == '"':
            opened, closing = match.start(), _PAIRS.get(char, '"')
    return spans


FEATURES = (
    "period", "exclaim", "full stop of han", "ellipsis", "no gap", "space", "line end", "thai space", "ideographic space", "end of text",
    "upper next", "lower next", "digit next", "opening quote next", "letter without case next", "other next", "line end without mark", "line end after mark", "dash next",
    "digit before", "initial before", "abbreviation odds", "ends paragraphs", "short before", "closed quotation", "closed after colon", "number around",
    "line fits", "lines vary", "tab", "opening", "ending", "marked text", "quotation runs on", "wrapped line",
)
#: So many features follow from the mark, the gap and the next character alone.
_STILL = FEATURES.index("digit before")
_ELLIPSES = frozenset("…⋯‥")


@lru_cache(maxsize=1 << 16)
def _still(kind: str, mark: str, gap: str, nxt: str) -> tuple[tuple[float, ...], bool, bool, bool, bool]:
    """The features that follow from these alone (few different ones, whatever the texts), and whether
    the mark is an ellipsis and the next character upper, lower or without case."""
    first, end = mark[:1], "\n" in gap
    upper, lower = nxt.isupper(), nxt.islower()
    caseless = nxt.isalpha() and not upper and not lower
    dots = mark == "..." or (mark != "" and set(mark) <= _ELLIPSES) or (len(mark) > 1 and set(mark) <= _ELLIPSES | {"."})
    opens = nxt != "" and nxt in "「『“„«\"《‘(（"
    features = (
        mark == ".", mark != "" and first in "!?！？", mark != "" and first in "。．", dots,
        kind == "mark" and not gap, kind == "mark" and gap != "" and not end, end,
        kind == "space" and "　" not in gap, kind == "space" and "　" in gap, not nxt,
        upper, lower, nxt.isdigit(), opens, caseless, nxt != "" and not nxt.isalnum() and not opens and nxt not in "—–-",
        kind == "line", kind == "mark" and end, nxt != "" and nxt in "—–-",
    )
    return tuple(map(float, features)), dots, upper, lower, caseless


def candidates(text: str, corpus: Corpus, labelled: bool = True) -> Iterator[tuple[int, tuple[float, ...], list[float], int]]:
    """``(end of unit, features, more features, label)`` of each candidate. The label is 1 for a reliable boundary,
    0 for a reliable continuation and -1 where only the model can tell (or if it is not asked for). Blank lines are boundaries
    by themselves and are no candidates; marks inside a quotation are none either, for a sentence
    runs on around it."""
    if not text or text.isspace():
        return
    lines = text.split("\n")
    lengths = [len(line.rstrip()) for line in lines]
    filled = sorted(n for n in lengths if n)
    width = filled[-1] if len(filled) < 12 else filled[int(0.9 * (len(filled) - 1))]  # some lines may stick out
    tight = [  # whether the first word of the next line would not have fitted into the line
        lengths[k] + 1 + (len(nxt.split(" ", 1)[0]) if (nxt := lines[k + 1].strip()) and nxt[0] < "฀" else 2) > width
        for k in range(len(lines) - 1)
    ]
    inner = [k for k in range(len(lines) - 1) if lengths[k] and lines[k + 1].strip()]
    loose = sum(not tight[k] for k in inner) / max(1, len(inner))
    starts = [0]
    for line in lines[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    begin = 0
    for stop, after in [*((m.start(), m.end()) for m in _BLANK.finditer(text)), (len(text), len(text))]:
        part = text[begin:stop]
        quotes = _quotations(part)
        opened = [a for a, _ in quotes]
        marked = bool(_MARKED.search(part))
        for m in _CANDIDATE.finditer(part):
            kind = m.lastgroup if m.lastgroup in ("line", "space") else "mark"
            end = m.end("close") if kind == "mark" else m.start()
            if kind != "mark" and (end == 0 or part[:end].isspace()):
                continue
            q = bisect_right(opened, m.start()) - 1
            inside = q >= 0 and m.start() < quotes[q][1]
            closes = kind == "mark" and inside and quotes[q][1] < end
            if inside and not closes:
                continue
            after_quote = q >= 0 and not inside and part[quotes[q][1] + 1 : m.start()].strip() == "" and kind != "mark"
            gap = m["gap"] if kind == "mark" else m[0]
            nxt = part[m.end() : m.end() + 1]
            token = _TOKEN_END.search(part, max(0, m.start() - 24), m.start())
            word = token[0] if token else ""
            mark = m["mark"] or ""
            line_no = bisect_right(starts, begin + end - 1) - 1 if "\n" in gap else -1
            fits = float(line_no >= 0 and line_no < len(tight) and not tight[line_no])
            colon = float((closes or after_quote) and part[: quotes[q][0]].rstrip()[-1:] in (":", "：", ","))
            digits = word.isdigit()
            number = float(digits and not gap and len(mark) == 1 and nxt.isdigit())
            still, dots, upper, lower, caseless = _still(kind, mark, gap, nxt)
            odds, ends = corpus.abbreviations.get(word, _UNKNOWN) if mark == "." else _UNKNOWN
            opening, ending = corpus.openings.get(_opening(part[m.end() : m.end() + 12]), 0.0), corpus.endings.get(_ending(part[max(0, end - 12) : end]), 0.0)
            runs_on = closes and not colon and caseless and not gap
            if mark == ".":
                letters = word.isalpha()
                before = [digits, letters and len(word) == 1, max(-3.0, min(4.0, odds)) / 2, max(-3.0, min(1.0, ends)), letters and len(word) <= 3]
            else:
                before = [digits, 0.0, 0.0, 0.0, 0.0]
            moving = [
                *before, closes, colon, number, fits, loose if line_no >= 0 else 0.0, line_no >= 0 and "\t" in lines[line_no],
                opening / 4, ending / 4, marked, runs_on, kind == "line" and not fits and loose < 0.3,
            ]
            label = -1
            if not labelled:
                pass
            elif kind == "mark":
                if not nxt:
                    label = 1
                elif number or lower or nxt in ",;:，；：、" or (closes and nxt in "—–"):
                    label = 0
                elif dots and caseless and not gap:
                    label = 0
                elif runs_on:
                    label = 0  # the sentence of the quotation runs on
                elif not closes and mark[:1] in "。！？!?" and (caseless or (upper and gap)):
                    label = 1
                elif upper and mark == "." and digits and gap:  # an ordinal, or a number at the end
                    label = int(opening > 0)
                elif upper and mark == "." and gap and "\n" not in gap and odds > 2 and ends < -1:
                    label = 0
                elif upper and mark == "." and (len(word) > 6 or ends > 0.3 and word.isalpha() and len(word) > 1):
                    label = 1
            elif kind == "line":
                if "\t" in lines[line_no] or (fits and loose > 0.5):
                    label = 1
                elif not fits and loose < 0.3 and len(inner) > 2:
                    label = 0
            elif opening and ending:
                label = 1
            yield begin + end, still, moving, label
        begin = after


def units(text: str, corpus: Corpus, weights: np.ndarray) -> list[tuple[int, int]]:
    """Sentence units ``[start, end)`` of a text, without outer white space; together they cover
    everything but white space. Blank texts have none."""
    if not text or text.isspace():
        return []
    *margin, bias = (weights[:, 1] - weights[:, 0]).tolist()  # two classes: the sign of the difference decides
    first, rest = margin[:_STILL], margin[_STILL:]
    scores: dict[tuple[float, ...], float] = {}
    ends = [m.start() for m in _BLANK.finditer(text)] + [len(text)]
    for end, still, moving, _ in candidates(text, corpus, labelled=False):
        if (score := scores.get(still)) is None:
            score = scores[still] = sum(map(mul, still, first)) + bias
        if score + sum(map(mul, moving, rest)) >= 0:
            ends.append(end)
    out, start = [], 0
    for end in sorted(set(ends)):
        piece = text[start:end]
        bare = piece.lstrip()
        if bare:
            out.append((end - len(bare), start + len(piece.rstrip())))
        start = end
    return out


def train(texts: DataFrame, corpus: Corpus) -> np.ndarray:
    """Weights fitted to the reliable candidates of a bounded sample of documents."""
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, texts.count()))  # taken by digest, without a shuffle of texts
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int32()), ("label", pa.int32()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                rows = [(doc, end, label, list(map(float, (*still, *moving)))) for end, still, moving, label in candidates(text.as_py(), corpus) if label >= 0]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    labelled = sample.mapInArrow(run, "doc_id bigint, place int, label int, features array<double>")
    rows = labelled.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(SAMPLE_CANDIDATES).select("label", "features").toPandas()
    if rows.empty:
        return np.zeros((len(FEATURES) + 1, 2))
    y = rows.label.to_numpy(int)
    return maxent.fit(np.array(rows.features.tolist()), y, 2, rounds=600, ridge=1e-4)


def sentence_units(documents: DataFrame) -> DataFrame:
    """``doc_id, sent_start, sent_end`` of every document: 0-based, end-exclusive code points.

    Null, empty and blank texts have no units. Repeated rows give repeated units; other columns are
    not read. Without reliable boundaries to train on, every candidate is a boundary.
    """
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    corpus = corpus_of(cut(corpus_counts(texts)))
    weights = train(texts, corpus)
    schema = pa.schema([("doc_id", pa.int64()), ("sent_start", pa.int32()), ("sent_end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, starts, ends = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for a, b in units(text.as_py(), corpus, weights):
                    docs.append(doc)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], schema=schema)

    return texts.mapInArrow(run, "doc_id bigint, sent_start int, sent_end int")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = load(spark, folder, "documents")
    return sentence_units(documents.where(F.col("variant").isin("corrected_transcription", "approved_reconstruction")))


QUERIES = {"p4_found": p4_found}
ORACLE: dict[str, str] = {}
