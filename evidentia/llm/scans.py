"""Noise in text from scanned pages.

Method: the lines of a text are classified in pairs with their neighbours: furniture of the page
(running headers, page numbers) is told from the body, and line ends within a word are told from
those between words. What is left of the body is compared with the edited texts of the corpus:
words that those do not have (in scripts without spaces, characters with both neighbours) retrieve
correction candidates through inverted joins on character q-grams, and gradient-boosted trees rank
the candidates and decide whether the text was misread.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add, mul
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import maxent
from evidentia.llm.boosting import Booster
from evidentia.llm.names import similar_tokens
from evidentia.session import cut
from evidentia.sources.tables import current, load

#: A word or sequence that is sent to all workers makes up at least this share of all of its kind,
#: which bounds their number; rarer ones are found by a join.
LEXICON_SHARE = 4e-6
#: A header repeats in at least this share of all texts, or of the texts of its source.
HEADER_SHARE, SOURCE_SHARE = 5e-4, 0.05
#: Share of texts of a header over the frequency per million of its rarest word, at least.
RARER = 4e-4
#: Similarity of the q-grams of a word and its correction.
SIMILAR = 0.33
#: Labelled candidate pairs that the trees are fitted to and lines that the line models are fitted to,
#: at most; texts that the lines come from, on average.
SAMPLE_PAIRS, SAMPLE_LINES, SAMPLE_TEXTS = 30_000, 30_000, 3_000
#: A misreading changes a stretch of at most so many characters.
STRETCH = 3
#: Sources with headers of their own that may be broadcast (some 200 bytes each).
SOURCES = 50_000

_PAGE = regex.compile(
    r"\s*(?:[-–—~·\[(（【«]{1,2}\s*)?(?:第\s*)?(?:p(?:age|\.)?\s*|S\.\s*|стр\.\s*|с\.\s*|หน้า\s*)?"
    r"(?P<n>[0-9０-９][0-9０-９lIOoSBZ]{0,3}|[lIOo][0-9]{1,3}|[〇一二三四五六七八九十百零]{1,5}|[๐-๙]{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})"
    r"\s*(?:[頁页]\s*)?(?:[-–—~·\])）】»]{1,2})?\s*"
)
_EDGE_PAGE = regex.compile(
    r"(?:[-–—\[(（]\s*[0-9０-９lIOo〇一二三四五六七八九十百]{1,5}\s*[-–—\])）]|第\s*[0-9０-９〇一二三四五六七八九十百]{1,5}\s*[頁页]|p\.\s*[0-9]{1,4}|(?:^|(?<=\s))[0-9]{1,4}(?=\s|$)"
    r"|^\s*(?:[〇一二三四五六七八九十百零]{1,5}|[ivxlc]{1,7}|[IVXLC]{1,7})(?=\s)|(?<=\s)(?:[〇一二三四五六七八九十百零]{1,5}|[ivxlc]{1,7}|[IVXLC]{1,7})\s*$)"
)


def _ranges(pattern: str) -> str:
    """The characters that ``pattern`` matches as ranges for the plain regular expressions, which are
    faster than those with properties."""
    return "".join(f"{m[0][0]}-{m[0][-1]}" for m in regex.finditer(f"{pattern}+", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x32400)]))))


_SCRIPTS = _ranges(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー々]")
_UNSPACED = re.compile(f"[{_SCRIPTS}]")
_RUN = re.compile(f"[{_SCRIPTS}]+")
_WORDS = re.compile(f"[^\\s{_SCRIPTS}]+")
_NOT_RUN = re.compile(f"[^{_SCRIPTS}]+")
_LONG_S = "ſ"
_TOKEN = regex.compile(r"\S+")
_LOST_MARKS = frozenset("□■▪▯�")
_LOST_BETWEEN = re.compile(f"(?<=([{_SCRIPTS}]))[□■▪▯�](?=([{_SCRIPTS}]))")
_STRIP = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_HYPHENS = "-¬‐‑\xad"
_NUMBER = regex.compile(r"\d+|(?<=第)[〇一二三四五六七八九十百]+")
_NO_WORD = regex.compile(r"[^\p{L}\p{M}'-]+|(?<!\p{L})['-]+|['-]+(?!\p{L})")
_SENTENCE_END = regex.compile(r"[.,;。，！？]\s*$")
_LETTER = regex.compile(r"\p{L}")


def shape(line: str) -> str:
    """What repeats of a header: letters in small case, without numbers."""
    return _NO_WORD.sub(" ", _NUMBER.sub(" ", line.replace("’", "'")).casefold()).strip()


def core(token: str) -> str:
    """A token without punctuation around it, in small case."""
    return _STRIP.sub("", token.replace("’", "'")).casefold()


def count_sequences(runs: list[str], counts: Counter) -> None:
    """Counts the characters of unspaced runs with both neighbours; ``^`` and ``$`` stand at the ends
    of a run."""
    if not runs:
        return
    codes = np.frombuffer(f"^{'$^'.join(runs)}$".encode("utf-32-le"), np.uint32).astype(np.uint64)
    inside = (codes[:-2] != ord("$")) & (codes[1:-1] != ord("$"))
    keys, n = np.unique(((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[inside], return_counts=True)
    low = np.uint64((1 << 21) - 1)
    triples = np.stack([keys >> np.uint64(42), (keys >> np.uint64(21)) & low, keys & low], 1).astype(np.uint32)
    text = triples.tobytes().decode("utf-32-le")
    for k, times in enumerate(n.tolist()):
        counts[text[3 * k : 3 * k + 3]] += times


def lexicon_counts(texts: DataFrame) -> DataFrame:
    """``kind, item, n`` of edited texts: words (w), sequences (s) and pairs of characters (p); ''
    has the sum of a kind."""
    schema = pa.schema([("kind", pa.string()), ("item", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: Counter = Counter()
            parts: Counter = Counter()
            runs: list[str] = []
            size = 0
            for text in batch.column("text"):
                text = text.as_py()
                if _UNSPACED.search(text):
                    found = _RUN.findall(text.replace("\n", ""))
                    runs += found
                    size += sum(map(len, found))
                    raw.update(_WORDS.findall(text))
                    if size > 1 << 20:
                        count_sequences(runs, parts)
                        runs, size = [], 0
                else:
                    raw.update(text.split())
            count_sequences(runs, parts)
            words: Counter = Counter()
            for token, n in raw.items():
                words[core(token)] += n
            del words[""]
            pairs: Counter = Counter()  # every pair begins one sequence, the last of a run ends one
            for part, n in parts.items():
                pairs[part[:2]] += n
                if part[2] == "$":
                    pairs[part[1:]] += n
            rows = [("w", w, n) for w, n in words.items()] + [("s", w, n) for w, n in parts.items()] + [("p", w, n) for w, n in pairs.items()]
            rows += [("w", "", words.total()), ("s", "", parts.total()), ("p", "", pairs.total())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts.select("text").mapInArrow(run, "kind string, item string, n bigint").groupBy("kind", "item").agg(F.sum("n").alias("n"))


class Page(NamedTuple):
    """What the workers know of the corpus: items of edited texts with their frequency per million of
    their kind, and the shapes of headers that repeat all over the corpus."""

    words: dict[str, float]
    sequences: dict[str, float]
    pairs: dict[str, float]
    headers: tuple[str, ...]


def _body(line: str) -> bool:
    """Neither blank nor only a page number."""
    return bool(line) and not line.isspace() and not _PAGE.fullmatch(line)


def rarest(name: str, page: Page) -> float:
    """Frequency of the rarest word or pair of characters of a line's shape in edited texts, per
    million words (pairs count half, since there are about twice as many)."""
    words = [page.words.get(w, 0.0) for w in _RUN.sub(" ", name).split() if len(w) > 1]
    return min(words + [2 * page.pairs.get(run[k : k + 2], 0.0) for run in _RUN.findall(name) for k in range(len(run) - 1)], default=math.inf)


def header_shapes(texts: DataFrame, page: Page) -> tuple[list[str], DataFrame | None]:
    """Shapes of lines that repeat at the ends of texts of several lines, but have words (or
    sequences) that edited texts use far more rarely.

    First those that repeat in a share ``HEADER_SHARE`` of all texts, a list whose length is bounded
    by that share; then, as ``source, headers`` (one row per source, shapes joined by line ends),
    those that repeat within their source in ``SOURCE_SHARE`` of its texts, so that the header of a
    small paper is found in a corpus of any size. None if no source has any.
    """
    schema = pa.schema([("source", pa.string()), ("shape", pa.string()), ("edge", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edge: dict[tuple[str | None, str], list[int]] = {}
            for source, text in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = text.split("\n")
                if len(lines) >= 4:
                    first = next(filter(_body, lines), "")
                    ends = [line for line in lines[:-6:-1] if _body(line)][:2]
                    names = {"*"}
                    # what begins or ends within a word is body
                    if first and first.rstrip()[-1] not in _HYPHENS:
                        names.add(shape(_EDGE_PAGE.sub(" ", first)))
                    if len(ends) == 2 and ends[1].rstrip()[-1] not in _HYPHENS:
                        names.add(shape(_EDGE_PAGE.sub(" ", ends[0])))
                    inner = zlib.crc32("".join(lines[1:-1]).encode("utf-8", "surrogatepass"))
                    for name in names:
                        row = edge.setdefault((source, name), [0, inner, inner])
                        row[:] = row[0] + 1, min(row[1], inner), max(row[2], inner)
            columns = [[k[0] for k in edge], [k[1] for k in edge], *zip(*edge.values(), strict=True)] if edge else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    sums = F.sum("edge").alias("edge"), F.min("low").alias("low"), F.max("high").alias("high")
    counts = texts.select("source", "text").mapInArrow(run, "source string, shape string, edge bigint, low bigint, high bigint").groupBy("source", "shape").agg(*sums)
    counts = cut(counts)
    whole = counts.groupBy("shape").agg(*sums)
    total = whole.where("shape = '*'").agg(F.max("edge")).first()[0] or 0
    usual = (F.char_length("shape") >= 4) & (F.col("low") < F.col("high"))  # not only of copies of one text
    often = whole.where(usual & (F.col("edge") >= max(3.0, total * HEADER_SHARE)))
    listed = sorted(r["shape"] for r in often.toLocalIterator() if RARER * rarest(r["shape"], page) < r["edge"] / total)
    sizes = counts.where("shape = '*' AND source IS NOT NULL").select("source", F.col("edge").alias("texts"))
    share = F.col("edge") / F.col("texts")
    local = counts.where(usual & (F.col("edge") >= 3) & ~F.col("shape").isin(listed)).join(sizes, "source").where(share >= SOURCE_SHARE).select("source", "shape", (share / 4).alias("share"))
    # within a source the sample is small, so the shape must be rarer in edited texts by a further factor
    shared = texts.sparkSession.sparkContext.broadcast(page)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [RARER * rarest(name, shared.value) < part for name, part in zip(batch.column("shape").to_pylist(), batch.column("share").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["source", "shape"])

    own = cut(local.mapInArrow(rare, "source string, shape string").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("shape")), "\n").alias("headers")))
    return listed, None if own.isEmpty() else own


def _margin(weights: np.ndarray | None) -> list[float]:
    """Weights of the second class against the first, with the bias last."""
    return [] if weights is None else (weights[:, 1] - weights[:, 0]).tolist()


def _chosen(features: list[float], margin: list[float]) -> bool:
    return sum(map(mul, features, margin)) + margin[-1] >= 0


_SLOTS = 1 << 14
#: Characters of texts whose lines are compared at once.
_AT_ONCE = 1 << 16
#: Letters and marks.
_LETTERS = np.array([unicodedata.category(chr(code))[0] in "LM" for code in range(0x10000)])


class Headers:
    """Compares the lines of a text with a list of header shapes."""

    def __init__(self, names: list[str]):
        self.names = names
        self.grams = [Counter(zip(name, name[1:])) for name in names]
        self.sizes = np.array([len(name) for name in names], float)
        # a page number beside a header has no more than so many characters
        self.longest = max(map(len, names), default=0) * 5 // 4 + 14
        self.table = np.zeros((_SLOTS, len(names)), np.uint8)
        for k, name in enumerate(names):
            codes = np.frombuffer(name.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.table[(codes[:-1] * np.uint32(40503) + codes[1:]) & np.uint32(_SLOTS - 1), k] = 1  # slots of pairs of neighbours
        self.cache: dict[str, float] = {}

    def likeness(self, line: str, near: list[int] | range) -> float:
        """Similarity to the most similar of the headers ``near``, leaving out a page number: the
        share of common pairs of characters, counted with repetition."""
        if (known := self.cache.get(line)) is not None:
            return known
        if len(self.cache) > 20_000:
            self.cache.clear()
        own, like = shape(_EDGE_PAGE.sub(" ", line)), 0.0
        if own in self.names:
            like = 1.0
        elif len(own) > 1:
            counted = Counter(zip(own, own[1:]))
            for i in near:
                name, grams = self.names[i], self.grams[i]
                if 3 * len(own) > len(name) and 3 * len(name) > len(own):
                    common = sum([min(counted[pair], grams[pair]) for pair in counted.keys() & grams.keys()])
                    like = max(like, 2 * common / (len(own) + len(name) - 2))
        self.cache[line] = like
        return like

    def likenesses(self, texts: list[str], least: float) -> list[list[float]]:
        """The likeness of each line of each text, 0 where it is below ``least``: what can't reach
        that is told from counts of hashed pairs of characters for many lines at once."""
        out = [[0.0] * (text.count("\n") + 1) for text in texts]
        if not self.names:
            return out
        begin = 0
        while begin < len(texts):
            stop, size = begin, 0
            while stop < len(texts) and (stop == begin or size + len(texts[stop]) <= _AT_ONCE):
                size += len(texts[stop])
                stop += 1
            last, lines = -1, []
            for text, k, near in self._near(texts[begin:stop], least):  # in order, so each text is parted once
                if text != last:
                    last, lines = text, texts[begin + text].split("\n")
                like = self.likeness(lines[k], near)
                out[begin + text][k] = like if like >= least else 0.0
            begin = stop
        return out

    def _near(self, texts: list[str], least: float) -> Iterator[tuple[int, int, list[int]]]:
        """Text, line and headers that may be as similar as ``least``."""
        folded = "\n".join([text.casefold() for text in texts])
        codes = np.frombuffer(f"\n{folded}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = (codes == 10).nonzero()[0]
        size = ends[1:] - ends[:-1]
        short = ((size > 3) & (size <= self.longest + 1)).nonzero()[0]
        if not len(short):
            return
        bounds = np.stack([ends[:-1][short], ends[1:][short]], 1).ravel()  # every other stretch is a short line
        letter = _LETTERS[np.minimum(codes, 0xFFFF)]
        codes = np.where(letter, codes, np.uint32(32))  # as in a shape, where one space stands for what is no letter
        ending = letter[:-1] & ~letter[1:]
        own = np.add.reduceat(letter[:-1].astype(np.uint8) + ending, np.minimum(bounds, len(ending) - 1), dtype=np.int32)[::2, None] - 1
        starts = np.cumsum(size[short]) - size[short]
        where = np.arange(int(size[short].sum())) + np.repeat(bounds[::2] - starts, size[short])
        slots = (codes[where] * np.uint32(40503) + codes[where + 1]) & np.uint32(_SLOTS - 1)
        met = np.minimum(np.add.reduceat(self.table[slots], starts, axis=0, dtype=np.uint8), self.sizes - 1)  # a short line has fewer than 256 pairs, or counts as near
        can = 2 * met >= (least - 0.05) * (own + self.sizes - 2)
        can |= (size[short] > 255)[:, None]
        first = np.cumsum([0] + [text.count("\n") + 1 for text in texts])
        for at in can.any(1).nonzero()[0].tolist():
            line = int(short[at])
            text = int(np.searchsorted(first, line, side="right")) - 1
            yield text, line - int(first[text]), can[at].nonzero()[0].tolist()


_UNSPACED_CHARS: dict[str, bool] = {}


def _unspaced(char: str) -> bool:
    known = _UNSPACED_CHARS.get(char)
    if known is None:
        known = _UNSPACED_CHARS[char] = bool(_UNSPACED.match(char))
    return known


class LineReader:
    """Classifies the lines of one text after another."""

    def __init__(self, page: Page, furniture: np.ndarray | None, joins: np.ndarray | None):
        # two classes: the difference of their weights decides, line by line and without small arrays
        self.page, self.furniture, self.joins = page, _margin(furniture), _margin(joins)
        self.usual = Headers(list(page.headers))
        self.special: dict[str, Headers] = {}
        self.questions: dict[str, str] = {}

    def headers(self, own: str | None) -> Headers:
        """The headers of the corpus and those of a text's own source."""
        if not own:
            return self.usual
        if own not in self.special:
            if len(self.special) >= 32:
                self.special.clear()
            self.special[own] = Headers([*self.page.headers, *own.split("\n")])
        return self.special[own]

    @staticmethod
    def furniture_features(lines: list[str], k: int, likes: list[float], pages: list[bool]) -> list[float]:
        line, like, page, last = lines[k], likes[k], pages[k], len(lines) - 1
        edge = k == 0 or k == last
        near = (k > 0 and pages[k - 1]) or (k < last and pages[k + 1])
        headed = (k > 0 and likes[k - 1] > 0.9) or (k < last and likes[k + 1] > 0.9)
        typical = sorted(map(len, lines))[len(lines) // 2]
        before = lines[k - 1].rstrip()[-1:] if k else ""
        return [
            float(page), like, like**4, float(edge), float(near), min(3.0, len(line) / max(1, typical)), float(line[:1].isspace()),
            float(bool(_SENTENCE_END.search(line))), float(k > 0 and before in "-¬‐"), float(page and edge),
            float(page and near), float(edge and like > 0.6), float(page and headed), float(page and k > 0 and before in _HYPHENS),
        ]

    @staticmethod
    def pages(lines: list[str]) -> list[bool]:
        """Lines that may be page numbers."""
        return [len(line) < 32 and bool(line) and not line.isspace() and bool(_PAGE.fullmatch(line)) for line in lines]

    def is_furniture(self, lines: list[str], likes: list[float]) -> list[str]:
        """'' for body lines, else the kind of furniture; ``likes`` has the likeness of each line to a header."""
        out = [""] * len(lines)
        if self.furniture:
            pages = self.pages(lines)
            for k, (like, page) in enumerate(zip(likes, pages, strict=True)):
                if (page or like > 0.45) and lines[k] and not lines[k].isspace() and _chosen(self.furniture_features(lines, k, likes, pages), self.furniture):
                    out[k] = "running_header" if like > 0.45 else "page_number"
        return out

    def goes_on(self, left: str, right: str) -> bool:
        """Whether the last word of a line goes on in the next. Two known words without a hyphen are
        two words, as the model is taught."""
        features = self.join_features(left, right, sure=True)
        return features is not None and _chosen(features, self.joins)

    def join_features(self, left: str, right: str, sure: bool = False) -> list[float] | None:
        """Features of two consecutive body lines; with ``sure`` none for two known words without a hyphen."""
        a, b = left.rstrip(), right.lstrip()
        hyphen = a[-1:] in _HYPHENS and a[-1:] != ""
        x, y = (a.rstrip(_HYPHENS).rstrip() if hyphen else a).rpartition(" ")[2], b.partition(" ")[0]
        count = self.page.words.get
        if sure and not hyphen and x in self.page.words and y in self.page.words:
            return None
        x, y = core(x), core(y)
        if sure and not hyphen and x in self.page.words and y in self.page.words:
            return None
        own, nxt, both = count(x, 0.0), count(y, 0.0), count(x + y, 0.0) or count(f"{x}-{y}", 0.0)
        log, lower = math.log1p, b[:1].islower()
        return [
            float(hyphen), float(a[-1:] == "-"), float(hyphen and lower), float(lower), log(both) / 4, log(own) / 4, log(nxt) / 4,
            float(not own), float(not nxt), float(both > 0), float(both > 0 and not own), float(both > 0 and not nxt), float(both > 0 and not own and not nxt), min(2.0, len(x) / 6), min(2.0, len(y) / 6),
            float(len(left) > len(a)),
        ]

    @staticmethod
    def joinable(left: str, right: str) -> bool:
        a, first = left.rstrip(), right.lstrip()[:1]
        if not first.isalpha() or _unspaced(first):
            return False
        last = a[-1:]
        if last and last in _HYPHENS:
            bare = a.rstrip(_HYPHENS)
            last = bare.rstrip()[-1:]
            if len(a) - len(bare) > 1:
                return False
        return last.isalpha() and not _unspaced(last)

    def read_all(self, texts: list[str], own: list[str | None]) -> Iterator[tuple[list, list]]:
        """What :meth:`read` finds in each text; ``own`` are the headers of each text's source."""
        likes: list = [None] * len(texts)
        for special in set(own):
            at = [k for k, o in enumerate(own) if o == special]
            for k, found in zip(at, self.headers(special).likenesses([texts[k] for k in at], 0.45), strict=True):
                likes[k] = found
        return map(self.read, texts, likes)

    def _question(self, token: str) -> str:
        """'' for a known token, the item to ask for, or ``_LONG_S`` for a known one with a long s."""
        item = token.casefold() if token.isalpha() else core(token)
        if item not in self.page.words and (item and _LETTER.search(item) or (not item and len(token) > 3)):
            return item or token
        return _LONG_S if "ſ" in token else ""

    def read(self, text: str, likes: list[float]) -> tuple[list[tuple[int, str, int | None]], list[tuple[str, str, int, int, int]]]:
        """Noise that the lines show by themselves, as (line, kind, line that a broken word goes on
        in); and what needs a correction candidate to be judged, as (kind, item, line, next line,
        characters in the first line)."""
        lines, known, questions = text.split("\n"), self.page.words, self.questions
        if len(questions) > 200_000:
            questions.clear()
        kinds = self.is_furniture(lines, likes)
        found: list[tuple[int, str, int | None]] = [(k, kind, None) for k, kind in enumerate(kinds) if kind]
        body = [k for k, line in enumerate(lines) if not kinds[k] and line and not line.isspace()]
        asked: list[tuple[str, str, int, int, int]] = []
        joined: dict[int, int] = {}
        if self.joins:
            joined = {i: j for i, j in zip(body, body[1:]) if self.joinable(lines[i], lines[j]) and self.goes_on(lines[i], lines[j])}
            found += [(i, "broken_word", j) for i, j in joined.items()]
        ends, unspaced = set(joined.values()), bool(_UNSPACED.search(text))
        lost_marks = not _LOST_MARKS.isdisjoint(text)
        runs: list[tuple[list[str], list[int]]] = []  # unspaced text goes on over line ends
        for at, k in enumerate(body):
            line = lines[k]
            if lost_marks and not _LOST_MARKS.isdisjoint(line):
                found.append((k, "misread", None))
                asked += [("s", m[1] + "□" + m[2], k, k, 0) for m in _LOST_BETWEEN.finditer(line)]
            tokens = _WORDS.findall(line) if unspaced else line.split()
            if tokens and k in joined:
                nxt = lines[joined[k]].split()
                if not tokens[-1].strip(_HYPHENS) and len(tokens) > 1:
                    tokens.pop()  # a hyphen by itself
                left, right = tokens.pop().rstrip(_HYPHENS), nxt[0] if nxt else ""
                item = core(left + right)
                if item and item not in known and core(f"{left}-{right}") not in known:
                    asked.append(("w", item, k, joined[k], len(_STRIP.sub("", left))))
            if tokens and k in ends:
                tokens.pop(0)
            for token in tokens:
                if token in known:
                    continue
                question = questions.get(token)
                if question is None:
                    question = questions[token] = self._question(token)
                if question is _LONG_S:
                    found.append((k, "misread", None))
                elif question:
                    asked.append(("w", question, k, k, 0))
            for m in _RUN.finditer(line) if unspaced else ():
                goes_on = runs and at and body[at - 1] == k - 1 == runs[-1][1][-1] and not line[: m.start()].strip() and _unspaced(lines[k - 1].rstrip()[-1:] or " ")
                if goes_on:
                    runs[-1][0].append(m[0])
                    runs[-1][1].extend([k] * len(m[0]))
                else:
                    runs.append(([m[0]], [k] * len(m[0])))
        pairs = self.page.pairs
        for run, where in runs:
            marked = f"^{''.join(run)}$"
            odd = [k for k, pair in enumerate(map(add, marked, marked[1:])) if pair not in pairs]
            for k, after in zip(odd, odd[1:]):  # both pairs of a character are unusual
                if after == k + 1:
                    asked.append(("s", marked[k : k + 3], where[k], where[k], 0))
        return found, asked


def edit(a: str, b: str) -> tuple[int, int, str]:
    """Distance of two words, where they first differ and the difference as 'read>meant'; what
    differs is the stretch between the common beginning and the common end."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    return max(len(x), len(y)), low, f"{x}>{y}"



def _pair_rows(pairs: DataFrame) -> DataFrame:
    """``kind, item, other, stretch, at, difference`` of retrieved pairs."""
    schema = pa.schema([("kind", pa.string()), ("item", pa.string()), ("other", pa.string()), ("stretch", pa.int32()), ("at", pa.int32()), ("difference", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [edit(a, b) for a, b in zip(batch.column("item").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("item"), batch.column("other"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]], schema=schema)

    return pairs.select("kind", "item", "other").mapInArrow(run, "kind string, item string, other string, stretch int, at int, difference string")


def judge(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``kind, item, at, correction`` of items that were misread; ``items`` has ``kind, item, n``
    (how often it was read), ``lexicon`` ``kind, item, n`` of edited texts.

    The trees learn from the corpus itself: items that edited texts never have, against rare items
    that they do have, each with its nearest other items. Habits are rates over all items of both
    sides; only the pairs that the trees are fitted to are sampled, and both sides weigh the same
    there, so that neither depends on the size of the corpus.
    """
    known = lexicon.where("item <> ''").select("kind", "item", F.col("n").alias("known"))
    asked = cut(items.join(known, ["kind", "item"], "left").select("kind", "item", "n", F.coalesce("known", F.lit(0)).alias("known")))
    fresh = asked.where("known = 0").select("kind", "item", "n", F.lit(1).alias("read"))
    pairs = known.where("kind = 'p' AND known > 3").select("item")
    first, last = pairs.select(F.col("item").alias("head")), pairs.select(F.col("item").alias("tail"))
    unusual = known.where("known <= 3 AND kind = 's'").withColumns({"head": F.substring("item", 1, 2), "tail": F.substring("item", 2, 2)})
    unusual = unusual.join(first, "head", "left_anti").join(last, "tail", "left_anti").select("kind", "item", "known")
    rare = known.where("known <= 3 AND kind = 'w'").unionByName(unusual).select("kind", "item", F.col("known").alias("n"), F.lit(0).alias("read"))
    probes = cut(fresh.unionByName(rare))
    targets = known.where("known >= 4")
    words = similar_tokens(
        probes.where("kind = 'w'").select(F.col("item").alias("token")).distinct(), targets.where("kind = 'w'").select(F.col("item").alias("token")), SIMILAR
    ).select(F.lit("w").alias("kind"), F.col("token").alias("item"), "other")
    around = F.concat(F.substring("item", 1, 1), F.substring("item", 3, 1))
    left = probes.where("kind = 's'").select("kind", "item", around.alias("gram")).distinct()
    right = targets.where("kind = 's'").select(F.col("item").alias("other"), around.alias("gram"))
    near = _pair_rows(words.unionByName(left.join(right, "gram").select("kind", "item", "other")).where("item <> other")).where(F.col("stretch") <= STRETCH)
    scored = near.join(targets.select("kind", F.col("item").alias("other"), F.col("known").alias("frequency")), ["kind", "other"])
    # every candidate of an item is judged, and how near and frequent it is among them is a feature; a
    # habit of misreading is told by how many different items show the same difference, read ones
    # against rare ones that are right
    best = Window.partitionBy("kind", "item").orderBy("stretch", F.desc("frequency"), "other")
    ranked = cut(
        scored.withColumn("rank", F.row_number().over(best)).withColumn("candidates", F.count("*").over(Window.partitionBy("kind", "item")))
        .join(probes, ["kind", "item"])
    )
    habits = ranked.groupBy("kind", "difference").agg(F.sum("read").alias("habit"), F.sum(1 - F.col("read")).alias("clean"))
    shares = ranked.where("rank = 1").agg(F.sum("read").alias("all_read"), F.sum(1 - F.col("read")).alias("all_clean"))
    log = F.log1p
    # a pair is no evidence about itself, else every read pair would show a habit that it makes up itself
    habit, clean = (F.col("habit") - F.col("read")) / (F.col("all_read") + 1), (F.col("clean") - (1 - F.col("read"))) / (F.col("all_clean") + 1)
    rows = ranked.join(habits, ["kind", "difference"]).crossJoin(F.broadcast(shares)).select(
        "kind", "item", "other", "at", "read",
        F.array(
            F.col("stretch").cast("double"), F.char_length("item").cast("double"), log("frequency"), F.log(habit + 1e-5), F.log((habit + 1e-5) / (clean + 1e-4)),
            F.col("item").rlike(r"[0-9\p{P}\p{S}]").cast("double"), (F.col("at") == 0).cast("double"), (F.col("kind") == "s").cast("double"),
            log("candidates"), (F.char_length("item") - F.char_length("other")).cast("double"), log("rank"),
        ).alias("features"),
    )
    rows = cut(rows)
    # both sides of a kind weigh the same; a side of few items weighs at most ten times as much as it has,
    # so that no leaf rests on a single one. Lost characters need no judgement and teach nothing.
    told = rows.where(~F.contains("item", F.lit("□")))
    kinds = sorted(r.kind for r in told.select("kind").distinct().collect()) or ["w"]  # words, sequences or both
    sides = [told.where((F.col("kind") == kind) & (F.col("read") == read)).orderBy(F.xxhash64("item", "kind", "other"), "item", "other").limit(SAMPLE_PAIRS // 2 // len(kinds)) for kind in kinds for read in (0, 1)]
    sample = reduce(DataFrame.unionByName, sides).select("kind", "features", "read").toPandas()
    size = sample.groupby(["kind", "read"])["read"].transform("size")
    weight = (sample.groupby("kind")["read"].transform("size") / 2 / size).clip(upper=10.0).to_numpy(float)
    trees = Booster().fit(np.array(sample.features.tolist()).reshape(len(sample), 11), sample.read.to_numpy(float), weight)

    schema = pa.schema([("kind", pa.string()), ("item", pa.string()), ("correction", pa.string()), ("at", pa.int32()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = trees.probability(np.array(batch.column("features").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("item"), batch.column("other"), batch.column("at"), pa.array(p, pa.float64())], schema=schema)

    fresh_rows = rows.where("read = 1").select("kind", "item", "other", "at", "features")
    ranked = fresh_rows.mapInArrow(run, "kind string, item string, correction string, at int, p double")
    top = ranked.groupBy("kind", "item").agg(F.max_by(F.struct("correction", "at", "p"), F.struct("p", "correction")).alias("t"))
    misread = top.select("kind", "item", "t.correction", "t.at", "t.p").where(F.col("p") >= 0.5)
    # words with figures or marks within the letters have been misread even without a candidate
    odd = fresh.where("kind = 'w'").where(F.col("item").rlike(r"\p{L}[0-9!|\[\]{}<>*_=]+\p{L}")).join(top.select("kind", "item"), ["kind", "item"], "left_anti")
    return misread.drop("p").unionByName(odd.select("kind", "item", F.lit(None).cast("string").alias("correction"), F.lit(0).alias("at")))


def _fit_lines(texts: DataFrame, page: Page) -> tuple[np.ndarray, np.ndarray]:
    """The two line models, fitted to pairs of lines that are reliable by themselves: at most
    ``SAMPLE_LINES`` of both kinds, from ``SAMPLE_TEXTS`` texts on average, all taken by digest."""
    share = min(1.0, SAMPLE_TEXTS / max(1, texts.count()))  # without a shuffle of texts
    sample = texts.where(F.pmod(F.xxhash64("record_id"), F.lit(1 << 30)) < share * (1 << 30))
    schema = pa.schema([("model", pa.string()), ("key", pa.string()), ("label", pa.int32()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader(page, None, None)
        for batch in batches:
            rows: list[tuple[str, str, int, list[float]]] = []
            for record, text in zip(batch.column("record_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                lines = text.split("\n")
                (likes,), pages = reader.usual.likenesses([text], 0.2), reader.pages(lines)
                last = len(lines) - 1
                for k, line in enumerate(lines):
                    if not line or line.isspace():
                        continue
                    alone, like, edge = pages[k], likes[k], k in (0, last)
                    if like == 1.0 and len(shape(line)) > 6 or alone and edge and last > 1 and regex.search(r"[-—頁\])）.]|\d\d", line):
                        label = 1
                    elif alone and ((k and likes[k - 1] > 0.9) or (k < last and likes[k + 1] > 0.9)):
                        label = 1
                    elif 0.2 < like < 0.55 or (not edge and like < 0.2 and not alone and k % 7 == 3):
                        label = 0
                    else:
                        continue
                    rows.append(("f", f"{record}/{k}", label, reader.furniture_features(lines, k, likes, pages)))
                for k, (left, right) in enumerate(zip(lines, lines[1:])):
                    if reader.joinable(left, right):
                        f = reader.join_features(left, right)
                        hyphen, low, both, unknown_left, unknown_right = f[0], f[3], f[9], f[7], f[8]
                        label = 1 if (hyphen and low) or (not hyphen and both and unknown_left and unknown_right) else 0 if not hyphen and not unknown_left and not unknown_right else -1
                        if label >= 0:
                            rows.append(("j", f"{record}/{k}", label, f))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    labelled = cut(sample.select("record_id", "text").mapInArrow(run, "model string, key string, label int, features array<double>"))
    out = []
    for model, width in (("f", 14), ("j", 16)):
        own = labelled.where(F.col("model") == model).orderBy(F.xxhash64("key"), "key").limit(SAMPLE_LINES // 2).select("label", "features").toPandas()
        out.append(maxent.fit(np.array(own.features.tolist()).reshape(len(own), width), own.label.to_numpy(int), 2, rounds=400, ridge=1e-4) if len(own) else np.zeros((width + 1, 2)))
    return out[0], out[1]


_KEYS = ["table_name", "record_id"]
_READ = pa.schema([("table_name", pa.string()), ("record_id", pa.string()), ("line_no", pa.int32()), ("noise", pa.string()), ("kind", pa.string()), ("item", pa.string()), ("next_no", pa.int32()), ("first", pa.int32())])


class Reading(NamedTuple):
    """What was read from the scans: the texts, a row for each noise or item in question by line,
    and the items that were misread with their corrections."""

    texts: DataFrame
    lines: DataFrame
    misread: DataFrame


def read_scans(scans: DataFrame, edited: DataFrame) -> Reading:
    own_source = F.col("source") if "source" in scans.columns else F.lit(None).cast("string")
    texts = scans.select(*_KEYS, own_source.alias("source"), "text").where("text IS NOT NULL AND text <> ''")
    lexicon = cut(lexicon_counts(edited.where("text IS NOT NULL")))
    sums = lexicon.where("item = ''").select("kind", F.col("n").alias("total"))
    page = Page({}, {}, {}, ())
    for r in lexicon.where("item <> ''").join(F.broadcast(sums), "kind").where(F.col("n") >= F.greatest(F.lit(2.0), F.col("total") * LEXICON_SHARE)).toLocalIterator():
        getattr(page, {"w": "words", "s": "sequences", "p": "pairs"}[r.kind])[r.item] = r.n / r.total * 1e6
    listed, local = header_shapes(texts, page)
    page = page._replace(headers=tuple(listed))
    furniture, joins = _fit_lines(texts, page)
    shared = scans.sparkSession.sparkContext.broadcast(page)
    if local is None:
        headed = texts.select(*_KEYS, "text", F.lit(None).cast("string").alias("headers"))
    else:  # few sources are broadcast; beyond that the texts are joined, hot sources split by the engine
        few = local.count() <= SOURCES
        headed = texts.join(F.broadcast(local) if few else local, "source", "left").select(*_KEYS, "text", "headers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader(shared.value, furniture, joins)
        for batch in batches:
            rows: list[tuple] = []
            names = batch.column("table_name").to_pylist(), batch.column("record_id").to_pylist()
            for table, record, (found, asked) in zip(*names, reader.read_all(batch.column("text").to_pylist(), batch.column("headers").to_pylist()), strict=True):
                rows += [(table, record, line, noise, None, None, nxt, None) for line, noise, nxt in found]
                rows += [(table, record, line, None, kind, item, nxt, first) for kind, item, line, nxt, first in asked]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_READ), _READ, strict=True)], schema=_READ)

    out = "table_name string, record_id string, line_no int, noise string, kind string, item string, next_no int, first int"
    lines = cut(headed.mapInArrow(run, out))
    misread = judge(lines.where("noise IS NULL").groupBy("kind", "item").agg(F.count("*").alias("n")), lexicon)
    return Reading(texts, lines, misread)


def scan_noise(scans: DataFrame, edited: DataFrame) -> DataFrame:
    """``table_name, record_id, line_no, noise`` of ``scans`` (``table_name, record_id, text`` and,
    if there is one, ``source``, within which headers of small papers repeat).

    ``edited`` has the column ``text`` of texts without noise, which words and sequences are learned
    from. Null and empty texts have no lines with noise; without edited texts nothing is misread
    but lost characters. A line with several misread words has one row.
    """
    _, lines, misread = read_scans(scans, edited)
    asked = lines.where("noise IS NULL")
    line_no = F.when(F.col("at") < F.col("first"), F.col("line_no")).otherwise(F.col("next_no"))
    words = asked.join(misread, ["kind", "item"]).select(*_KEYS, line_no.alias("line_no"), F.lit("misread").alias("noise"))
    return lines.where("noise IS NOT NULL").select(*_KEYS, "line_no", "noise").unionByName(words).distinct()


def _like(word: str, model: str) -> str:
    """``word`` in the letter case of ``model``."""
    if model.isupper() and len(model) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


def repaired(text: str, furniture: set[int], joins: dict[int, int], corrections: dict[tuple[str, str], str]) -> str:
    """Continuous paragraphs of a scanned text: lines of furniture are left out, broken words joined
    and misread items replaced by their corrections.

    A paragraph ends at a blank line, before an indented line, and after a line that is much
    shorter than the others and ends a sentence. Lines of scripts without spaces are joined as
    they are, others by a space.
    """
    lines = text.split("\n")
    filled = sorted(len(line) for k, line in enumerate(lines) if k not in furniture and line.strip())
    width = filled[int(0.75 * (len(filled) - 1))] if filled else 0
    ends = set(joins.values())
    paragraphs: list[str] = []
    open_ = False
    for k, line in enumerate(lines):
        if k in furniture:
            continue
        bare = line.strip()
        if not bare:
            open_ = False
            continue
        if line[:1].isspace() and k not in ends:
            open_ = False
        if not open_:
            paragraphs.append(bare)
        else:
            before = paragraphs[-1]
            if k in ends:
                hyphens = before.rstrip(_HYPHENS + " ")
                paragraphs[-1] = (hyphens if len(hyphens) < len(before) else before) + bare
            else:
                paragraphs[-1] = before + ("" if _unspaced(before[-1]) or _unspaced(bare[0]) or before[-1] in "。，、；：！？」』）" else " ") + bare
        open_ = k in joins or not (len(line.rstrip()) < 0.6 * width and _SENTENCE_END.search(line))
    if corrections:
        paragraphs = [_corrected(p, corrections) for p in paragraphs]
    return "\n\n".join(paragraphs)


def _corrected(paragraph: str, corrections: dict[tuple[str, str], str]) -> str:
    def word(m: regex.Match) -> str:
        token = m[0]
        bare = _STRIP.sub("", token)
        to = corrections.get(("w", core(token)))
        return token if to is None or not bare else token.replace(bare, _like(to, bare), 1)

    def run(m: regex.Match) -> str:
        marked = f"^{m[0]}$"
        return "".join(to[1] if len(to := corrections.get(("s", marked[k - 1 : k + 2]), "")) == 3 and to[1] not in "^$" else marked[k] for k in range(1, len(marked) - 1))

    out = _NOT_RUN.sub(lambda m: _TOKEN.sub(word, m[0]), paragraph) if any(kind == "w" for kind, _ in corrections) else paragraph
    if any(kind == "s" for kind, _ in corrections):
        out = _RUN.sub(run, out)
        out = _LOST_BETWEEN.sub(lambda m: corrections.get(("s", f"{m[1]}□{m[2]}"), m[1] + m[0] + m[2])[1], out)
    return out


def repaired_texts(scans: DataFrame, edited: DataFrame) -> DataFrame:
    """``table_name, record_id, text``: every text of ``scans`` repaired into continuous paragraphs;
    see :func:`repaired`. Null and empty texts come out as they are; repeated records are repaired
    each. A lost character is put back where both neighbours have one usual character between
    them, else it stays."""
    texts, lines, misread = read_scans(scans, edited)
    fixes = lines.where("noise IS NULL").select(*_KEYS, "kind", "item").distinct().join(misread.where("correction IS NOT NULL").select("kind", "item", "correction"), ["kind", "item"])
    none, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    edits = fixes.select(*_KEYS, F.struct("kind", "item", "correction", number.alias("line_no"), number.alias("next_no")).alias("e")).unionByName(
        lines.where("noise <> 'misread'").select(*_KEYS, F.struct(F.col("noise").alias("kind"), none.alias("item"), none.alias("correction"), "line_no", "next_no").alias("e"))
    )
    per_text = edits.groupBy(*_KEYS).agg(F.collect_list("e").alias("edits"))  # bounded by the text itself
    schema = pa.schema([("table_name", pa.string()), ("record_id", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, edits in zip(batch.column("text"), batch.column("edits").to_pylist(), strict=True):
                furniture, joins, corrections = set(), {}, {}
                for e in edits or ():
                    if e["kind"] == "broken_word":
                        joins[e["line_no"]] = e["next_no"]
                    elif e["item"] is None:
                        furniture.add(e["line_no"])
                    else:
                        corrections[e["kind"], e["item"]] = e["correction"]
                out.append(repaired(text.as_py(), furniture, joins, corrections))
            yield pa.RecordBatch.from_arrays([batch.column("table_name"), batch.column("record_id"), pa.array(out, pa.string())], schema=schema)

    mended = texts.select(*_KEYS, "text").join(per_text, _KEYS, "left").mapInArrow(run, "table_name string, record_id string, text string")
    return mended.unionByName(scans.where("text IS NULL OR text = ''").select(*_KEYS, "text"))


def _scans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scanned texts of both tables, and the edited ones."""
    documents = load(spark, folder, "documents")
    # read by several passes, so its shuffle is not repeated
    regions = cut(current(load(spark, folder, "ocr_region").select("region_id", "source_uri", "raw_text", "ingested_at"), "region_id", "source_uri", "raw_text"))
    scans = documents.where("variant = 'raw_ocr'").select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("record_id"), "source", "text").unionByName(
        regions.select(F.lit("ocr_region").alias("table_name"), F.col("region_id").alias("record_id"), F.col("source_uri").alias("source"), F.col("raw_text").alias("text"))
    )
    return scans, documents.where(F.col("variant").isin("corrected_transcription", "approved_reconstruction"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_noise(*_scans(spark, folder))


def p5_text(spark: SparkSession, folder: str) -> DataFrame:
    """The repaired text of every scanned document and region."""
    return repaired_texts(*_scans(spark, folder))


QUERIES = {"p5_found": p5_found, "p5_text": p5_text}
ORACLE: dict[str, str] = {}
