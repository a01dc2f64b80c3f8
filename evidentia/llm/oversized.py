"""Splitting oversized items at natural boundaries.

Method: every position of a text gets a boundary strength; a sparse table over the strengths
answers range-maximum queries in constant time. From the start of a piece the strongest cut within
the permissible lengths is taken, ties to the right, and the next piece starts ``overlap`` code
points before the cut.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.tables import load

LIMIT, OVERLAP = 1_500, 100
#: A cut in the second half of the limit is preferred to any in the first half.
_EARLY = 0.5

#: Strengths of a cut after a character, weakest first.
NONE, SPACE, MARK, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
_SENTENCE_MARKS = ".!?…。！？．؟।"
_CLAUSE_MARKS = ",;:，；：、—–"


def is_blank(char: str) -> bool:
    return char.isspace() or unicodedata.category(char)[0] == "Z"


@cache
def _strengths_of_plane() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for code in range(0x10000):
        char = chr(code)
        if is_blank(char):
            table[code] = SPACE
        elif unicodedata.category(char)[0] == "P":
            table[code] = MARK
    # only punctuation and white space are boundaries: symbols such as the mathematical ellipsis are none
    for marks, strength in ((_SENTENCE_MARKS, SENTENCE), (_CLAUSE_MARKS, CLAUSE), ("\n\r ", LINE), (" ", PARAGRAPH)):
        for char in marks:
            table[ord(char)] = strength
    return table


def strengths(text: str) -> np.ndarray:
    """Strength of the cut after each character of ``text`` (uint8, one per code point)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    plane = _strengths_of_plane()
    out = plane[np.minimum(codes, 0xFFFF)]
    for at in np.flatnonzero(codes > 0xFFFF):
        char = chr(codes[at])
        out[at] = SPACE if is_blank(char) else MARK if unicodedata.category(char)[0] == "P" else NONE
    line = out == LINE
    out[1:][line[1:] & line[:-1]] = PARAGRAPH
    # closing quotes and brackets, and spaces, carry on the strength of the end mark before them
    for at in np.flatnonzero((out[1:] == MARK) & (out[:-1] == SENTENCE)) + 1:
        if unicodedata.category(chr(codes[at])) in ("Pe", "Pf") or codes[at] in (0x22, 0x27):
            out[at] = SENTENCE
    spaced = np.flatnonzero((out[1:] == SPACE) & (out[:-1] > SPACE) & (out[:-1] <= SENTENCE)) + 1
    out[spaced] = out[spaced - 1]
    return out


class RangeMaximum:
    """Sparse table: ``rightmost(a, b)`` is the rightmost position of the maximum in ``[a, b]``."""

    def __init__(self, values: np.ndarray, longest: int):
        # one number holds value and position, so that the larger one is the rightmost on ties
        self.rows = [values.astype(np.int64) << 40 | np.arange(len(values), dtype=np.int64)]
        width = 1
        while 2 * width <= min(longest, len(values)):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def rightmost(self, a: int, b: int) -> tuple[int, int]:
        k = (b - a + 1).bit_length() - 1
        best = int(max(self.rows[k][a], self.rows[k][b - (1 << k) + 1]))
        return best & ((1 << 40) - 1), best >> 40

    def all_maxima(self, length: int) -> np.ndarray:
        """The maximum of every window of ``length``."""
        k = length.bit_length() - 1
        row, step = self.rows[k], length - (1 << k)
        return np.maximum(row[: len(row) - step], row[step:]) >> 40


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], bool]:
    """Pieces ``(start, end, strength of the cut at the end)`` of ``text`` and whether some stretch
    longer than ``limit`` has no natural boundary. A text within the limit is one piece, an empty
    one has none. The last piece ends with the text, as strong as a paragraph."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    size = len(text)
    if size <= limit:
        return ([(0, size, PARAGRAPH)] if size else []), False
    value = strengths(text)
    table = RangeMaximum(value, limit + 1)
    hard = bool((table.all_maxima(limit + 1) == NONE).any())
    pieces, start = [], 0
    while size - start > limit:
        split = max(start + overlap + 1, start + int(limit * _EARLY))
        at, strength = table.rightmost(split - 1, start + limit - 1)  # the cut lies after this character
        if strength == NONE and split - 1 > start + overlap:
            earlier, strength = table.rightmost(start + overlap, split - 2)
            at = earlier if strength else at
        end = at + 1 if strength else start + limit
        pieces.append((start, end, strength))
        start = end - overlap
    return [*pieces, (start, size, PARAGRAPH)], hard


_PIECES = pa.schema([("doc_id", pa.int64()), ("cut_kind", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kinds", pa.list_(pa.string()))])


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, cut_kind, starts, ends, kinds``: the pieces of each document, in order; the kind of a
    piece is ``hard`` if it had to end where there is no boundary (a stretch of less than the limit
    without one may do that, since the permissible window is shorter than the limit), ``natural``
    if not, and ``end`` for the last.

    Null and empty texts give empty lists, texts within the limit one piece; cut_kind is null for
    both. Longer texts have cut_kind ``natural``, or ``hard`` if some stretch of more than ``limit``
    code points has neither white space nor punctuation. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, starts, ends, cuts = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                pieces, hard = cut_points(text, limit, overlap)
                kinds.append(("hard" if hard else "natural") if len(text) > limit else None)
                starts.append([a for a, _, _ in pieces])
                ends.append([b for _, b, _ in pieces])
                cuts.append([*["natural" if strength else "hard" for _, _, strength in pieces[:-1]], *["end"] * (len(pieces) > 0)])
            columns = [batch.column("doc_id").cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip((kinds, starts, ends, cuts), list(_PIECES)[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, schema=_PIECES)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, cut_kind string, starts array<int>, ends array<int>, kinds array<string>")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents above the limit. The length filter runs in the JVM, so short texts never reach Python."""
    long = load(spark, folder, "documents").where(F.char_length("text") > LIMIT)
    return split_documents(long).select("doc_id", "cut_kind")


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all documents: ``doc_id, piece_no, piece_start, piece_end, piece_kind``."""
    split = split_documents(load(spark, folder, "documents"))
    return split.select("doc_id", F.posexplode(F.arrays_zip("starts", "ends", "kinds")).alias("piece_no", "p")).select(
        "doc_id", "piece_no", F.col("p.starts").alias("piece_start"), F.col("p.ends").alias("piece_end"), F.col("p.kinds").alias("piece_kind")
    )


_FOUND_SQL = r"""
SELECT doc_id, CASE WHEN list_max([length(s) FOR s IN regexp_split_to_array(text, '[\s\v\x1c-\x1f\x{85}\p{Z}\p{P}]')]) > 1500
                    THEN 'hard' ELSE 'natural' END AS cut_kind
FROM documents WHERE length(text) > 1500
"""

QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces}
ORACLE = {"p6_found": _FOUND_SQL}
