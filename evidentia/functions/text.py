"""Text functions that have no built-in; Arrow-batched."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Canonical composition; null stays null."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def identity_key(values: pd.Series) -> pd.Series:
    """Compatibility composition, case folding, letters, digits and marks only."""
    return values.map(lambda v: None if v is None else regex.sub(r"[^\p{L}\p{N}\p{M}]+", "", unicodedata.normalize("NFKC", v).casefold()))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity by longest matching blocks, between 0 and 1; null if a side is null."""
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


_OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("a_start", "a_end", "b_start", "b_end")]]))


@F.pandas_udf(_OPS)
def alignment(left: pd.Series, right: pd.Series) -> pd.Series:
    """Operations that turn the left into the right text, with their offsets on both sides."""

    def ops(a: str | None, b: str | None):
        if a is None or b is None:
            return None
        return [{"op": o, "a_start": i, "a_end": j, "b_start": k, "b_end": m} for o, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()]

    return pd.Series([ops(a, b) for a, b in zip(left, right, strict=True)])


def count_edits(expected: str, read: str) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a cheapest way from expected to read; among
    equally cheap ways substitutions are preferred, then deletions."""
    row = [(k, 0, 0, k) for k in range(len(read) + 1)]  # cost, substitutions, deletions, insertions
    for i, a in enumerate(expected, 1):
        above, row = row, [(i, 0, i, 0)]
        for j, b in enumerate(read, 1):
            if a == b:
                row.append(above[j - 1])
                continue
            s, d, n = above[j - 1], above[j], row[j - 1]
            best = min((s[0], 0), (d[0], 1), (n[0], 2))[1]
            row.append((s[0] + 1, s[1] + 1, s[2], s[3]) if best == 0 else (d[0] + 1, d[1], d[2] + 1, d[3]) if best == 1 else (n[0] + 1, n[1], n[2], n[3] + 1))
    return row[-1][1:]


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("substitutions", "deletions", "insertions")]))
def edit_counts(expected: pd.Series, read: pd.Series) -> pd.DataFrame:
    rows = [count_edits(a or "", b or "") for a, b in zip(expected, read, strict=True)]
    return pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions"])


#: Characters behind which a text is cut rather than elsewhere.
BOUNDARIES = frozenset(" \t\n\r　。．.!?！？；;，,、：:")


def chunk_ranges(text: str, spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]] | None:
    """Ranges of at most ``most`` characters that cover a text and cut through none of the spans,
    which may overlap; None if that is impossible. A range ends behind the last boundary in its
    second half, else at the full length or, if that is within a span, where the span begins."""

    def within(at: int) -> list[int]:
        return [a for a, b in spans if a < at < b]

    out, start = [], 0
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            half = max(start + 1, start + most // 2)
            natural = next((k for k in range(end, half - 1, -1) if text[k - 1] in BOUNDARIES and not within(k)), None)
            if within(end) or natural is None:
                while crossed := within(end):  # where one span begins another may go on
                    end = min(crossed)
            else:
                end = natural
        if end <= start:
            return None
        out.append((start, end))
        start = end
    return out
