"""Encoding of the corpus with a public byte-level BPE tokenizer.

Method: encodings form a monoid under concatenation. A text is halved until the parts are short,
the parts are encoded, and neighbours are joined up the tree. A join re-encodes a window around the
seam that grows until both sides provably keep their tokens: the tokenizer first parts a text into
words with a pattern that is matched from left to right and has no memory, so once a word boundary
of the joined window is also one of the right part, everything behind it stays as it was; and on the
left only the last word can change, because a match never looks further than one character ahead.
Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from evidentia.sources.tables import load

TOKENIZERS = "/opt/tokenizers"
#: Code points that are encoded in one go.
LEAF = 8_192
#: Fixed value: the published word pattern of the tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# white space in the sense of Unicode, which leaves out the separators U+001C to U+001F
_WORDS = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
#: No word goes across these places, whatever stands around them.
_SURE = regex.compile(r"(?r)(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\P{White_Space})(?=\p{White_Space})")
#: The longest contraction of the pattern: what a match may read besides what it takes.
_READ = 3
_WINDOW = 64


@cache
def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> tiktoken.Encoding:
    """The tokenizer of ``folder``; loaded once in each worker."""
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _loose_end(text: str) -> int:
    """Where the words of ``text`` start that may change when something is appended."""
    width = _WINDOW
    while True:
        low = max(0, len(text) - width)
        sure = _SURE.search(text, low + 1, len(text) - _READ) if low else None
        if sure or not low:
            last = sure.start() if sure else 0
            for word in _WORDS.finditer(text, last):
                last = word.start()
                if last + _READ > len(text):
                    break
            return last
        width *= 4


def _bounds(text: str, whole: bool) -> list[int]:
    """Ends of the words at the beginning of ``text``; if more text follows, without those that it
    may change."""
    if whole:
        return [word.end() for word in _WORDS.finditer(text)]
    words = [word.span() for word in _WORDS.finditer(text)]
    return [end for start, end in words if end < len(text) and start + _READ <= len(text)]


class TreeCodec:
    """Encodes and decodes by reduction over a tree of text parts."""

    def __init__(self, coder: tiktoken.Encoding, leaf: int = LEAF):
        self.coder, self.leaf = coder, max(1, leaf)

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; the strings of special tokens are ordinary text. Null and
        empty texts give an empty list."""
        return self._encode(text, 0, len(text)) if text else []

    def _encode(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf:
            return self.coder.encode_ordinary(text[low:high])
        middle = (low + high) // 2
        return self._join(text, low, middle, high, self._encode(text, low, middle), self._encode(text, middle, high))

    def _join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        tail = text[low:middle]
        tail = tail[_loose_end(tail) :]
        width, size = _WINDOW, high - middle
        while True:
            width = min(width, size)
            head = text[middle : middle + width]
            own = set(_bounds(head, width == size))
            joined = _bounds(tail + head, width == size)
            # a run of white space is parted by what follows it, so it can't end the window
            ends = (end - len(tail) for end in joined)
            stable = next((e for e in ends if e in own and (e == size or not head[e - 1].isspace())), None)
            if stable is not None:
                break
            width *= 2
        encode = self.coder.encode_ordinary
        drop_left, drop_right = len(encode(tail)), len(encode(head[:stable]))
        return left[: len(left) - drop_left] + encode(tail + head[:stable]) + right[drop_right:]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: bytes are concatenated up the tree and read as UTF-8 at the root."""
        return self._bytes(ids).decode("utf-8", "replace")

    def _bytes(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.coder.decode_bytes(ids)
        middle = len(ids) // 2
        return self._bytes(ids[:middle]) + self._bytes(ids[middle:])


def encode_documents(documents: DataFrame, folder: str = TOKENIZERS, leaf: int = LEAF, counts: bool = False) -> DataFrame:
    """``doc_id, ids`` of every document, or ``doc_id, tokens`` (their number) with ``counts``.

    A map without a shuffle: one row in, one row out. Null and empty texts give an empty list (0
    tokens). Other columns are not read; repeated rows are encoded as often as they come.
    """
    kind = pa.int32() if counts else pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("tokens" if counts else "ids", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(encoder(folder), leaf)
        for batch in batches:
            at, size = 0, 0
            done: list = []
            for k, text in enumerate(batch.column("text")):
                ids = codec.encode(text.as_py())
                done.append(len(ids) if counts else ids)
                size += len(ids)
                if size > 1_000_000 and not counts:  # bounded output batches
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, k + 1 - at), pa.array(done, kind)], schema=schema)
                    at, size, done = k + 1, 0, []
            if done:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at), pa.array(done, kind)], schema=schema)

    out = "doc_id bigint, tokens int" if counts else "doc_id bigint, ids array<int>"
    return documents.select("doc_id", "text").mapInArrow(run, out)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(load(spark, folder, "documents"))


QUERIES = {"p8_ids": p8_ids}
ORACLE: dict[str, str] = {}
