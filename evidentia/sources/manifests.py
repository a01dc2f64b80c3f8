"""Manifests of stored files by short range reads, and the hits of a search service as a table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions import columns as C
from evidentia.sources.files import binary_files, classic_xref

#: Bytes read from the beginning, the end, a reference table and an object.
HEAD, TAIL, TABLE, OBJECT = 65_536, 65_536, 4_194_304, 65_536


def _open(path: str) -> pa.NativeFile:
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def read_range(path: str, start: int, size: int) -> bytes:
    """At most ``size`` bytes of a file from ``start`` on; nothing else of it is read."""
    with _open(path) as file:
        return file.read_at(max(0, min(size, file.size() - start)), start) if 0 <= start < file.size() else b""


def read_ranges(ranges: DataFrame) -> DataFrame:
    """``path, start, size, data`` of ``path, start, size``, read where the task runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = zip(*(batch.column(c).to_pylist() for c in ("path", "start", "size")), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([read_range(*a) for a in asked], pa.binary())], names=["path", "start", "size", "data"])

    return ranges.select("path", F.col("start").cast("bigint").alias("start"), F.col("size").cast("bigint").alias("size")).mapInArrow(run, "path string, start bigint, size bigint, data binary")


def signature_faults(extension: str, head: bytes, tail: bytes) -> list[str]:
    """What is wrong with the beginning and the end of a file of that kind."""
    if extension == "pdf":
        checks = [("no pdf signature", head.startswith(b"%PDF-")), ("no startxref and end mark", b"startxref" in tail and b"%%EOF" in tail)]
    elif extension in ("djvu", "djv"):
        checks = [("no djvu signature", head.startswith(b"AT&TFORM"))]
    elif extension in ("jpg", "jpeg"):
        checks = [("no jpeg signature", head.startswith(b"\xff\xd8\xff")), ("no end of image", tail.endswith(b"\xff\xd9"))]
    else:
        return ["kind is not supported"]
    return [name for name, good in checks if not good]


def pdf_pages(path: str, size: int, tail: bytes) -> tuple[int | None, str]:
    """Number of pages by the page tree, and ``page tree`` or the reason why there is none. Only the table
    of a classic file and two objects are read."""
    at = re.search(rb"startxref\s+(\d+)\s+%%EOF", tail)
    if not at:
        return None, "no startxref"
    table = int(at[1])
    if not table < size:
        return None, "table outside the file"
    data = read_range(path, table, TABLE)
    if not data.lstrip().startswith(b"xref"):
        return None, "no classic table"
    offsets, root = classic_xref(data.lstrip())
    if root is None or root not in offsets:
        return None, "no root"

    def body(number: int) -> bytes:
        return read_range(path, offsets[number], OBJECT).split(b"endobj")[0] if number in offsets else b""

    pages = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", body(root))
    if not pages:
        return None, "no page tree"
    count = re.search(rb"/Count\s+(\d+)", body(int(pages[1])))
    return (int(count[1]), "page tree") if count else (None, "no page count")


def djvu_pages(head: bytes) -> tuple[int | None, str]:
    """Number of components in the directory of a bundled file."""
    if not head.startswith(b"AT&TFORM") or head[12:16] != b"DJVM":
        return None, "not bundled"
    at = head.find(b"DIRM", 16)
    return (int.from_bytes(head[at + 9 : at + 11], "big"), "directory") if 0 <= at <= len(head) - 11 else (None, "no directory")


_FACTS = "path string, status string, issues array<string>, page_count int, page_count_source string"


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*", mark: str = "vol-") -> DataFrame:
    """A row per file below a folder: ``path, size, modified, extension, media_type, volume_number, status,
    issues, page_count, page_count_source``.

    Contents are never loaded: each task reads the ends of its files and, of PDFs, the page tree. Status is
    ``ok``, ``suspect`` (with issues), ``empty`` or ``unsupported``; a file that cannot be read is ``suspect``.
    Where the engine's listing leaves out files without a byte, they have no row.
    """
    files = binary_files(spark, folder, pattern, content=False).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, size, kind in zip(frame.path, frame["size"], frame.extension, strict=True):
                if size <= 0:
                    rows.append((path, "empty", ["empty"], None, "none"))
                    continue
                try:
                    head, tail = read_range(path, 0, HEAD), read_range(path, max(0, size - TAIL), TAIL)
                    issues, pages, source = signature_faults(kind, head, tail), None, "none"
                    if kind == "pdf":
                        pages, source = pdf_pages(path, size, tail)
                    elif kind in ("djvu", "djv"):
                        pages, source = djvu_pages(head)
                except OSError as problem:
                    issues, pages, source = [f"not readable: {type(problem).__name__}"], None, "none"
                status = "unsupported" if issues == ["kind is not supported"] else "suspect" if issues else "ok"
                rows.append((path, status, issues, pages, source))
            out = pd.DataFrame(rows, columns=["path", "status", "issues", "page_count", "page_count_source"])
            yield out.astype({"page_count": "Int32"})

    listed = files.withColumn("extension", extension)
    facts = listed.select("path", "size", "extension").mapInPandas(run, _FACTS)
    return listed.join(facts, "path").select("path", "size", "modified", "extension", C.media_type("path").alias("media_type"), C.number_after("path", mark).alias("volume_number"), "status", "issues", "page_count", "page_count_source")


HIT = T.StructType([
    T.StructField("hits", T.StructType([T.StructField("hits", T.ArrayType(T.StructType([
        T.StructField("_index", T.StringType()), T.StructField("_score", T.DoubleType()),
        T.StructField("_source", T.StructType([
            T.StructField("revision_id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("embedding_model", T.StringType()),
            T.StructField("sources", T.ArrayType(T.StructType([T.StructField("sequence_number", T.IntegerType()), T.StructField("region_id", T.StringType()), T.StructField("document_start", T.IntegerType()), T.StructField("document_end", T.IntegerType())]))),
        ])),
    ])))])),
])


def search_hits(responses: DataFrame, key: str, payload: str, model: str | Column | None = None) -> DataFrame:
    """``key, rank, score, document_id, sequence, region_id, span_start, span_end`` of JSON answers of a
    search service: a row for each source of each hit.

    The rank is the place of the hit in its answer, from 1. A malformed answer, a hit without id, score
    or sources, and, if ``model`` is given, one of another embedding model fail the query, as mixed
    results would go unnoticed. An answer without hits has no rows.
    """
    parsed = responses.select(key, F.from_json(payload, HIT, {"mode": "FAILFAST"}).alias("r"))
    hits = parsed.select(key, F.posexplode(F.coalesce("r.hits.hits", F.raise_error(F.lit("an answer has no list of hits")).cast(HIT["hits"].dataType["hits"].dataType))).alias("at", "h"))
    good = F.col("h._source.revision_id").isNotNull() & F.col("h._score").isNotNull() & F.col("h._source.sources").isNotNull()
    if model is not None:
        good = good & F.col("h._source.embedding_model").eqNullSafe(F.lit(model) if isinstance(model, str) else model)
    checked = F.when(good, F.col("h")).otherwise(F.raise_error(F.lit("a hit is incomplete or of another model")).cast(hits.schema["h"].dataType))
    rows = hits.select(key, (F.col("at") + 1).alias("rank"), checked.alias("h"))
    spread = rows.select(key, "rank", F.col("h._score").alias("score"), F.col("h._source.revision_id").alias("document_id"), F.explode("h._source.sources").alias("s"))
    return spread.select(key, "rank", "score", "document_id", F.col("s.sequence_number").alias("sequence"), "s.region_id", F.col("s.document_start").alias("span_start"), F.col("s.document_end").alias("span_end"))
