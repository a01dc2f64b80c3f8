"""Readers of files other than the archive's Parquet tables, all with declared schemas."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Newline-delimited JSON; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_artifacts(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON documents."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """Partitioned scan of a database table by a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options)
    return reader.load()


def unknown_keys(payload: str | Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that a strict schema does not have; Spark's reader ignores them silently."""
    return F.array_except(F.json_object_keys(payload), F.array(*map(F.lit, allowed)))


def parameters(spark: SparkSession, **columns: list) -> DataFrame:
    """Parallel parameter lists as a table; lists of different lengths are rejected."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("parameter lists differ in length")
    return spark.createDataFrame(pd.DataFrame(columns)) if next(iter(columns.values()), None) else spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))


def binary_files(spark: SparkSession, folder: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """Files below a folder with path, length and time; the content is pruned unless it is asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files if content else files.drop("content")


def signature_status(content: str | Column) -> Column:
    """``pdf``, ``djvu``, ``truncated`` (a PDF without its end mark) or ``unknown``."""
    data = F.col(content) if isinstance(content, str) else content
    pdf = F.substring(data, 1, 5) == F.lit(b"%PDF-")
    ended = F.contains(F.substring(data, -1024, 1024), F.lit(b"%%EOF"))
    djvu = F.substring(data, 1, 8) == F.lit(b"AT&TFORM")
    return F.when(pdf & ended, "pdf").when(pdf, "truncated").when(djvu, "djvu").otherwise("unknown")


def classic_xref(data: bytes) -> tuple[dict[int, int], int | None]:
    """Offsets of the objects in use, and the object of the trailer's root, of a classic PDF table."""
    table = data.rfind(b"\nxref")
    table = table + 1 if table >= 0 else (0 if data.startswith(b"xref") else -1)
    offsets: dict[int, int] = {}
    if table < 0:
        return offsets, None
    number = 0
    for line in data[table + 4 :].splitlines():
        parts = line.split()
        if line.startswith(b"trailer"):
            break
        if len(parts) == 2 and all(p.isdigit() for p in parts):
            number = int(parts[0])
        elif len(parts) == 3 and parts[2] in (b"n", b"f"):
            if parts[2] == b"n":
                offsets[number] = int(parts[0])
            number += 1
    root = re.search(rb"/Root\s+(\d+)\s+\d+\s+R", data[table:])
    return offsets, int(root[1]) if root else None


def page_count(data: bytes) -> int | None:
    """Pages of a PDF by its page tree, of a bundled DjVu by its directory; null if it has neither."""
    if data[:8] == b"AT&TFORM":
        at = data.find(b"DIRM")
        return int.from_bytes(data[at + 9 : at + 11], "big") if at >= 0 and len(data) >= at + 11 else None
    offsets, root = classic_xref(data)

    def body(number: int | None) -> bytes:
        at = offsets.get(number) if number is not None else None
        return data[at : data.find(b"endobj", at)] if at is not None else b""

    pages = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", body(root))
    count = re.search(rb"/Count\s+(\d+)", body(int(pages[1]))) if pages else None
    return int(count[1]) if count else None


@F.pandas_udf(T.IntegerType())
def pages_of(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for content in contents:
        yield content.map(lambda data: None if data is None else page_count(bytes(data))).astype("Int64")
