"""Writers: versioned tables behind a pointer, and the citation export with its validation."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _read_pointer(spark: SparkSession, root: str) -> str | None:
    fs, at = _files(spark, f"{root}/CURRENT")
    return spark.read.text(f"{root}/CURRENT").first()[0] if fs.exists(at) else None


def publish(df: DataFrame, root: str, expected: str | None = None, rows: int | None = None) -> str:
    """Write a new version below ``root`` and make it the current one; returns its name.

    The version is complete before the pointer moves, so readers never see half of it. With
    ``rows`` the version must have that many rows, and with ``expected`` the pointer must still
    name that version (compare and swap by a single writer); otherwise nothing changes.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    written = spark.read.parquet(f"{root}/{version}").count()
    if rows is not None and written != rows:
        raise ValueError(f"{written} rows were written, {rows} expected")
    if expected is not None and _read_pointer(spark, root) != expected:
        raise ValueError("another version was published meanwhile")
    _point(spark, root, version)
    return version


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Replace the pointer in one step: a reader finds the old or the new one, never none."""
    _, new = _files(spark, f"{root}/CURRENT.{uuid.uuid4().hex}")
    _, pointer = _files(spark, f"{root}/CURRENT")
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(new, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = spark._jvm.java.lang.reflect.Array.newInstance(hadoop.Options.Rename.OVERWRITE.getClass(), 1)
    rename[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, pointer, rename)


def publish_graph(vertices: DataFrame, edges: DataFrame, root: str) -> dict[str, str]:
    """Rebuild a graph: vertices (``id``, one row each) and edges (``src, dst, label``, each once) as new
    versions below ``root``. Edges whose ends are no vertices are left out, as a graph cannot hold
    them; both versions are complete before the pointers move."""
    nodes = vertices.where("id IS NOT NULL").dropDuplicates(["id"])
    ids = nodes.select(F.col("id").alias("_id"))
    kept = edges.dropDuplicates(["src", "dst", "label"])
    for end in ("src", "dst"):
        kept = kept.join(ids, kept[end] == ids["_id"], "left_semi")
    return {"vertices": publish(nodes, f"{root}/vertices"), "edges": publish(kept, f"{root}/edges")}


def current_version(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{_read_pointer(spark, root)}")


def restore(spark: SparkSession, root: str, version: str) -> None:
    """Point back at an older version, which was kept."""
    fs, at = _files(spark, f"{root}/{version}")
    if not fs.exists(at):
        raise ValueError(f"version {version} is not there")
    _point(spark, root, version)


def export_citations(placed: DataFrame, pages: DataFrame, root: str, text: str = "t") -> None:
    """Documents (``page_id, content, parts``) and citations (``region_id, page_id, start, end`` and the
    cited text) as JSON lines, and a manifest with their counts and digests, which do not depend on
    the order of the rows."""
    pages.write.mode("overwrite").json(f"{root}/documents")
    placed.write.mode("overwrite").json(f"{root}/citations")
    manifest(pages.sparkSession, root).coalesce(1).write.mode("overwrite").json(f"{root}/manifest")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``part, n, digest`` of what an export holds: the number of lines and the sum of their digests."""
    parts = []
    for part in ("documents", "citations"):
        lines = spark.read.text(f"{root}/{part}")
        digest = F.sum(F.conv(F.substring(F.sha2("value", 256), 1, 14), 16, 10).cast("decimal(38,0)"))
        parts.append(lines.agg(F.count("*").alias("n"), F.coalesce(digest, F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest")).select(F.lit(part).alias("part"), "n", "digest"))
    return parts[0].unionByName(parts[1])


def invalid_citations(spark: SparkSession, root: str, text: str = "t") -> DataFrame:
    """Citations of an export whose text is not what stands at its offsets."""
    pages, placed = spark.read.json(f"{root}/documents"), spark.read.json(f"{root}/citations")
    joined = placed.join(pages.select("page_id", "content"), "page_id", "left")
    quote = F.col("content").substr((F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return joined.where(~quote.eqNullSafe(F.col(text))).select("region_id", "page_id", "start", "end")


def export_faults(spark: SparkSession, root: str, text: str = "t") -> DataFrame:
    """``fault, n`` of an export: counts or digests that differ from the manifest, citations that are not
    what stands at their offsets, that repeat a region, or that name no document, documents with
    another number of parts than citations. An export without faults has no rows."""
    said = spark.read.json(f"{root}/manifest").select("part", F.col("n").cast("bigint").alias("n"), "digest")
    changed = manifest(spark, root).join(said.withColumnsRenamed({"n": "m", "digest": "e"}), "part", "left").where("NOT (n <=> m) OR NOT (digest <=> e)")
    pages, placed = spark.read.json(f"{root}/documents"), spark.read.json(f"{root}/citations")
    counted = placed.groupBy("page_id").agg(F.count("*").alias("found"))
    faults = {
        "differs from the manifest": changed.select("part"),
        "text is not at its offsets": invalid_citations(spark, root, text).select("region_id"),
        "region is cited twice": placed.groupBy("region_id").agg(F.count("*").alias("k")).where("k > 1").select("region_id"),
        "no such document": placed.join(pages.select("page_id"), "page_id", "left_anti").select("region_id"),
        "parts are not accounted for": pages.join(counted, "page_id", "left").where("parts <> coalesce(found, 0)").select("page_id"),
    }
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n") for name, df in faults.items()]
    return reduce(DataFrame.unionByName, rows).where("n > 0")
