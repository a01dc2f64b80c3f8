"""Orphan references: keys that point at records that are missing, deleted or arrive later.

Method: the keys of a parent table are cut into ranges; every range is stored as one row of sorted
arrays. References travel to the range their key falls into and are probed there in vectorised
batches by binary search, in arrays of digests of fixed width, so that long keys cost no more. A range that many references hit is probed by several tasks, each with
its own copy of the (bounded) arrays, so a hot parent never ends up in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.sources.tables import current

#: Keys in one range, and references that one task probes, on average.
RANGE_KEYS = 32_768
PROBE_ROWS = 131_072
#: Ranges are cut on this many leading bits of the key's digest, in which keys are uniform.
_SPACE = 1 << 32

_OUT = "record_id string, created_at timestamp, cause string"


def _range_of(key, ranges: int):
    """Number of the range of a key: the key space is ordered by digest and cut evenly, which
    balances the ranges whatever the keys look like (sequential ids, uuids, urls)."""
    digest = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return F.floor(digest * F.lit(ranges) / F.lit(_SPACE)).cast("int")


def parent_states(parents: DataFrame, key: str, deleted: str | None = "deleted_at") -> DataFrame:
    """One row per parent record: ``key`` (lower case), first arrival, deleted or not."""
    gone = F.col(deleted).isNotNull() if deleted else F.lit(False)
    rows = parents.select(F.lower(key).alias("key"), gone.alias("gone"), "ingested_at")
    return current(rows, "key", "gone", extra=[F.min("ingested_at").alias("first_at")])


def reference_states(children: DataFrame, key: str, field: str) -> DataFrame:
    """One row per referring record with a non-null reference in its state."""
    rows = children.select(
        F.col(key).alias("record_id"), F.lower(field).alias("ref"), "created_at", "ingested_at"
    )
    state = current(rows, "record_id", "ref", "created_at", extra=[F.min("ingested_at").alias("first_at")])
    return state.where(F.col("ref").isNotNull())


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    """Binary search of all references of a range at once, in the sorted digests of its keys; what is found is
    compared with the key itself, and where several keys have one digest with each of them."""
    n_refs = refs.num_rows
    cause = np.full(n_refs, "missing", object)
    row = parents.slice(0, 1)
    if n_refs and parents.num_rows and row.column("keys").null_count == 0:
        keys, digests, first, gone = (row.column(c).combine_chunks().flatten() for c in ("keys", "digests", "firsts", "gones"))
        digests, first, gone = digests.to_numpy(), first.to_numpy(), gone.to_numpy(zero_copy_only=False)
        wanted, asked = refs.column("ref").combine_chunks(), refs.column("digest").to_numpy()
        born = refs.column("first_us").to_numpy()
        at = np.searchsorted(digests, asked)
        open_ = np.flatnonzero((at < len(digests)) & (digests[np.minimum(at, len(digests) - 1)] == asked))
        while len(open_):
            same = pc.equal(keys.take(pa.array(at[open_])), wanted.take(pa.array(open_))).to_numpy(zero_copy_only=False)
            hit = open_[same]
            cause[hit] = np.where(gone[at[hit]], "deleted", np.where(first[at[hit]] > born[hit], "late", ""))
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[(at[open_] < len(digests)) & (digests[np.minimum(at[open_], len(digests) - 1)] == asked[open_])]
    bad = pa.array(np.flatnonzero(cause != ""))
    return pa.table(
        {
            "record_id": refs.column("record_id").take(bad),
            "created_at": refs.column("created_at").take(bad),
            "cause": pa.array(cause[bad.to_numpy()].tolist(), pa.string()),
        }
    )


def orphan_references(references: DataFrame, parents: DataFrame, n_parents: int) -> DataFrame:
    """References at fault: ``record_id, created_at, cause``.

    ``references`` as of :func:`reference_states`, ``parents`` as of :func:`parent_states`.
    cause is ``missing`` (no such parent), else ``deleted``, else ``late`` (the parent arrived
    first after the referring record did). An empty parent table makes every reference missing;
    empty references give no rows. ``n_parents`` only sets the number of ranges.
    """
    ranges = max(1, -(-n_parents // RANGE_KEYS))
    micros = F.unix_micros("first_at")
    arrays = (
        parents.select(_range_of(F.col("key"), ranges).alias("r"), F.struct(F.xxhash64("key").alias("h"), "key", micros.alias("f"), "gone").alias("p"))
        .groupBy("r")
        .agg(F.array_sort(F.collect_list("p")).alias("ps"))
        .select("r", F.col("ps.key").alias("keys"), F.col("ps.h").alias("digests"), F.col("ps.f").alias("firsts"), F.col("ps.gone").alias("gones"))
    )
    refs = references.select("record_id", "ref", "created_at", F.xxhash64("ref").alias("digest"), micros.alias("first_us"), _range_of(F.col("ref"), ranges).alias("r"))
    # how many tasks share a range: counted over all references with map-side combination
    shares = refs.groupBy("r").agg(F.ceil(F.count("*") / F.lit(PROBE_ROWS)).cast("int").alias("n"))
    salted = refs.join(shares, "r").withColumn("s", F.pmod(F.xxhash64("record_id"), F.col("n")).cast("int")).drop("n")
    copies = shares.join(arrays, "r", "left").select(
        F.col("r").alias("to_r"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("to_s"), "keys", "digests", "firsts", "gones"
    )
    return (
        salted.groupBy("r", "s")
        .cogroup(copies.groupBy("to_r", "to_s"))
        .applyInArrow(_probe, _OUT)
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Misses per table, field, cause and period."""
    return found.groupBy("table_name", "field_name", "cause", "period").agg(F.count("*").alias("misses"))
