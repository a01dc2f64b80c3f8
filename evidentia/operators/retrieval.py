"""Lexical and dense search, rank fusion and set similarity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import cut

#: Queries that one block of the dense search holds, which is sent to all workers.
QUERY_BLOCK = 2_048

_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"


def terms_of(text: str) -> Column:
    """Lower-case words of letters, marks and digits; runs of Han and kana as pairs of neighbouring
    characters (a single one by itself). Null has no terms."""
    parted = F.regexp_replace(F.lower(text), f"([{_CJK}]+)", " $1 ")
    words = F.filter(F.split(parted, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")

    def pairs(word: Column) -> Column:
        within = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(word) - 1)), lambda k: word.substr(k, F.lit(2)))
        return F.when(word.rlike(f"^[{_CJK}]"), within).otherwise(F.array(word))

    return F.coalesce(F.flatten(F.transform(words, pairs)), F.array().cast("array<string>"))


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda word: word == term


def term_counts(documents: DataFrame, key: str, fields: list[str], terms: list[str]) -> DataFrame:
    """``key`` and for each field ``<field>_n`` (its number of terms, null for a null field) and
    ``<field>_tf`` (how often it has each of ``terms``). One pass over the texts, written to the
    shared folder, so that statistics and scores of any number of queries read only these counts."""
    columns = [documents[key]]
    for field in fields:
        columns.append(F.when(F.col(field).isNotNull(), terms_of(field)).alias(f"_{field}"))
    rows = documents.select(*columns)
    out = [F.col(key)]
    for field in fields:
        own = F.col(f"_{field}")
        tf = F.array(*[F.size(F.filter(own, _equals(t))) for t in terms])
        out += [F.when(own.isNotNull(), F.size(own)).alias(f"{field}_n"), F.when(own.isNotNull(), tf).alias(f"{field}_tf")]
    return cut(rows.select(*out))


def bm25(counts: DataFrame, key: str, fields: dict[str, float], terms: list[str], wanted: list[str] | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``key, score`` of all documents that have one of the ``wanted`` terms (all ``terms`` of the
    ``counts`` by default). With several fields the best one counts, each times its boost. The
    statistics of the collection are one row."""
    places = [terms.index(t) for t in (terms if wanted is None else wanted)]
    stats = counts.agg(*[x for f in fields for x in (
        F.count(f"{f}_n").alias(f"{f}_c"), F.avg(f"{f}_n").alias(f"{f}_a"), *[F.count_if(F.col(f"{f}_tf")[k] > 0).alias(f"{f}_df{k}") for k in places],
    )])
    has = [F.col(f"{f}_tf")[k] > 0 for f in fields for k in places]
    met = counts.where(reduce(Column.__or__, [F.coalesce(h, F.lit(False)) for h in has])).crossJoin(F.broadcast(stats))
    scores = []
    for f, boost in fields.items():
        parts = []
        for k in places:
            tf, df = F.col(f"{f}_tf")[k], F.col(f"{f}_df{k}")
            idf = F.log(1 + (F.col(f"{f}_c") - df + 0.5) / (df + 0.5))
            parts.append(F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col(f"{f}_n") / F.col(f"{f}_a")))).otherwise(0.0))
        scores.append(boost * reduce(Column.__add__, parts))
    best = F.greatest(*[F.coalesce(s, F.lit(0.0)) for s in scores]) if len(scores) > 1 else scores[0]
    return met.select(key, F.round(best, 6).alias("score"))


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The best ``k`` rows with their rank: a bounded list, ordered in one task."""
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse(first: DataFrame, second: DataFrame, key: str, k: int = 60) -> DataFrame:
    """``key, score, first_rank, second_rank``: reciprocal rank fusion of two ranked lists."""
    both = first.select(key, F.col("rank").alias("first_rank")).join(second.select(key, F.col("rank").alias("second_rank")), key, "full_outer")
    part = [F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0)) for c in ("first_rank", "second_rank")]
    return both.select(key, F.round(part[0] + part[1], 9).alias("score"), "first_rank", "second_rank")


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of unit length of a list column; rows of zeros and with what is no number become 0."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    size = np.sqrt((values * values).sum(1)) if len(values) else np.zeros(0)
    good = np.isfinite(size) & (size > 0)
    return np.where(good[:, None], values / np.where(good, size, 1)[:, None], 0.0)


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, same: str | None = None) -> DataFrame:
    """``query_id, key, rank, cosine`` of the ``k`` vectors with the highest cosine to each query.

    Exact: the queries are sent to the workers in blocks of bounded size, one after another, and
    meet every partition of the vectors as a matrix product per batch; only the best ``k`` of each
    partition leave it, and those are merged. A vector is no neighbour of itself; null vectors,
    vectors of zeros and with what is no number are left out. With ``same`` both must agree in that
    column, and only those are compared.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[key]
    label = F.col(same).cast("string") if same else F.lit("")
    asked = queries.where(F.col(vector).isNotNull() & label.isNotNull()).select(F.col(key).alias("id"), label.alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = vectors.where(F.col(vector).isNotNull() & label.isNotNull()).select(F.col(key).alias("id"), label.alias("label"), F.col(vector).cast("array<double>").alias("v"))
    asked = cut(asked)
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    out = f"query_id {kind}, {key} {kind}, cosine double"
    found = []
    for block in range(parts):  # a block is bounded, as the digest spreads the queries evenly
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == block).toArrow()
        shared = spark.sparkContext.broadcast((own.column("id").combine_chunks(), np.array(own.column("label").to_pylist(), object), _unit(own.column("v").combine_chunks())))

        def search(batches, shared=shared):
            q_ids, q_labels, q = shared.value
            if not len(q_ids):
                return
            names: list = []
            best_q, best_i, best_c = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            for batch in batches:
                ids, labels = batch.column("id").to_pylist(), np.array(batch.column("label").to_pylist(), object)
                v, base = _unit(batch.column("v")), len(names)
                names += ids
                own_row = {x: i for i, x in enumerate(ids)}
                mine = np.array([own_row.get(x, -1) for x in q_ids.to_pylist()])
                for group in np.unique(labels.astype(str)):
                    at_q, at_v = np.flatnonzero(q_labels == group), np.flatnonzero(labels == group)
                    if not len(at_q) or not v.shape[1]:
                        continue
                    at_v = at_v[v[at_v].any(1)]
                    at_q = at_q[q[at_q].any(1)]
                    if not len(at_q) or not len(at_v):
                        continue
                    cosine = np.round(q[at_q] @ v[at_v].T, 6)
                    cosine[mine[at_q][:, None] == at_v[None, :]] = -2
                    least = np.partition(cosine, -k, axis=1)[:, -k] if cosine.shape[1] > k else np.full(len(at_q), -1.5)
                    hit_q, hit_v = np.nonzero((cosine >= least[:, None]) & (cosine > -1.5))
                    best_q, best_i = np.concatenate([best_q, at_q[hit_q]]), np.concatenate([best_i, base + at_v[hit_v]])
                    best_c = np.concatenate([best_c, cosine[hit_q, hit_v]])
                if len(best_q):  # the best k so far, ties by the smaller key
                    keys = np.array(names)[best_i]
                    order = np.lexsort((keys, -best_c, best_q))
                    best_q, best_i, best_c = best_q[order], best_i[order], best_c[order]
                    first = np.r_[True, best_q[1:] != best_q[:-1]]
                    rank = np.arange(len(best_q)) - np.maximum.accumulate(np.where(first, np.arange(len(best_q)), 0))
                    keep = rank < k
                    best_q, best_c = best_q[keep], best_c[keep]
                    names = np.array(names)[best_i[keep]].tolist()
                    best_i = np.arange(len(names))
            if len(best_q):
                columns = [q_ids.take(pa.array(best_q)), pa.array(names, q_ids.type), pa.array(best_c)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", key, "cosine"])

        found.append(rows.mapInArrow(search, out))
    partial = reduce(DataFrame.unionByName, found)
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), key)))
    return ranked.where(F.col("rank") <= k).select("query_id", key, "rank", "cosine")


def jaccard_pairs(sets: DataFrame, block: str, threshold: float) -> DataFrame:
    """``left_id, right_id, jaccard`` of sets (``id, block, items``) of one block with at least this
    similarity. Prefix filter on the rarest items instead of all pairs."""
    items = sets.select("id", block, F.size("items").alias("size"), F.explode("items").alias("item"))
    df = items.groupBy("item").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "item")
    prefix = items.join(df, "item").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1)
    a = prefix.select(block, "item", F.col("id").alias("left_id"), F.col("size").alias("ls"))
    b = prefix.select(block, "item", F.col("id").alias("right_id"), F.col("size").alias("rs"))
    met = a.join(b, [block, "item"]).where((F.col("left_id") < F.col("right_id")) & (F.col("ls") * threshold <= F.col("rs")) & (F.col("rs") * threshold <= F.col("ls"))).select("left_id", "right_id").distinct()
    left, right = sets.select(F.col("id").alias("left_id"), F.col("items").alias("x")), sets.select(F.col("id").alias("right_id"), F.col("items").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    similarity = shared / (F.size("x") + F.size("y") - shared)
    return met.join(left, "left_id").join(right, "right_id").where(similarity >= threshold).select("left_id", "right_id", F.round(similarity, 6).alias("jaccard"))
