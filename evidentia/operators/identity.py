"""Candidates for identity: links of names to a catalogue and pairs of profiles."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import identity_key, nfc
from evidentia.operators.matching import degree_capped
from evidentia.operators.retrieval import jaccard_pairs
from evidentia.session import cut


def normal_name(name: str):
    """A name composed, in small case, without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(nfc(name)), r"[\s\p{P}\p{S}]", "")


def _bags(names: DataFrame) -> DataFrame:
    """``kind, name, size, item``: the characters of distinct names, repeated ones told apart by a number,
    so that the overlap of two sets is that of the multisets."""
    chars = names.select("kind", "name", F.posexplode(F.split("name", "")).alias("at", "c")).where("c <> ''")
    copy = F.row_number().over(Window.partitionBy("kind", "name", "c").orderBy("at"))
    return chars.select("kind", "name", F.char_length("name").alias("size"), F.concat("c", F.lit("#"), copy).alias("item"))


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``kind, name, other, ratio`` of distinct non-empty names (``kind, name``) of one kind whose
    similarity by matching blocks is at least this.

    Exact: the ratio of two names is at most twice the overlap of their characters over the sum of
    their lengths, so a prefix filter on the rarest characters loses no pair; what it leaves is
    compared in Arrow batches.
    """
    a, b = cut(_bags(left)), cut(_bags(right))
    rarity = a.select("item").unionByName(b.select("item")).groupBy("item").agg(F.count("*").alias("df"))

    def prefix(bags: DataFrame) -> DataFrame:
        ranked = bags.join(rarity, "item").withColumn("rank", F.row_number().over(Window.partitionBy("kind", "name").orderBy("df", "item")))
        # the overlap is at least this share of the longer and of the shorter name
        return ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * F.lit(least / (2 - least)) - 1e-9) + 1)

    met = prefix(a).select("kind", "item", "name", "size").join(prefix(b).select("kind", "item", F.col("name").alias("other"), F.col("size").alias("n")), ["kind", "item"])
    near = met.where(2 * F.least("size", "n") >= least * (F.col("size") + F.col("n")) - 1e-9).select("kind", "name", "other").distinct()
    schema = pa.schema([("kind", pa.string()), ("name", pa.string()), ("other", pa.string()), ("ratio", pa.float64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names, others = (batch.column(c).to_pylist() for c in ("kind", "name", "other"))
            matcher, last, ratios = difflib.SequenceMatcher(None), None, []
            for name, other in zip(names, others, strict=True):
                if other != last:
                    matcher.set_seq2(other)
                    last = other
                matcher.set_seq1(name)
                ratios.append(matcher.ratio() if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((kinds, names, others, ratios), schema, strict=True)], schema=schema)

    return near.mapInArrow(compare, "kind string, name string, other string, ratio double").where(F.col("ratio") >= least)


def link_candidates(names: DataFrame, catalogue: DataFrame, most: int = 5, least: float = 0.72) -> DataFrame:
    """``entity_type, name, rank, entity_id, score``: for each distinct typed name the ``most`` best
    entities of its type, and last (with a null entity) the option that it is none of them.

    Names are compared normalised: equal ones score 1, others the ratio of matching blocks from ``least``
    on, the best over an entity's names; ties by the entity's id. None scores what is lacking of the
    best, but 0.05 at least. Names that are null or have no letters have only that option.
    """
    typed = names.where("name IS NOT NULL").select("entity_type", "name").distinct().withColumn("key", normal_name("name"))
    listed = F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    known = cut(catalogue.select("entity_id", "entity_type", listed.alias("value")).where("value IS NOT NULL").select("entity_id", "entity_type", normal_name("value").alias("other")).where("other <> ''").distinct())
    typed = cut(typed)
    near = similar_names(typed.where("key <> ''").select(F.col("entity_type").alias("kind"), F.col("key").alias("name")).distinct(), known.select(F.col("entity_type").alias("kind"), F.col("other").alias("name")).distinct(), least)
    scored = near.select(F.col("kind").alias("entity_type"), F.col("name").alias("key"), "other", F.when(F.col("name") == F.col("other"), 1.0).otherwise(F.col("ratio")).alias("score"))
    per = scored.join(known, ["entity_type", "other"]).groupBy("entity_type", "key", "entity_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("entity_type", "key").orderBy(F.desc("score"), "entity_id"))
    best = cut(per.withColumn("rank", rank).where(F.col("rank") <= most))
    found = typed.join(best, ["entity_type", "key"]).select("entity_type", "name", "rank", "entity_id", F.round("score", 6).alias("score"))
    top = best.groupBy("entity_type", "key").agg(F.max("score").alias("top"), F.count("*").alias("n"))
    top_score, n = F.coalesce("top", F.lit(0.0)), F.coalesce("n", F.lit(0))
    none = typed.join(top, ["entity_type", "key"], "left").select("entity_type", "name", (n + 1).cast("int").alias("rank"), F.lit(None).cast("string").alias("entity_id"), F.round(F.greatest(F.lit(0.05), 1 - top_score), 6).alias("score"))
    return found.unionByName(none)


def candidate_pairs(profiles: DataFrame, most: int = 20, least: float = 0.35, scorer: Callable[[DataFrame], DataFrame] | None = None, further: DataFrame | None = None) -> DataFrame:
    """``entity_type, left_id, right_id, exact, score, rank`` of profiles (``profile_id, entity_type,
    names``) of one type that may be the same: those that share a normalised name, those with names
    whose sets of characters have at least this Jaccard similarity, and ``further`` pairs (``entity_type,
    left_id, right_id, score``), such as nearest neighbours of embeddings.

    A ``scorer`` (pairs with ``left_id, right_id`` in, ``left_id, right_id, score`` out) replaces the
    similarity. Pairs are kept from the best score downwards while both profiles have fewer than
    ``most``; ``rank`` counts the pairs of the smaller profile.
    """
    rows = profiles.where("profile_id IS NOT NULL").select("profile_id", "entity_type", F.explode("names").alias("value")).where("value IS NOT NULL")
    keys = rows.select("profile_id", "entity_type", F.regexp_replace(identity_key("value"), r"\p{M}+", "").alias("key")).where("key <> ''").distinct()
    sets = cut(keys.withColumn("items", F.array_sort(F.array_distinct(F.split("key", "")))))
    # equal names are grouped before the join, so a name that many profiles have is compared once
    forms = sets.select("entity_type", "key", "items").distinct().select(F.struct("entity_type", "key").alias("id"), "entity_type", "items")
    alike = jaccard_pairs(forms, "entity_type", least).select(F.col("left_id.entity_type").alias("entity_type"), F.col("left_id.key").alias("x"), F.col("right_id.key").alias("y"), F.col("jaccard").alias("score"), F.lit(False).alias("exact"))
    same = forms.select("entity_type", F.col("id.key").alias("x"), F.col("id.key").alias("y"), F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    a, b = sets.select("entity_type", F.col("key").alias("x"), F.col("profile_id").alias("p")), sets.select("entity_type", F.col("key").alias("y"), F.col("profile_id").alias("q"))
    met = alike.unionByName(same).join(a, ["entity_type", "x"]).join(b, ["entity_type", "y"]).where("p <> q")
    pairs = met.groupBy("entity_type", F.least("p", "q").alias("left_id"), F.greatest("p", "q").alias("right_id")).agg(F.max("score").alias("score"), F.bool_or("exact").alias("exact"))
    if further is not None:
        both = pairs.unionByName(further.select("entity_type", F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "score", F.lit(False).alias("exact")))
        pairs = both.groupBy("entity_type", "left_id", "right_id").agg(F.max("score").alias("score"), F.bool_or("exact").alias("exact"))
    pairs = cut(pairs)
    if scorer is not None:
        pairs = cut(pairs.drop("score").join(scorer(pairs), ["left_id", "right_id"]))
    kept = degree_capped(pairs.select("entity_type", F.col("left_id").alias("a"), F.col("right_id").alias("b"), "score"), "entity_type", most)
    kept = kept.select("entity_type", F.col("a").alias("left_id"), F.col("b").alias("right_id"), "score")
    rank = F.row_number().over(Window.partitionBy("entity_type", "left_id").orderBy(F.desc("score"), "right_id"))
    return kept.join(pairs.select("left_id", "right_id", "exact"), ["left_id", "right_id"]).select("entity_type", "left_id", "right_id", "exact", F.round("score", 6).alias("score"), rank.alias("rank"))
