"""One-to-one assignments, which depend on an order or on alternating paths: grouped maps over
bounded groups (a region, a page)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import cut

#: Rounds after which the kept pairs are written together.
_COMPACT = 8


def maximum_pairs(edges: dict[int, list[int]]) -> dict[int, int]:
    """Maximum bipartite matching (right to left) by augmenting paths."""
    owner: dict[int, int] = {}

    def place(node: int, seen: set[int]) -> bool:
        for other in edges.get(node, ()):
            if other not in seen:
                seen.add(other)
                if other not in owner or place(owner[other], seen):
                    owner[other] = node
                    return True
        return False

    for node in sorted(edges):
        place(node, set())
    return owner


def maximum_matching(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, left_id, right_id``: a maximum set of overlapping pairs of spans (``id, s, e``), each
    span in at most one. Empty spans overlap nothing; null ends neither."""

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(["s", "e", "id"], ignore_index=True), b.sort_values(["s", "e", "id"], ignore_index=True)
        edges = {i: [j for j, y in enumerate(b.itertuples()) if max(x.s, y.s) < min(x.e, y.e)] for i, x in enumerate(a.itertuples())}
        owner = maximum_pairs(edges)
        rows = [(*[a.at[i, k] for k in keys], a.at[i, "id"], b.at[j, "id"]) for j, i in owner.items()]
        return pd.DataFrame(rows, columns=[*keys, "left_id", "right_id"])

    kinds = dict(left.dtypes)
    out = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"left_id {kinds['id']}", f"right_id {kinds['id']}"])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(match, out)


def box_overlap(a, b) -> float:
    """Intersection over union of two boxes; 0 for boxes without area."""
    w, h = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - w * h)


def greedy_boxes(left: DataFrame, right: DataFrame, key: str, least: float = 0.05) -> DataFrame:
    """``key, left_id, right_id, iou``: pairs of boxes (``id, x0, y0, x1, y1``) taken from the best
    overlap downwards, each box once; ties by the ids, smaller first."""

    def assign(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(((-o, x.id, y.id) for x in a.itertuples() for y in b.itertuples() if (o := box_overlap(x, y)) >= least))
        used: set[str] = set()
        rows = []
        for o, x, y in pairs:
            if ("l", x) not in used and ("r", y) not in used:
                used |= {("l", x), ("r", y)}
                rows.append((a[key].iloc[0], x, y, round(-o, 6)))
        return pd.DataFrame(rows, columns=[key, "left_id", "right_id", "iou"])

    kinds = dict(left.dtypes)
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(assign, f"{key} {kinds[key]}, left_id {kinds['id']}, right_id {kinds['id']}, iou double")


def degree_capped(pairs: DataFrame, kind: str, most: int) -> DataFrame:
    """``kind, a, b, score``: pairs kept greedily from the best score downwards (ties by the ids)
    while both ends have fewer than ``most`` kept pairs.

    The greedy choice is reached by rounds instead of one sorted pass: in each round the pairs are
    ranked at both ends among those still undecided, pairs whose rank is within the room left at
    both ends are kept, and pairs at a full end are dropped. Equal to the sequential result.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    rest = cut(pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").groupBy(kind, a.alias("a"), b.alias("b")).agg(F.max("score").alias("score")))
    empty, kept, rounds = rest.limit(0), None, 0
    while not rest.isEmpty():
        order = [F.desc("score"), "a", "b"]
        ends = rest.select(kind, "a", "b", "score", F.explode(F.array("a", "b")).alias("end"))
        if kept is not None:
            full = kept.select(kind, F.explode(F.array("a", "b")).alias("end")).groupBy(kind, "end").agg(F.count("*").alias("have"))
            ends = ends.join(full, [kind, "end"], "left")
        room = F.lit(most) - (F.coalesce("have", F.lit(0)) if kept is not None else F.lit(0))
        ranked = ends.withColumn("room", room).withColumn("rank", F.row_number().over(Window.partitionBy(kind, "end").orderBy(*order)))
        verdict = ranked.groupBy(kind, "a", "b", "score").agg(F.bool_and(F.col("rank") <= F.col("room")).alias("keep"), F.bool_or(F.col("room") <= 0).alias("full"))
        verdict = cut(verdict.where("NOT full"))  # one table a round, which holds what was kept and what is open
        taken = verdict.where("keep").select(kind, "a", "b", "score")
        kept, rounds = taken if kept is None else kept.unionByName(taken), rounds + 1
        if rounds % _COMPACT == 0:
            kept = cut(kept)
        rest = verdict.where("NOT keep").select(kind, "a", "b", "score")
    return empty if kept is None else kept
