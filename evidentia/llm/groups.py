"""Consolidating pairwise matches into groups.

Method: two rounds of minimum propagation contract the graph, which shortens its chains; then the
component of the vertex with the highest degree is peeled off by breadth-first joins from that
vertex, frontier by frontier, and anti-joined away; what is left are small components,
which are labelled by propagating the smallest vertex along the edges until nothing changes. Every
round also follows the labels one step (the label of a vertex becomes the label of its label), so
that long chains need few rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.session import cut
from evidentia.sources.tables import current, load

#: Levels of the search after which the visited vertices are written together.
_COMPACT = 8
#: Vertices in one part of what is written.
_PART = 1_000_000
#: Vertices of two levels that may be broadcast (some 40 bytes each).
_SMALL = 250_000


def _undirected(edges: DataFrame) -> DataFrame:
    proper = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return proper.select("src", "dst").union(proper.select(F.col("dst"), F.col("src"))).distinct()


def _reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All vertices reachable from ``start`` (one column ``node``). A neighbour of level k lies in
    level k-1, k or k+1, so a new frontier is anti-joined with the last two levels only. Frontiers
    are counted; those within ``_SMALL`` are broadcast, larger ones are shuffled."""
    before, front, size, last, visited = start.limit(0), start, 1, 1, 1
    done, open_levels = [], [front]
    while True:
        seen = before.union(front)
        small = F.broadcast if size <= _SMALL else (lambda df: df)
        step = edges.join(small(front), edges.src == front.node, "left_semi").select(F.col("dst").alias("node"))
        step = cut(step.join(small(seen), "node", "left_anti").distinct())
        found = step.count()
        if not found:
            return reduce(DataFrame.union, done + open_levels)
        before, front, size, last, visited = front, step, found + last, found, visited + found
        open_levels.append(step)
        if len(open_levels) >= _COMPACT:
            # as many parts as the visited vertices need
            older = reduce(DataFrame.union, open_levels[:-2])
            done.append(cut(older.coalesce(max(8, visited // _PART + 1))))
            open_levels = open_levels[-2:]


def _propagate(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest vertex of each component, by minimum propagation."""
    labels = cut(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")))
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ahead = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = cut(lower.join(ahead, "label").select("node", "old", F.col("next").alias("label")))
        changed = labels.where(F.col("old") != F.col("label")).isEmpty()
        labels = labels.select("node", "label")
        if changed:
            return labels


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of minimum propagation over everything, and the edges between what it leaves: each
    vertex goes to the smallest vertex next to it and on to where that one goes. Shortens the paths
    that the search has to walk level by level."""
    near = edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label"))
    near = cut(near)
    ahead = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
    labels = cut(near.join(ahead, "label").select("node", F.col("next").alias("label")))
    a = labels.select(F.col("node").alias("src"), F.col("label").alias("x"))
    b = labels.select(F.col("node").alias("dst"), F.col("label").alias("y"))
    shorter = edges.join(a, "src").join(b, "dst").where("x <> y").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct()
    return labels, cut(shorter)


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every vertex of the pairs ``src, dst``; the label is the smallest vertex
    of the component. Pairs with a null end and pairs of a vertex with itself tie nothing and are
    dropped; repeated pairs and pairs in both orders count once; no pairs give no rows. Extra
    columns of ``edges`` are ignored."""
    edges = cut(_undirected(edges))
    vertices, edges = _contract(edges)
    within, edges = _contract(edges)
    found = _peel_and_label(edges)
    for labels in (within, vertices):  # what a contracted vertex belongs to, back to the vertices
        further = found.select(F.col("node").alias("label"), F.col("label").alias("last"))
        found = labels.join(further, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return found


def _peel_and_label(edges: DataFrame) -> DataFrame:
    hub = cut(edges.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).select(F.col("src").alias("node")))
    if hub.isEmpty():
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("label"))
    giant = cut(_reach(edges, hub))
    first = giant.agg(F.min("node").alias("label"))  # one row
    rest = cut(edges.join(giant, edges.src == giant.node, "left_anti"))
    return giant.crossJoin(F.broadcast(first)).unionByName(_propagate(rest))


def review_ties(reviews: DataFrame, redirects: DataFrame) -> DataFrame:
    """Pairs ``src, dst`` of accepted reviews and unreversed redirects. Profiles are written as
    ``p:id`` and entities as ``q:id``, so that the smallest vertex of a group is a profile."""
    state = current(
        reviews, "identity_pair_decision_id", "left_profile_id", "right_profile_id", "model_decision", "review_status", "canonical_entity_id"
    ).where("model_decision = 'SAME' AND review_status = 'reviewed'")
    standing = current(redirects, "entity_redirect_id", "superseded_entity_id", "canonical_entity_id", "reversed_at").where("reversed_at IS NULL")

    def name(mark: str, column: str):
        return F.concat(F.lit(f"{mark}:"), F.lower(column))

    left, right, entity = name("p", "left_profile_id"), name("p", "right_profile_id"), name("q", "canonical_entity_id")
    ties = state.select(F.explode(F.array(F.struct(left.alias("src"), right.alias("dst")), F.struct(left.alias("src"), entity.alias("dst")), F.struct(right.alias("src"), entity.alias("dst")))).alias("t")).select("t.*")
    return ties.unionByName(standing.select(name("q", "superseded_entity_id").alias("src"), entity.alias("dst")))


def profile_groups(reviews: DataFrame, redirects: DataFrame) -> DataFrame:
    """``profile_id, group_id`` of every profile whose group has at least two profiles; group_id is
    the smallest profile of the group. The ids are lower case."""
    marked = components(review_ties(reviews, redirects)).where("startswith(node, 'p:') AND startswith(label, 'p:')")
    alone = marked.groupBy("label").agg(F.count("*").alias("n")).where("n < 2").select("label")
    return marked.join(alone, "label", "left_anti").select(
        F.expr("substring(node, 3)").alias("profile_id"), F.expr("substring(label, 3)").alias("group_id")
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return profile_groups(load(spark, folder, "identity_pair_review"), load(spark, folder, "entity_redirect"))


_FOUND_SQL = """
WITH RECURSIVE r AS (
  SELECT lower(arg_max(left_profile_id, ingested_at)) l, lower(arg_max(right_profile_id, ingested_at)) r,
         lower(max_by(coalesce(canonical_entity_id, ''), ingested_at)) c,
         arg_max(model_decision, ingested_at) d, arg_max(review_status, ingested_at) s
  FROM identity_pair_review GROUP BY identity_pair_decision_id),
t AS (
  SELECT lower(arg_max(superseded_entity_id, ingested_at)) a, lower(arg_max(canonical_entity_id, ingested_at)) b,
         max_by(reversed_at IS NOT NULL, ingested_at) gone
  FROM entity_redirect GROUP BY entity_redirect_id),
e AS (
  SELECT 'p:' || l AS x, 'p:' || r AS y FROM r WHERE d = 'SAME' AND s = 'reviewed'
  UNION SELECT 'p:' || l, 'q:' || c FROM r WHERE d = 'SAME' AND s = 'reviewed' AND c <> ''
  UNION SELECT 'q:' || a, 'q:' || b FROM t WHERE NOT gone),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
w(x, y) AS (SELECT x, x FROM u WHERE x[1] = 'p' UNION SELECT w.x, u.y FROM w JOIN u ON w.y = u.x),
g AS (SELECT x, min(y) AS m, count(*) FILTER (y[1] = 'p') AS n FROM w GROUP BY x)
SELECT x[3:] AS profile_id, m[3:] AS group_id FROM g WHERE n > 1
"""

QUERIES = {"p1_found": p1_found}
ORACLE = {"p1_found": _FOUND_SQL}
