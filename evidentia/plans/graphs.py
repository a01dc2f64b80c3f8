"""Queries on chains, state logs and time, and on set assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.operators import matching, selection, spans, timeline
from evidentia.plans.relational import I, M, R, V, cur, live_mentions, live_regions, live_versions
from evidentia.sources.tables import current, load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_ALL = cur("text_version", "text_version_id")


@query(f"""
WITH RECURSIVE v AS (SELECT text_version_id AS id, lower(parent_text_version_id) AS p, deleted_at IS NOT NULL AS gone FROM {_ALL}),
w AS (SELECT id AS root, id FROM v WHERE gone UNION SELECT w.root, v.id FROM w JOIN v ON v.p = w.id)
SELECT id AS text_version_id, min(root) AS root_id FROM w WHERE id <> root GROUP BY 1""")
def descendants_of_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Versions that go back to a deleted one, near or far, with the first such root."""
    state = current(load(spark, d, "text_version"), "text_version_id", "parent_text_version_id", "deleted_at")
    edges = state.where("parent_text_version_id IS NOT NULL").select(F.lower("parent_text_version_id").alias("src"), F.col("text_version_id").alias("dst"))
    roots = state.where("deleted_at IS NOT NULL").select(F.col("text_version_id").alias("node"))
    return timeline.descendants(edges, roots).select(F.col("node").alias("text_version_id"), F.col("root").alias("root_id"))


@query(f"""
WITH RECURSIVE v AS (SELECT text_version_id AS id, lower(parent_text_version_id) AS p FROM {V}),
w(id, top, depth) AS (SELECT id, id, 0 FROM v WHERE p IS NULL OR p NOT IN (SELECT id FROM v) UNION ALL SELECT v.id, w.top, depth + 1 FROM w JOIN v ON v.p = w.id)
SELECT depth, count(*) AS versions, count(DISTINCT top) AS chains FROM w GROUP BY 1""")
def version_depths(spark: SparkSession, d: str) -> DataFrame:
    """How deep the chains of versions are."""
    v = live_versions(spark, d, "parent_text_version_id").select("text_version_id", F.lower("parent_text_version_id").alias("p"))
    ids = v.select(F.col("text_version_id").alias("p"))
    child = v.join(ids, "p", "left_semi")
    ends = selection.follow(child.select(F.col("text_version_id").alias("src"), F.col("p").alias("dst"))).select("src", "end", "hops")
    tops = v.join(child.select("text_version_id"), "text_version_id", "left_anti").select(F.col("text_version_id").alias("src"), F.col("text_version_id").alias("end"), F.lit(0).alias("hops"))
    return ends.unionByName(tops).groupBy(F.col("hops").alias("depth")).agg(F.count("*").alias("versions"), F.countDistinct("end").alias("chains"))


@query("""WITH RECURSIVE e AS (SELECT lower(superseded_entity_id) AS a, lower(canonical_entity_id) AS b FROM entity_redirect UNION SELECT lower(canonical_entity_id), lower(superseded_entity_id) FROM entity_redirect WHERE reversed_at IS NOT NULL),
x AS (SELECT a, min(b) AS b FROM e WHERE a <> b GROUP BY 1), w(n, at_node) AS (SELECT a, b FROM x UNION SELECT w.n, x.b FROM w JOIN x ON x.a = w.at_node)
SELECT n AS entity_id FROM w GROUP BY 1 HAVING count(*) FILTER (at_node NOT IN (SELECT a FROM x)) = 0""")
def endless_redirects(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose chain never ends if a reversal is read as a redirect back."""
    rows = load(spark, d, "entity_redirect")
    ways = rows.select(F.lower("superseded_entity_id").alias("src"), F.lower("canonical_entity_id").alias("dst"))
    back = rows.where("reversed_at IS NOT NULL").select(F.lower("canonical_entity_id").alias("src"), F.lower("superseded_entity_id").alias("dst"))
    return selection.on_cycles(ways.unionByName(back)).select(F.col("node").alias("entity_id"))


@query(f"""SELECT page_id, count(*) AS regions, CASE WHEN bool_or(confidence < 0.3) THEN 'failed' WHEN bool_or(confidence IS NULL) THEN 'open' ELSE 'completed' END AS status FROM {R} GROUP BY 1""")
def page_status(spark: SparkSession, d: str) -> DataFrame:
    """Roll-up of states by precedence."""
    bad, unknown = F.bool_or(F.col("confidence") < 0.3), F.bool_or(F.col("confidence").isNull())
    return live_regions(spark, d, "page_id", "confidence").groupBy("page_id").agg(F.count("*").alias("regions"), F.when(bad, "failed").when(unknown, "open").otherwise("completed").alias("status"))


@query("""SELECT user_id, last_type, last_event, CASE WHEN age > INTERVAL 3 DAY THEN 'expired' ELSE 'held' END AS lease FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(event_id, (ts, event_id)) AS last_event, TIMESTAMP '2024-01-31 00:00:00' - max(ts) AS age FROM events GROUP BY 1)""")
def lease_states(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each key folded from the log, and whether its lease has run out."""
    return timeline.latest_states(load(spark, d, "events"), "user_id", "2024-01-31 00:00:00", 3 * 86_400)


@query("""SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    w = timeline.tumbling(load(spark, d, "events"), "ts", "1 day", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("""WITH b AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s, user_id FROM events)
SELECT strftime(s, '%Y-%m-%d %H') AS hour, count(*) AS n, count(DISTINCT user_id) AS users FROM b GROUP BY 1""")
def sliding_events(spark: SparkSession, d: str) -> DataFrame:
    w = load(spark, d, "events").groupBy(F.window("ts", "12 hours", "6 hours")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "n", "users")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")


@query("""SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_purchases(spark: SparkSession, d: str) -> DataFrame:
    """As-of join: the last purchase before or at each error of a user."""
    events = load(spark, d, "events")
    left, right = events.where("event_type = 'error'").select("user_id", "ts", "event_id"), events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return timeline.asof(left, right, ["user_id"], "ts", ["purchase_id"]).select("event_id", "purchase_id")


@query("""SELECT event_id, round(value - lag(value) OVER w, 6) AS change, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smooth, rank() OVER (PARTITION BY user_id ORDER BY value DESC)::INT AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def event_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, d, "events").select(
        "event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("smooth"),
        F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value"))).alias("place"),
    )


@query("""SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_totals(spark: SparkSession, d: str) -> DataFrame:
    sums = load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return sums.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "total")


@query("""SELECT r_name, year(o_orderdate) AS order_year, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def star_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Star join over five tables; the dimensions are broadcast only where the optimizer knows them to be small."""
    line = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    per_order = line.groupBy("l_orderkey").agg(F.sum("v").alias("v"))  # one row per order before the joins
    joined = per_order.join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", F.year("o_orderdate").cast("bigint").alias("order_year")).agg(F.count("*").alias("orders"), F.round(F.sum("v"), 2).alias("revenue"))


@query("""WITH y AS (SELECT volume_number, min(publication_year) AS first_year, max(publication_year) AS last_year FROM ocr_region WHERE volume_number IS NOT NULL GROUP BY 1),
o AS (SELECT doc_id, publication_year FROM documents WHERE publication_year IS NOT NULL)
SELECT doc_id, min(volume_number) AS volume_number FROM o JOIN y ON publication_year BETWEEN first_year AND last_year GROUP BY 1""")
def volume_of_year(spark: SparkSession, d: str) -> DataFrame:
    """Range lookup, first match wins. Years are few, so the ranges are spread over them and joined by equality."""
    ranges = load(spark, d, "ocr_region").where("volume_number IS NOT NULL AND publication_year IS NOT NULL").groupBy("volume_number").agg(F.min("publication_year").alias("a"), F.max("publication_year").alias("b"))
    years = ranges.select("volume_number", F.explode(F.sequence("a", "b")).alias("publication_year")).groupBy("publication_year").agg(F.min("volume_number").alias("volume_number"))
    return load(spark, d, "documents").where("publication_year IS NOT NULL").select("doc_id", "publication_year").join(years, "publication_year").select("doc_id", "volume_number")


@query(f"""WITH t AS (SELECT region_id, mention_id, text_start AS s, text_end AS e FROM {M})
SELECT a.mention_id AS inner_id, count(*) AS outer_n FROM t a JOIN t b ON a.region_id = b.region_id AND b.s <= a.s AND a.e <= b.e AND a.mention_id <> b.mention_id GROUP BY 1""")
def contained_spans(spark: SparkSession, d: str) -> DataFrame:
    """Interval containment within a region."""
    t = live_mentions(spark, d, "region_id", "text_start", "text_end").select("region_id", "mention_id", F.col("text_start").alias("s"), F.col("text_end").alias("e"))
    o = t.select("region_id", F.col("mention_id").alias("m2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return t.join(o, "region_id").where("s2 <= s AND e <= e2 AND mention_id <> m2").groupBy(F.col("mention_id").alias("inner_id")).agg(F.count("*").alias("outer_n"))


@query()
def relaxed_matches(spark: SparkSession, d: str) -> DataFrame:
    """Maximum one-to-one matching of overlapping spans of two extractors, per region and type."""
    m = live_mentions(spark, d, "region_id", "entity_type", "extractor", "text_start", "text_end")
    a, b = (m.where(F.col("extractor") == e).select("region_id", "entity_type", F.col("mention_id").alias("id"), F.col("text_start").alias("s"), F.col("text_end").alias("e")) for e in ("span", "regex"))
    return matching.maximum_matching(a, b, ["region_id", "entity_type"])


@query()
def box_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Greedy one-to-one assignment of the boxes of two runs of a page by their overlap."""
    rows = current(load(spark, d, "ocr_region"), "region_id", "page_id", "reading_order", "polygon", "deleted_at").where("deleted_at IS NULL AND polygon IS NOT NULL")
    boxes = rows.select("page_id", "reading_order", F.col("region_id").alias("id"), spans.box_of("polygon.points").alias("b")).select("page_id", "reading_order", "id", "b.*")
    return matching.greedy_boxes(boxes.where("reading_order % 2 = 0"), boxes.where("reading_order % 2 = 1"), "page_id")


@query()
def capped_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of profiles in the order of a score, each profile in at most three of them."""
    state = current(load(spark, d, "identity_pair_review"), "identity_pair_decision_id", "left_profile_id", "right_profile_id", "model_decision", "mention_resolutions")
    pairs = state.select(F.col("model_decision").alias("kind"), F.lower("left_profile_id").alias("a"), F.lower("right_profile_id").alias("b"), F.coalesce("mention_resolutions", F.lit(0)).cast("double").alias("score"))
    return matching.degree_capped(pairs, "kind", 3)


_RULE = r"[\p{IsHan}]{2,4}(?:女士|先生|君)|(?:Mrs?|Miss|Dr|Rev)\. [A-Z]\w+"


@query(f"""WITH t AS (SELECT region_id, raw_text, regexp_extract_all(raw_text, '[\\p{{Han}}]{{2,4}}(?:女士|先生|君)|(?:Mrs?|Miss|Dr|Rev)\\. [A-Z]\\w+') AS found, regexp_split_to_array(raw_text, '[\\p{{Han}}]{{2,4}}(?:女士|先生|君)|(?:Mrs?|Miss|Dr|Rev)\\. [A-Z]\\w+') AS between FROM {R} WHERE raw_text IS NOT NULL)
SELECT region_id, (list_sum([length(x) FOR x IN between[1:i]]) + coalesce(list_sum([length(x) FOR x IN found[1:i - 1]]), 0))::INT AS span_start,
(list_sum([length(x) FOR x IN between[1:i]]) + list_sum([length(x) FOR x IN found[1:i]]))::INT AS span_end, found[i] AS surface FROM (SELECT *, unnest(generate_series(1, len(found))) AS i FROM t)""")
def rule_spans(spark: SparkSession, d: str) -> DataFrame:
    """Rule-based mentions with offsets: every match of a pattern in the regions' texts, inside the engine."""
    return spans.pattern_spans(live_regions(spark, d, "raw_text"), "region_id", "raw_text", _RULE)


@query()
def version_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Edit operations from each version to the next, with kinds counted."""
    from evidentia.functions.text import alignment

    v = live_versions(spark, d, "parent_text_version_id", "text_content")
    child = v.where("parent_text_version_id IS NOT NULL").select("text_version_id", F.lower("parent_text_version_id").alias("p"), F.col("text_content").alias("after"))
    pairs = child.join(v.select(F.col("text_version_id").alias("p"), F.col("text_content").alias("before")), "p")
    return pairs.select("text_version_id", F.explode(alignment("before", "after")).alias("o")).groupBy("text_version_id", "o.op").agg(F.count("*").alias("n"), F.sum(F.col("o.b_end") - F.col("o.b_start")).alias("size"))


@query(f"""SELECT model_decision, review_status, reused, count(*) AS n FROM {I} GROUP BY ALL""")
def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    state = current(load(spark, d, "identity_pair_review"), "identity_pair_decision_id", "model_decision", "review_status", "reused")
    return state.groupBy("model_decision", "review_status", "reused").agg(F.count("*").alias("n"))
