"""Relational queries of the archive: exploration, projections, queues, merges and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.operators import merges, selection
from evidentia.sources.tables import current, load

#: Exploration themes: a name and a pattern without look-around, so that any engine can run it.
THEMES = {
    "education": "school|class|teacher|女子|學校|école|Schule|училищ|先生",
    "relief": "relief|donation|捐|dons|Spenden|пожертвован|寄付",
    "health": "hospital|nurse|first aid|醫院|看護|hôpital|病院",
    "music": "autumn concert|音樂會|concert",
    "railway": "railway|locomotive|鐵路",
}


def cur(table: str, key: str) -> str:
    """SQL of the state of each record."""
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) AS rn FROM {table}) WHERE rn = 1)"


def live(spark: SparkSession, d: str, table: str, key: str, *columns: str) -> DataFrame:
    """State of the records of ``table`` that are not deleted: ``key`` and the ``columns`` asked for.
    Only these are scanned and travel through the aggregate."""
    return current(load(spark, d, table), key, *dict.fromkeys([*columns, "deleted_at"])).where("deleted_at IS NULL").drop(*{"deleted_at"} - set(columns))


def live_regions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return live(spark, d, "ocr_region", "region_id", *columns)


def live_mentions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return live(spark, d, "mention_queue", "mention_id", *columns)


def live_versions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return live(spark, d, "text_version", "text_version_id", *columns)


R, M, V = (f"(SELECT * FROM {cur(t, k)} WHERE deleted_at IS NULL)" for t, k in (("ocr_region", "region_id"), ("mention_queue", "mention_id"), ("text_version", "text_version_id")))
P = cur("event_participant", "event_participant_id")
I = cur("identity_pair_review", "identity_pair_decision_id")
X = f"(SELECT * FROM {cur('entity_redirect', 'entity_redirect_id')} WHERE reversed_at IS NULL)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _theme_rows() -> str:
    return ", ".join(f"('{name}', '{pattern}')" for name, pattern in THEMES.items())


@query(f"""
WITH t(theme_id, pattern) AS (VALUES {_theme_rows()}),
m AS (SELECT theme_id, doc_id, source, publication_year, length(text) AS size FROM t JOIN documents ON regexp_matches(text, pattern)),
s AS (SELECT theme_id, count(*) AS matched, count(DISTINCT source) AS sources, min(publication_year) AS year_start, max(publication_year) AS year_end FROM m GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY size DESC, publication_year ASC NULLS LAST, doc_id) AS example FROM m)
SELECT t.theme_id, coalesce(s.matched, 0) AS matched, coalesce(s.sources, 0) AS sources, year_start, year_end, CAST(example AS INT) AS example, doc_id
FROM t LEFT JOIN s USING (theme_id) LEFT JOIN (SELECT * FROM k WHERE example <= 3) k USING (theme_id)""")
def theme_leads(spark: SparkSession, d: str) -> DataFrame:
    """Pattern themes over all texts with totals and the three longest examples; themes without a
    match stay. One pass tags each text with its themes instead of a nested-loop join."""
    names = spark.createDataFrame([(n,) for n in THEMES], "theme_id string")
    tags = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in THEMES.items()]))
    matched = load(spark, d, "documents").select("doc_id", "source", "publication_year", F.char_length("text").alias("size"), F.explode(tags).alias("theme_id"))
    totals = matched.groupBy("theme_id").agg(F.count("*").alias("matched"), F.countDistinct("source").alias("sources"), F.min("publication_year").alias("year_start"), F.max("publication_year").alias("year_end"))
    best = Window.partitionBy("theme_id").orderBy(F.desc("size"), F.col("publication_year").asc_nulls_last(), "doc_id")
    examples = matched.withColumn("example", F.row_number().over(best)).where("example <= 3").select("theme_id", "example", "doc_id")
    return names.join(totals, "theme_id", "left").join(examples, "theme_id", "left").select(
        "theme_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matched", "sources")], "year_start", "year_end", "example", "doc_id"
    )


@query(f"""SELECT count(DISTINCT page_id) AS pages, count(*) AS regions, coalesce(sum(length(coalesce(normalized_text, raw_text))), 0)::BIGINT AS chars,
round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (confidence < 0.5) AS low, count(DISTINCT run_id) AS runs FROM {R}""")
def exploration_counts(spark: SparkSession, d: str) -> DataFrame:
    return live_regions(spark, d, "page_id", "run_id", "normalized_text", "raw_text", "confidence").agg(
        F.countDistinct("page_id").alias("pages"), F.count("*").alias("regions"),
        F.coalesce(F.sum(F.char_length(F.coalesce("normalized_text", "raw_text"))), F.lit(0)).alias("chars"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("confidence") < 0.5).alias("low"), F.countDistinct("run_id").alias("runs"),
    )


@query(f"""SELECT run_id, count(mention_id) AS mentions, count(DISTINCT m.region_id) AS cited_regions, round(avg(m.confidence), 6) AS mean_confidence
FROM (SELECT DISTINCT run_id, region_id FROM {R}) r LEFT JOIN {M} m ON m.region_id = r.region_id GROUP BY 1""")
def run_signals(spark: SparkSession, d: str) -> DataFrame:
    """Mentions per recognition run; runs without mentions stay. Mentions are summed per region
    first, so that regions with many mentions shuffle one row."""
    per_region = live_mentions(spark, d, "region_id", "confidence").groupBy("region_id").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"), F.count("confidence").alias("c"))
    runs = live_regions(spark, d, "run_id").select("run_id", "region_id").join(per_region, "region_id", "left")
    return runs.groupBy("run_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"), F.count("n").alias("cited_regions"), F.round(F.sum("s") / F.nullif(F.sum("c"), F.lit(0)), 6).alias("mean_confidence")
    )


@query(f"""
WITH k AS (SELECT DISTINCT coalesce(extractor, 'none') AS run, region_id, entity_type, text_start, text_end FROM {M}),
n AS (SELECT run, count(*) AS n FROM k GROUP BY 1),
b AS (SELECT a.run AS l, b.run AS r, count(*) AS both_n FROM k a JOIN k b USING (region_id, entity_type, text_start, text_end) WHERE a.run < b.run GROUP BY 1, 2)
SELECT x.run AS left_run, y.run AS right_run, coalesce(both_n, 0) AS agreed,
CASE WHEN x.n + y.n - coalesce(both_n, 0) = 0 THEN 1.0 ELSE round(coalesce(both_n, 0)::DOUBLE / (x.n + y.n - coalesce(both_n, 0)), 6) END AS jaccard
FROM n x JOIN n y ON x.run < y.run LEFT JOIN b ON b.l = x.run AND b.r = y.run""")
def pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Exact span agreement of every pair of extractors. The runs that share a span are collected
    per span (there are few runs), so no self-join of the spans is needed."""
    spans = live_mentions(spark, d, "extractor", "region_id", "entity_type", "text_start", "text_end").select(F.coalesce("extractor", F.lit("none")).alias("run"), "region_id", "entity_type", "text_start", "text_end")
    return selection.pairwise_jaccard(spans, "run", ["region_id", "entity_type", "text_start", "text_end"])


@query(f"""
WITH v AS (SELECT region_id, text_version_id, row_number() OVER (PARTITION BY region_id ORDER BY created_at DESC, text_version_id DESC) AS rn, length(text_content) AS size FROM {V}),
e AS (SELECT region_id, string_agg(DISTINCT lower(entity_id), ',' ORDER BY lower(entity_id)) AS entities FROM {M} WHERE entity_id IS NOT NULL GROUP BY 1)
SELECT r.region_id, page_id, publication_year, text_version_id AS latest_version, size AS latest_size, coalesce(entities, '') AS entities
FROM {R} r LEFT JOIN v ON v.region_id = r.region_id AND v.rn = 1 LEFT JOIN e ON e.region_id = r.region_id""")
def region_projection(spark: SparkSession, d: str) -> DataFrame:
    """Denormalised search document: region, latest text version, distinct entities."""
    newest = F.max_by(F.struct("text_version_id", F.char_length("text_content").alias("size")), F.struct("created_at", "text_version_id"))
    latest = live_versions(spark, d, "region_id", "text_content", "created_at").groupBy("region_id").agg(newest.alias("v")).select("region_id", F.col("v.text_version_id").alias("latest_version"), F.col("v.size").alias("latest_size"))
    entities = live_mentions(spark, d, "region_id", "entity_id").where("entity_id IS NOT NULL").select("region_id", F.lower("entity_id").alias("e")).distinct()
    lists = entities.groupBy("region_id").agg(F.array_join(F.array_sort(F.collect_list("e")), ",").alias("entities"))
    return live_regions(spark, d, "page_id", "publication_year").select("region_id", "page_id", "publication_year").join(latest, "region_id", "left").join(lists, "region_id", "left").withColumn("entities", F.coalesce("entities", F.lit("")))


@query(f"SELECT region_id, count(*) AS versions FROM {V} GROUP BY 1 HAVING bool_and(coalesce(review_status = 'reviewed', false))")
def fully_reviewed_regions(spark: SparkSession, d: str) -> DataFrame:
    """Relational division: regions all of whose text versions are reviewed."""
    reviewed = F.coalesce(F.col("review_status") == "reviewed", F.lit(False))
    return live_versions(spark, d, "region_id", "review_status").groupBy("region_id").agg(F.count("*").alias("versions"), F.bool_and(reviewed).alias("all_in")).where("all_in").drop("all_in")


@query(f"""SELECT c.text_version_id FROM {V} c WHERE c.review_status <> 'reviewed' AND NOT EXISTS
(SELECT 1 FROM {V} p WHERE p.text_version_id = lower(c.parent_text_version_id) AND p.review_status <> 'reviewed')""")
def versions_ready(spark: SparkSession, d: str) -> DataFrame:
    """Readiness: open versions without an unfinished parent."""
    versions = live_versions(spark, d, "review_status", "parent_text_version_id")
    open_versions = versions.where("review_status <> 'reviewed'").select("text_version_id", F.lower("parent_text_version_id").alias("parent"))
    return selection.ready(open_versions, "parent", open_versions.select(F.col("text_version_id").alias("parent"))).select("text_version_id")


@query(f"""SELECT entity_type, count(*) FILTER (mention_status = 'candidate') AS candidate, count(*) FILTER (mention_status = 'rejected') AS rejected,
count(*) FILTER (mention_status = 'reviewed') AS reviewed FROM {M} GROUP BY 1""")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    counts = live_mentions(spark, d, "entity_type", "mention_status").groupBy("entity_type").pivot("mention_status", ["candidate", "rejected", "reviewed"]).count()
    return counts.fillna(0, ["candidate", "rejected", "reviewed"])


@query(f"""SELECT mention_id, entity_type, confidence, (SELECT count(*) FROM {M} WHERE mention_status = 'candidate') AS total
FROM {M} WHERE mention_status = 'candidate' ORDER BY confidence DESC NULLS LAST, mention_id LIMIT 25 OFFSET 50""")
def review_queue_page(spark: SparkSession, d: str) -> DataFrame:
    """One page of the review queue beside its total; the total is a one-row join, because a window
    over everything would run in a single task."""
    queue = live_mentions(spark, d, "mention_status", "entity_type", "confidence").where("mention_status = 'candidate'")
    page = queue.select("mention_id", "entity_type", "confidence").orderBy(F.col("confidence").desc_nulls_last(), "mention_id").offset(50).limit(25)
    return page.crossJoin(queue.agg(F.count("*").alias("total")))


@query(f"""
WITH RECURSIVE x AS (SELECT DISTINCT lower(superseded_entity_id) AS a, lower(canonical_entity_id) AS b FROM {X}),
w(entity_id, cur_id, depth) AS (SELECT a, b, 1 FROM x UNION ALL SELECT w.entity_id, x.b, depth + 1 FROM w JOIN x ON x.a = w.cur_id WHERE depth < 20 AND x.b <> w.entity_id)
SELECT entity_id, min(cur_id) AS resolved_id, CAST(max(depth) AS INT) AS hops FROM (SELECT * FROM w WHERE cur_id NOT IN (SELECT a FROM x)) GROUP BY 1""")
def redirects_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Every redirected entity with the end of its chain and the number of hops."""
    state = current(load(spark, d, "entity_redirect"), "entity_redirect_id", "superseded_entity_id", "canonical_entity_id", "reversed_at").where("reversed_at IS NULL")
    return selection.follow(state.select(F.lower("superseded_entity_id").alias("src"), F.lower("canonical_entity_id").alias("dst"))).select(F.col("src").alias("entity_id"), F.col("end").alias("resolved_id"), "hops")


@query(f"""SELECT coalesce(lower(x.canonical_entity_id), lower(p.entity_id)) AS entity_id, count(*) AS roles, count(DISTINCT event_id) AS events
FROM {P} p LEFT JOIN (SELECT lower(superseded_entity_id) AS s, min(canonical_entity_id) AS canonical_entity_id FROM {X} GROUP BY 1) x ON x.s = lower(p.entity_id)
WHERE p.entity_id IS NOT NULL GROUP BY 1""")
def participants_by_entity(spark: SparkSession, d: str) -> DataFrame:
    """Redirect-resolving join, one hop."""
    state = current(load(spark, d, "entity_redirect"), "entity_redirect_id", "superseded_entity_id", "canonical_entity_id", "reversed_at").where("reversed_at IS NULL")
    hop = state.groupBy(F.lower("superseded_entity_id").alias("e")).agg(F.min("canonical_entity_id").alias("to"))
    rows = current(load(spark, d, "event_participant"), "event_participant_id", "event_id", "entity_id").where("entity_id IS NOT NULL").withColumn("e", F.lower("entity_id"))
    return rows.join(hop, "e", "left").groupBy(F.coalesce(F.lower("to"), F.col("e")).alias("entity_id")).agg(F.count("*").alias("roles"), F.countDistinct("event_id").alias("events"))


@query(f"""SELECT r.volume_number, r.region_kind, p.participant_role, count(*) AS n, count(DISTINCT r.page_id) AS pages
FROM {P} p JOIN {M} m ON m.mention_id = lower(p.mention_id) JOIN {R} r ON r.region_id = m.region_id GROUP BY 1, 2, 3""")
def reverse_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Provenance star: participant, mention, region, page."""
    people = current(load(spark, d, "event_participant"), "event_participant_id", "participant_role", "mention_id").where("mention_id IS NOT NULL")
    people = people.select("participant_role", F.lower("mention_id").alias("mention_id"))
    joined = people.join(live_mentions(spark, d, "region_id").select("mention_id", "region_id"), "mention_id").join(live_regions(spark, d, "volume_number", "region_kind", "page_id").select("region_id", "volume_number", "region_kind", "page_id"), "region_id")
    return joined.groupBy("volume_number", "region_kind", "participant_role").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query(f"""
WITH e AS (SELECT lower(left_profile_id) AS a, lower(right_profile_id) AS b FROM {I} WHERE model_decision = 'SAME'), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT a AS profile_id, count(*) AS degree FROM u GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 20""")
def hub_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The twenty vertices with most distinct neighbours, either direction."""
    state = current(load(spark, d, "identity_pair_review"), "identity_pair_decision_id", "left_profile_id", "right_profile_id", "model_decision").where("model_decision = 'SAME'")
    return selection.degrees(state.select(F.lower("left_profile_id").alias("src"), F.lower("right_profile_id").alias("dst"))).where("degree >= 2").orderBy(F.desc("degree"), "node").limit(20).select(F.col("node").alias("profile_id"), "degree")


@query(f"""SELECT lower(entity_id) AS entity_id, string_agg(DISTINCT publication_year::VARCHAR, ',' ORDER BY publication_year::VARCHAR) AS years
FROM {M} WHERE entity_id IS NOT NULL AND publication_year IS NOT NULL GROUP BY 1 HAVING count(DISTINCT publication_year) >= 2""")
def longitudinal_presence(spark: SparkSession, d: str) -> DataFrame:
    years = live_mentions(spark, d, "entity_id", "publication_year").where("entity_id IS NOT NULL AND publication_year IS NOT NULL").select(F.lower("entity_id").alias("entity_id"), F.col("publication_year").cast("string").alias("y")).distinct()
    return years.groupBy("entity_id").agg(F.array_sort(F.collect_list("y")).alias("ys")).where(F.size("ys") >= 2).select("entity_id", F.array_join("ys", ",").alias("years"))


@query(f"""SELECT lower(m.entity_id) AS entity_id, count(DISTINCT r.page_id) AS pages FROM {M} m JOIN {R} r USING (region_id)
WHERE m.entity_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT r.page_id) >= 2""")
def multi_page_entities(spark: SparkSession, d: str) -> DataFrame:
    mentions = live_mentions(spark, d, "region_id", "entity_id").where("entity_id IS NOT NULL").select("region_id", F.lower("entity_id").alias("entity_id"))
    joined = mentions.join(live_regions(spark, d, "page_id").select("region_id", "page_id"), "region_id")
    return joined.groupBy("entity_id").agg(F.countDistinct("page_id").alias("pages")).where("pages >= 2")


@query(f"""SELECT table_name, strftime(max(changed), '%Y-%m-%d %H:%M:%S') AS last_change, max(changed) > TIMESTAMPTZ '2024-01-01 00:00:00+00' AS stale FROM (
SELECT 'mention_queue' AS table_name, greatest(created_at, deleted_at) AS changed FROM mention_queue UNION ALL
SELECT 'ocr_region', greatest(created_at, deleted_at) FROM ocr_region UNION ALL SELECT 'text_version', greatest(created_at, deleted_at) FROM text_version) GROUP BY 1""")
def projection_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Whether a table changed after a projection was built (the build's time is a parameter)."""
    parts = [load(spark, d, t).select(F.lit(t).alias("table_name"), F.greatest("created_at", "deleted_at").alias("changed")) for t in ("mention_queue", "ocr_region", "text_version")]
    changes = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("table_name").agg(F.max("changed").alias("last_change"))
    built = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return changes.select("table_name", F.date_format("last_change", "yyyy-MM-dd HH:mm:ss").alias("last_change"), (F.col("last_change") > built).alias("stale"))


_RANK = "CASE variant WHEN 'approved_reconstruction' THEN 0 WHEN 'corrected_transcription' THEN 1 WHEN 'raw_ocr' THEN 2 ELSE 3 END"


@query(f"""SELECT region_id, text_version_id FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY {_RANK}, length(text_content) DESC, created_at, text_version_id) AS rn FROM {V}) WHERE rn = 1""")
def preferred_version(spark: SparkSession, d: str) -> DataFrame:
    order = [F.expr(_RANK), -F.char_length("text_content"), "created_at", "text_version_id"]
    return selection.first_of(live_versions(spark, d, "region_id", "variant", "text_content", "created_at"), ["region_id"], order, ["text_version_id"])


@query(f"""SELECT page_id, CASE WHEN count(DISTINCT language) = 1 THEN min(language) END AS language,
coalesce(string_agg(DISTINCT region_kind, ',' ORDER BY region_kind) FILTER (confidence >= 0.5), '') AS kinds FROM {R} GROUP BY 1""")
def page_profile(spark: SparkSession, d: str) -> DataFrame:
    """A single-valued column or null, and the distinct values of rows that pass a filter."""
    return live_regions(spark, d, "page_id", "language", "region_kind", "confidence").groupBy("page_id").agg(
        F.when(F.countDistinct("language") == 1, F.min("language")).alias("language"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confidence") >= 0.5, F.col("region_kind")))), ",").alias("kinds"),
    )


@query(f"""SELECT s.text_version_id FROM {V} s WHERE review_status = 'reviewed' AND EXISTS (SELECT 1 FROM {V} t WHERE t.region_id = s.region_id
AND (t.created_at, t.text_version_id) > (s.created_at, s.text_version_id) AND t.review_status <> 'reviewed')""")
def later_blockers(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed versions after which another version of the region came that is not reviewed. The last
    such version of each region is all that must be compared."""
    rows = live_versions(spark, d, "region_id", "review_status", "created_at").select("region_id", "review_status", F.struct("created_at", "text_version_id").alias("at"))
    last = rows.where("review_status <> 'reviewed'").groupBy("region_id").agg(F.max("at").alias("blocker"))
    return rows.where("review_status = 'reviewed'").join(last, "region_id").where("blocker > at").select("at.text_version_id")


@query("""SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY 1""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query("""WITH y AS (SELECT source, min(publication_year) AS year_min, max(publication_year) AS year_max, count(*) AS n FROM documents GROUP BY 1)
SELECT * FROM y WHERE year_min <= 1915 AND year_max >= 1905""")
def year_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose years overlap a given interval."""
    spans = load(spark, d, "documents").groupBy("source").agg(F.min("publication_year").alias("year_min"), F.max("publication_year").alias("year_max"), F.count("*").alias("n"))
    return spans.where(selection.overlaps("year_min", "year_max", 1905, 1915))


@query("""SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1""")
def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that stand under several ids. The ids of a group are joined only where there is more than one."""
    rows = load(spark, d, "documents").where("text <> ''").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.array_sort(F.collect_list("doc_id")).alias("ids")).where("n > 1").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("""SELECT i AS volume_number FROM (SELECT unnest(generate_series(1, 400))::INT AS i) WHERE i NOT IN
(SELECT DISTINCT volume_number FROM mention_queue WHERE volume_number IS NOT NULL)""")
def missing_volumes(spark: SparkSession, d: str) -> DataFrame:
    return selection.missing_numbers(load(spark, d, "mention_queue").select("volume_number"), 1, 400)


@query("""SELECT source, count(*) AS n, coalesce(sum(length(text)), 0)::BIGINT AS chars, count(*) FILTER (n_chars IS DISTINCT FROM length(text)) AS stale_sizes,
min(publication_year) AS first_year, max(publication_year) AS last_year, count(DISTINCT lang) AS languages FROM documents GROUP BY 1""")
def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    size = F.char_length("text")
    return load(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("chars"), F.count_if(~F.col("n_chars").eqNullSafe(size)).alias("stale_sizes"),
        F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"), F.countDistinct("lang").alias("languages"),
    )


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY ingested_at) AS first_rn, row_number() OVER (PARTITION BY mention_id ORDER BY ingested_at DESC) AS last_rn FROM mention_queue)
SELECT a.mention_id, b.mention_status, coalesce(b.normalized_text, a.normalized_text) AS normalized_text, greatest(a.confidence, b.confidence) AS confidence
FROM f a JOIN f b USING (mention_id) WHERE a.first_rn = 1 AND b.last_rn = 1""")
def upsert_conditional(spark: SparkSession, d: str) -> DataFrame:
    """Column-wise upsert of the last into the first delivery: newest status, known text kept, best confidence."""
    rows = load(spark, d, "mention_queue")
    columns = ["mention_status", "normalized_text", "confidence"]
    old = merges.first_delivery(rows, "mention_id", columns)
    new = current(rows, "mention_id", *columns)
    return merges.upsert(old, new, "mention_id", {
        "mention_status": lambda a, b: b, "normalized_text": lambda a, b: F.coalesce(b, a), "confidence": lambda a, b: F.greatest(a, b),
    })


@query("""WITH h AS (SELECT entity_redirect_id, ingested_at, reversed_at IS NOT NULL AS reversed,
lag(reversed_at IS NOT NULL) OVER (PARTITION BY entity_redirect_id ORDER BY ingested_at) AS before FROM entity_redirect),
c AS (SELECT * FROM h WHERE before IS NULL OR before <> reversed)
SELECT entity_redirect_id, reversed, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(lead(ingested_at) OVER (PARTITION BY entity_redirect_id ORDER BY ingested_at), '%Y-%m-%d %H:%M:%S') AS valid_to FROM c""")
def redirect_history(spark: SparkSession, d: str) -> DataFrame:
    """Slowly changing history from deliveries: an interval per change of the mark."""
    rows = load(spark, d, "entity_redirect").withColumn("reversed", F.col("reversed_at").isNotNull())
    intervals = merges.history(rows, "entity_redirect_id", ["reversed"], "ingested_at")
    return intervals.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("valid_from", "valid_to")})


@query(f"""SELECT 'label' AS part, entity_type AS label, count(*) AS n FROM authority_entity GROUP BY 2 UNION ALL SELECT 'label', 'region', count(*) FROM {R} UNION ALL
SELECT 'label', 'mention', count(*) FROM {M} UNION ALL SELECT 'edge', 'refers_to', count(*) FROM {M} WHERE entity_id IS NOT NULL UNION ALL
SELECT 'edge', 'in_region', count(*) FROM {M} m JOIN {R} r USING (region_id)""")
def graph_projection(spark: SparkSession, d: str) -> DataFrame:
    """Vertices and edges of the projected graph, counted by label."""
    vertices, edges = graph_tables(spark, d)
    return vertices.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("label").alias("part"), "label", "n").unionByName(
        edges.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "label", "n")
    )


def graph_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    mentions, regions = live_mentions(spark, d, "region_id", "entity_id"), live_regions(spark, d, "page_id")
    vertices = load(spark, d, "authority_entity").select(F.col("entity_id").alias("id"), F.col("entity_type").alias("label"))
    vertices = vertices.unionByName(regions.select(F.col("region_id").alias("id"), F.lit("region").alias("label"))).unionByName(mentions.select(F.col("mention_id").alias("id"), F.lit("mention").alias("label")))
    refers = mentions.where("entity_id IS NOT NULL").select(F.col("mention_id").alias("src"), F.lower("entity_id").alias("dst"), F.lit("refers_to").alias("label"))
    inside = mentions.join(regions.select("region_id"), "region_id").select(F.col("mention_id").alias("src"), F.col("region_id").alias("dst"), F.lit("in_region").alias("label"))
    return vertices, refers.unionByName(inside)


_CHECKS: dict[str, tuple[str, str, str]] = {
    "one_of_entity_or_mention": ("event_participant", "(entity_id IS NULL) = (mention_id IS NULL)", ""),
    "paired_offsets": ("candidate_record", "(text_start IS NULL) <> (text_end IS NULL)", ""),
    "ordered_offsets": ("mention_queue", "text_end < text_start", ""),
    "deleted_before_created": ("text_version", "deleted_at < created_at", ""),
    "digest_of_text": ("text_version", "text_sha256 <> sha2(text_content, 256)", "text_sha256 <> sha256(text_content)"),
    "confidence_range": ("ocr_region", "confidence < 0 OR confidence > 1", ""),
    "stale_size": ("documents", "n_chars <> char_length(text)", "n_chars <> length(text)"),
    "span_is_quote": ("mention_queue", "substring(region_text, text_start + 1, text_end - text_start) <> mention_text", ""),
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS check_name, '{t}' AS table_name, count(*) FILTER ({q or p}) AS violations, count(*) AS n FROM {t}" for n, (t, p, q) in _CHECKS.items()))
def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows that violate a named constraint; each table is scanned once, whatever its number of checks."""
    return merges.check_rows({t: load(spark, d, t) for t, _, _ in _CHECKS.values()}, {n: (t, p) for n, (t, p, _) in _CHECKS.items()})


@query(f"""WITH a AS (SELECT DISTINCT region_id, entity_type FROM {M} WHERE extractor = 'span'), b AS (SELECT DISTINCT region_id, entity_type FROM {M} WHERE extractor = 'regex')
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'span only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'regex only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def span_set_operations(spark: SparkSession, d: str) -> DataFrame:
    mentions = live_mentions(spark, d, "region_id", "entity_type", "extractor")
    a, b = (mentions.where(F.col("extractor") == e).select("region_id", "entity_type").distinct() for e in ("span", "regex"))

    def count(part: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")

    return count("both", a.intersect(b)).unionByName(count("span only", a.subtract(b))).unionByName(count("regex only", b.subtract(a)))


def year_filter(df: DataFrame, column: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Optional bounds, both inclusive; a bound that is None filters nothing, and year 0 is a bound."""
    conditions: list[Column] = ([F.col(column) >= start] if start is not None else []) + ([F.col(column) <= end] if end is not None else [])
    for condition in conditions:
        df = df.where(condition)
    return df


@query("SELECT coalesce(page_genre, 'none') AS genre, count(*) AS n FROM documents WHERE publication_year >= 1910 GROUP BY 1")
def genres_since(spark: SparkSession, d: str) -> DataFrame:
    return year_filter(load(spark, d, "documents"), "publication_year", start=1910).groupBy(F.coalesce("page_genre", F.lit("none")).alias("genre")).agg(F.count("*").alias("n"))
