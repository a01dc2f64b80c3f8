"""Queries that build and check derived tables: articles, proposals, cohorts, links, plans and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import identity, merges, selection, timeline
from evidentia.plans import relational
from evidentia.plans.relational import I, M, P, R, V, X, cur, live_mentions, live_regions, live_versions
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


@query(f"""SELECT (SELECT count(DISTINCT page_id) FROM {R}) AS pages, (SELECT count(*) FROM {R}) AS regions, (SELECT coalesce(sum(length(coalesce(normalized_text, raw_text))), 0)::BIGINT FROM {R}) AS chars,
(SELECT count(DISTINCT run_id) FROM {R}) AS runs, (SELECT count(DISTINCT extractor || coalesce(model_name, '')) FROM {M}) AS extraction_runs, (SELECT count(*) FROM {M}) AS mentions, (SELECT count(DISTINCT source_uri) FROM {R}) AS sources""")
def archive_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts over regions and mentions, each table read once."""
    regions = live_regions(spark, d, "page_id", "run_id", "source_uri", "normalized_text", "raw_text").agg(
        F.countDistinct("page_id").alias("pages"), F.count("*").alias("regions"), F.coalesce(F.sum(F.char_length(F.coalesce("normalized_text", "raw_text"))), F.lit(0)).alias("chars"),
        F.countDistinct("run_id").alias("runs"), F.countDistinct("source_uri").alias("sources"),
    )
    run = F.concat("extractor", F.coalesce("model_name", F.lit("")))
    mentions = live_mentions(spark, d, "extractor", "model_name").agg(F.countDistinct(run).alias("extraction_runs"), F.count("*").alias("mentions"))
    return regions.crossJoin(F.broadcast(mentions))  # one row each


@query(f"""SELECT p.event_participant_id, p.event_id, m.mention_id, r.region_id, r.page_id, v.text_version_id, q.text_version_id AS parent_id, coalesce(lower(x.canonical_entity_id), lower(m.entity_id)) AS entity_id, a.canonical_name, y.docs
FROM {P} p JOIN {M} m ON m.mention_id = lower(p.mention_id) JOIN {R} r ON r.region_id = m.region_id
LEFT JOIN (SELECT * FROM {V} QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY created_at DESC, text_version_id DESC) = 1) v ON v.region_id = r.region_id
LEFT JOIN {V} q ON q.text_version_id = lower(v.parent_text_version_id)
LEFT JOIN (SELECT lower(superseded_entity_id) AS s, min(canonical_entity_id) AS canonical_entity_id FROM {X} GROUP BY 1) x ON x.s = lower(m.entity_id)
LEFT JOIN authority_entity a ON a.entity_id = coalesce(lower(x.canonical_entity_id), lower(m.entity_id))
LEFT JOIN (SELECT source, count(*) AS docs FROM documents GROUP BY 1) y ON y.source = r.source_uri WHERE p.review_status = 'reviewed'""")
def provenance_star(spark: SparkSession, d: str) -> DataFrame:
    """From each reviewed participant to its mention, region, page, text version and the one before,
    redirected entity, catalogue name and source: eight tables. The catalogue is of fixed size; the
    engine broadcasts what it knows to be small."""
    people = current(load(spark, d, "event_participant"), "event_participant_id", "event_id", "mention_id", "review_status").where("review_status = 'reviewed' AND mention_id IS NOT NULL")
    people = people.select("event_participant_id", "event_id", F.lower("mention_id").alias("mention_id"))
    versions = live_versions(spark, d, "region_id", "parent_text_version_id", "created_at")
    newest = versions.groupBy("region_id").agg(F.max_by(F.struct("text_version_id", F.lower("parent_text_version_id").alias("p")), F.struct("created_at", "text_version_id")).alias("v"))
    latest = newest.select("region_id", F.col("v.text_version_id").alias("text_version_id"), F.col("v.p").alias("p"))
    redirects = current(load(spark, d, "entity_redirect"), "entity_redirect_id", "superseded_entity_id", "canonical_entity_id", "reversed_at").where("reversed_at IS NULL")
    hop = redirects.groupBy(F.lower("superseded_entity_id").alias("e")).agg(F.lower(F.min("canonical_entity_id")).alias("to"))
    names = load(spark, d, "authority_entity").select("entity_id", "canonical_name")
    sources = load(spark, d, "documents").groupBy(F.col("source").alias("source_uri")).agg(F.count("*").alias("docs"))
    rows = people.join(live_mentions(spark, d, "region_id", "entity_id"), "mention_id").withColumn("e", F.lower("entity_id")).drop("entity_id")
    rows = rows.join(live_regions(spark, d, "page_id", "source_uri"), "region_id").join(latest, "region_id", "left")
    rows = rows.join(versions.select(F.col("text_version_id").alias("parent_id")), F.col("p") == F.col("parent_id"), "left")
    rows = rows.join(hop, "e", "left").withColumn("entity_id", F.coalesce("to", "e")).join(names, "entity_id", "left").join(sources, "source_uri", "left")
    return rows.select("event_participant_id", "event_id", "mention_id", "region_id", "page_id", "text_version_id", "parent_id", "entity_id", "canonical_name", "docs")


@query("""WITH a AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), b AS (SELECT DISTINCT source_uri AS source FROM ocr_region WHERE source_uri IS NOT NULL)
SELECT (SELECT count(*) FROM a) AS wanted, (SELECT count(*) FROM b) AS present, (SELECT count(*) FROM a ANTI JOIN b USING (source)) AS missing, (SELECT count(*) FROM b ANTI JOIN a USING (source)) AS unexpected,
(SELECT count(*) FROM a ANTI JOIN b USING (source)) + (SELECT count(*) FROM b ANTI JOIN a USING (source)) = 0 AS covered""")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sources of documents and of regions are the same set, and what either lacks."""
    a = load(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("k"))
    b = load(spark, d, "ocr_region").where("source_uri IS NOT NULL").select(F.col("source_uri").alias("k"))
    return merges.coverage(a, b, "k")


@query(f"""WITH c AS (SELECT lower(canonical_entity_id) AS cluster, unnest([lower(left_profile_id), lower(right_profile_id)]) AS profile FROM {I} WHERE model_decision = 'SAME' AND canonical_entity_id IS NOT NULL),
k AS (SELECT profile, count(DISTINCT cluster) AS n FROM c GROUP BY 1), e AS (SELECT DISTINCT unnest([lower(left_profile_id), lower(right_profile_id)]) AS profile FROM {I})
SELECT count(*) AS profiles, count(*) FILTER (n IS NULL) AS unassigned, count(*) FILTER (n = 1) AS once, count(*) FILTER (n > 1) AS several FROM e LEFT JOIN k USING (profile)""")
def cluster_partition(spark: SparkSession, d: str) -> DataFrame:
    """Whether clusters part the profiles: how many are in none, exactly one or several of them."""
    state = current(load(spark, d, "identity_pair_review"), "identity_pair_decision_id", "left_profile_id", "right_profile_id", "model_decision", "canonical_entity_id")
    ends = F.explode(F.array(F.lower("left_profile_id"), F.lower("right_profile_id"))).alias("profile")
    members = state.where("model_decision = 'SAME' AND canonical_entity_id IS NOT NULL").select(F.lower("canonical_entity_id").alias("cluster"), ends)
    return merges.partition_check(state.select(ends), members, "profile", "cluster").withColumnRenamed("members", "profiles")


_CLOSURE = f"""WITH RECURSIVE v AS (SELECT text_version_id AS id, lower(parent_text_version_id) AS p, deleted_at IS NOT NULL AS gone FROM {cur('text_version', 'text_version_id')}),
w AS (SELECT id AS root, id FROM v WHERE gone UNION SELECT w.root, v.id FROM w JOIN v ON v.p = w.id)"""


@query(f"""{_CLOSURE} SELECT w.id AS text_version_id FROM w JOIN v USING (id) WHERE w.id <> w.root AND NOT v.gone
AND NOT EXISTS (SELECT 1 FROM v s WHERE s.p = v.p AND s.id <> v.id AND s.gone) GROUP BY 1""")
def reopened_versions(spark: SparkSession, d: str) -> DataFrame:
    """What may be reopened after failures (deleted versions): their descendants, near or far, that did
    not fail themselves and none of whose siblings did."""
    state = current(load(spark, d, "text_version"), "text_version_id", "parent_text_version_id", "deleted_at").select("text_version_id", F.lower("parent_text_version_id").alias("p"), F.col("deleted_at").isNotNull().alias("gone"))
    return timeline.reopened(state, "text_version_id", "p", "gone")


@query(f"""SELECT page_id, region_id, variant, text_version_id FROM (SELECT r.page_id, r.region_id, v.variant, v.text_version_id, row_number() OVER (PARTITION BY r.region_id ORDER BY v.text_version_id) AS k FROM {R} r JOIN {V} v ON v.region_id = r.region_id AND v.parent_text_version_id IS NULL) WHERE k = 1""")
def first_versions(spark: SparkSession, d: str) -> DataFrame:
    """Insert if absent under a partial index: of the first versions (those without a parent) of a region one is kept, others are left out."""
    fresh = live_versions(spark, d, "region_id", "variant", "parent_text_version_id").where("parent_text_version_id IS NULL")
    kept = merges.insert_absent_where(fresh.limit(0), fresh, ["region_id"], F.col("parent_text_version_id").isNull(), ["text_version_id"])
    return live_regions(spark, d, "page_id").join(kept, "region_id").select("page_id", "region_id", "variant", "text_version_id")


@query(f"""WITH o AS (SELECT region_id, text_version_id AS v FROM {V} WHERE parent_text_version_id IS NULL QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY text_version_id) = 1),
s AS (SELECT region_id, max(text_version_id) AS v FROM {V} WHERE review_status = 'reviewed' GROUP BY 1), c AS (SELECT o.region_id, o.v, s.v IS NOT NULL AND s.v <> o.v AS closed FROM o LEFT JOIN s USING (region_id))
SELECT region_id, v AS text_version_id, NOT closed AS active FROM c UNION ALL SELECT s.region_id, s.v, true FROM s LEFT JOIN o USING (region_id) WHERE o.v IS NULL OR o.v <> s.v""")
def activated_versions(spark: SparkSession, d: str) -> DataFrame:
    """Supersede, then insert: the first version of a region is active until a reviewed one is selected.
    Selecting the active one again changes nothing."""
    v = live_versions(spark, d, "region_id", "review_status", "parent_text_version_id")
    none = F.lit(None).cast("timestamp")
    first = v.where("parent_text_version_id IS NULL").groupBy("region_id").agg(F.min("text_version_id").alias("text_version_id")).select("region_id", "text_version_id", F.lit("2020-01-01").cast("timestamp").alias("selected_at"), none.alias("superseded_at"))
    wanted = v.where("review_status = 'reviewed'").groupBy("region_id").agg(F.max("text_version_id").alias("text_version_id"))
    fresh = wanted.join(first.select("region_id", "text_version_id"), ["region_id", "text_version_id"], "left_anti")
    return merges.activate(first, fresh, "region_id", F.lit("2024-01-01").cast("timestamp")).select("region_id", "text_version_id", F.col("superseded_at").isNull().alias("active"))


@query(f"""WITH d AS (SELECT source, doc_id, n_chars, variant FROM documents WHERE n_chars IS NOT NULL), m AS (SELECT variant, source, median(n_chars) AS m FROM d GROUP BY 1, 2), g AS (SELECT variant, median(n_chars) AS g FROM d GROUP BY 1),
k AS (SELECT variant, source FROM m JOIN g USING (variant) QUALIFY row_number() OVER (PARTITION BY variant ORDER BY abs(m - g), source) = 1),
s AS (SELECT variant, source, doc_id, row_number() OVER (PARTITION BY variant ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY variant) AS n FROM d JOIN k USING (variant, source))
SELECT variant, source, doc_id FROM s WHERE n <= 3 OR list_contains([round_even(k * (n - 1) / 2.0, 0)::BIGINT + 1 FOR k IN [0, 1, 2]], i)""")
def stratified_plan(spark: SparkSession, d: str) -> DataFrame:
    """For each variant the source whose median length is nearest to that of the variant, and three
    evenly spaced documents of it."""
    rows = load(spark, d, "documents").where("n_chars IS NOT NULL").select("variant", "source", "doc_id", "n_chars")
    medians = rows.groupBy("variant", "source").agg(F.median("n_chars").alias("m"))
    whole = rows.groupBy("variant").agg(F.median("n_chars").alias("g"))
    chosen = selection.first_of(medians.join(whole, "variant"), ["variant"], [F.abs(F.col("m") - F.col("g")), "source"], ["source"])
    return selection.evenly_spaced(rows.join(chosen, ["variant", "source"]), ["variant"], ["doc_id"], 3).select("variant", "source", "doc_id")


@query(f"""WITH r AS (SELECT mention_id, unnest(list_filter([CASE WHEN confidence IS NULL THEN 'a unscored' END, CASE WHEN confidence < 0.6 THEN 'b doubtful' END, CASE WHEN extractor IS NULL THEN 'c unknown' END, 'd any'], lambda x: x IS NOT NULL)) AS reason, sha256('packet:' || mention_id) AS h FROM {M}),
q AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY h) AS k FROM r), s AS (SELECT mention_id, min(reason) AS reason FROM q WHERE k <= 10 GROUP BY 1),
f AS (SELECT mention_id, 'fill' AS reason FROM (SELECT DISTINCT mention_id, h FROM r) ANTI JOIN s USING (mention_id) ORDER BY h LIMIT greatest(0, 50 - (SELECT count(*) FROM s)))
SELECT * FROM s UNION ALL SELECT * FROM f""")
def quota_with_fill(spark: SparkSession, d: str) -> DataFrame:
    """Ten mentions for each reason (a mention may have several and is taken once, for the first), filled
    up to fifty by the same stable order."""
    reasons = F.array_compact(F.array(F.when(F.col("confidence").isNull(), "a unscored"), F.when(F.col("confidence") < 0.6, "b doubtful"), F.when(F.col("extractor").isNull(), "c unknown"), F.lit("d any")))
    rows = live_mentions(spark, d, "confidence", "extractor").select("mention_id", reasons.alias("reasons"), F.sha2(F.concat(F.lit("packet:"), "mention_id"), 256).alias("h"))
    return selection.quota(rows, "mention_id", "reasons", "h", 10, 50)


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near FROM events GROUP BY 1""")
def approximate_counts(spark: SparkSession, d: str) -> DataFrame:
    """Approximate distinct counts and percentiles beside exact ones: within 5 % of relative error, and within a hundredth of rank."""
    rows = load(spark, d, "events")
    near = rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.01).alias("a"), F.percentile_approx("value", 0.5, 10_000).alias("m"),
        F.expr("percentile_cont(0.47) WITHIN GROUP (ORDER BY value)").alias("low"), F.expr("percentile_cont(0.53) WITHIN GROUP (ORDER BY value)").alias("high"),
    )
    return near.select("event_type", "n", "users", (F.abs(F.col("a") - F.col("users")) <= 0.05 * F.col("users") + 1).alias("users_near"), F.col("m").between(F.col("low"), F.col("high")).alias("median_near"))


@query(f"""WITH o AS (SELECT page_id, publication_year, reading_order, region_id, coalesce(language, '') AS l FROM {R}),
k AS (SELECT *, CASE WHEN lag(l) OVER w IS NOT DISTINCT FROM l THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY page_id ORDER BY reading_order, region_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY reading_order, region_id ROWS UNBOUNDED PRECEDING) AS island FROM k)
SELECT page_id, island::BIGINT AS island, any_value(l) AS language, count(*) AS regions FROM i GROUP BY 1, 2""")
def language_runs(spark: SparkSession, d: str) -> DataFrame:
    """Islands of consecutive regions of a page in one language."""
    rows = live_regions(spark, d, "page_id", "reading_order", "language").withColumn("l", F.coalesce("language", F.lit("")))
    return timeline.islands(rows, ["page_id"], ["reading_order", "region_id"], "l").groupBy("page_id", "island").agg(F.min("l").alias("language"), F.count("*").alias("regions"))


@query(f"""WITH RECURSIVE o AS (SELECT page_id, region_id, coalesce(length(raw_text), 0) AS n, confidence, row_number() OVER (PARTITION BY page_id ORDER BY reading_order, region_id) AS i FROM {R}),
f(page_id, i, region_id, confidence, n, w, c) AS (SELECT page_id, i, region_id, confidence, n, 0, n FROM o WHERE i = 1 UNION ALL
SELECT o.page_id, o.i, o.region_id, o.confidence, o.n, CASE WHEN f.c + o.n > 400 THEN f.w + 1 ELSE f.w END, CASE WHEN f.c + o.n > 400 THEN o.n ELSE f.c + o.n END FROM f JOIN o ON o.page_id = f.page_id AND o.i = f.i + 1)
SELECT sha256('proposal:' || page_id || ':' || string_agg(region_id, ',' ORDER BY i)) AS proposal_id, page_id, w AS window_no, count(*) AS regions, round(avg(confidence), 6) AS mean_confidence FROM f GROUP BY 2, 3""")
def segmentation_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposed units of a page: windows of consecutive regions of at most 400 characters (a longer region
    is a window of its own), named by the digest of what they hold, so that proposing again changes nothing."""
    rows = live_regions(spark, d, "page_id", "reading_order", "raw_text", "confidence")
    ordered = F.array_sort(F.collect_list(F.struct("reading_order", "region_id", F.coalesce(F.char_length("raw_text"), F.lit(0)).alias("n"), "confidence")))

    def step(acc, x):
        full = (acc["c"] >= 0) & (acc["c"] + x["n"] > 400)
        w = F.when(full, acc["w"] + 1).otherwise(acc["w"])
        c = F.when(full | (acc["c"] < 0), x["n"]).otherwise(acc["c"] + x["n"])
        return F.struct(w.alias("w"), c.alias("c"), F.concat(acc["out"], F.array(F.struct(w.alias("w"), x["region_id"].alias("region_id"), x["confidence"].alias("confidence"), x["reading_order"].alias("i")))).alias("out"))

    start = F.struct(F.lit(0).alias("w"), F.lit(-1).alias("c"), F.array().cast("array<struct<w:int,region_id:string,confidence:double,i:int>>").alias("out"))
    folded = rows.groupBy("page_id").agg(F.aggregate(ordered, start, step, lambda acc: acc["out"]).alias("o"))  # a page's regions are few
    placed = folded.select("page_id", F.explode("o").alias("p")).select("page_id", "p.*")
    units = placed.groupBy("page_id", F.col("w").alias("window_no")).agg(F.array_sort(F.collect_list(F.struct("i", "region_id"))).alias("r"), F.count("*").alias("regions"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    named = F.sha2(F.concat(F.lit("proposal:"), "page_id", F.lit(":"), F.array_join(F.transform("r", lambda x: x["region_id"]), ",")), 256)
    return units.select(named.alias("proposal_id"), "page_id", "window_no", "regions", "mean_confidence")


@query(f"""WITH s AS (SELECT v.text_version_id AS unit, r.region_id, v.text_sha256 = sha256(v.text_content) AS hashed, v.region_id IS NOT NULL AS covered FROM {R} r LEFT JOIN {V} v ON v.region_id = r.region_id AND v.variant <> 'raw_ocr'),
p AS (SELECT region_id, bool_or(covered) AS covered, bool_and(coalesce(hashed, true)) AS hashed, count(unit) AS units FROM s GROUP BY 1)
SELECT rtrim(CASE WHEN NOT covered THEN 'covered,' ELSE '' END || CASE WHEN NOT hashed THEN 'hashed,' ELSE '' END || CASE WHEN units > 1 THEN 'single,' ELSE '' END, ',') AS failed, count(*) AS regions FROM p GROUP BY 1""")
def import_checks(spark: SparkSession, d: str) -> DataFrame:
    """An edited edition before it is taken over: is every region covered, do the digests agree, is there
    a single unit for each; counted by which checks fail."""
    v = live_versions(spark, d, "region_id", "variant", "text_content", "text_sha256").where("variant <> 'raw_ocr'")
    units = v.groupBy("region_id").agg(F.bool_and(F.coalesce(F.col("text_sha256") == F.sha2("text_content", 256), F.lit(True))).alias("hashed"), F.count("*").alias("units"))
    rows = live_regions(spark, d).join(units, "region_id", "left")
    checks = {"covered": F.col("units").isNotNull(), "hashed": F.coalesce("hashed", F.lit(True)), "single": F.coalesce("units", F.lit(0)) <= 1}
    return rows.select(C.failed(checks).alias("failed")).groupBy("failed").agg(F.count("*").alias("regions"))


@query(f"""WITH c AS (SELECT entity_type, canonical_name AS name, entity_id FROM authority_entity UNION SELECT entity_type, unnest(aliases), entity_id FROM authority_entity),
q AS (SELECT mention_id, entity_type, mention_text, confidence FROM {M} WHERE mention_status = 'candidate' ORDER BY confidence DESC NULLS LAST, mention_id LIMIT 40)
SELECT mention_id, q.confidence, coalesce(string_agg(c.entity_id, ',' ORDER BY c.entity_id), '') AS candidates FROM q LEFT JOIN c ON c.entity_type = q.entity_type AND c.name = q.mention_text GROUP BY 1, 2""")
def queue_with_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the review queue, each mention with the entities that have its name."""
    page = live_mentions(spark, d, "mention_status", "entity_type", "mention_text", "confidence").where("mention_status = 'candidate'").orderBy(F.col("confidence").desc_nulls_last(), "mention_id").limit(40)
    names = load(spark, d, "authority_entity").select("entity_type", F.explode(F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("mention_text"), "entity_id")
    found = page.join(names, ["entity_type", "mention_text"], "left").groupBy("mention_id", "confidence").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("candidates"))
    return found


@query("""WITH f AS (SELECT entity_type, sha256(string_agg(entity_id || '|' || canonical_name, chr(10) ORDER BY entity_id || '|' || canonical_name)) AS fingerprint, count(*) AS n FROM authority_entity GROUP BY 1) SELECT * FROM f""")
def catalogue_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the catalogue by type that does not depend on the order of its rows."""
    from evidentia.functions.ids import set_fingerprint

    entry = F.concat("entity_id", F.lit("|"), "canonical_name")
    return load(spark, d, "authority_entity").groupBy("entity_type").agg(set_fingerprint(entry).alias("fingerprint"), F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT entity_type, mention_text AS name, mention_id FROM {M} WHERE mention_status = 'reviewed' AND entity_id IS NULL AND mention_text <> ''),
e AS (SELECT entity_id AS profile_id, entity_type, 'entity' AS kind, list_sort(list_distinct(list_concat([canonical_name], coalesce(aliases, [])))) AS names, 0 AS mentions FROM authority_entity WHERE entity_status = 'reviewed'),
p AS (SELECT sha256(entity_type || ':' || name) AS profile_id, entity_type, 'mention' AS kind, [name] AS names, count(*) AS mentions FROM m GROUP BY entity_type, name)
SELECT profile_id, entity_type, kind, array_to_string(names, '|') AS names, mentions FROM e UNION ALL SELECT profile_id, entity_type, kind, array_to_string(names, '|'), mentions FROM p""")
def identity_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Profiles: reviewed entities with all their names, and reviewed mentions without an entity by name and type."""
    cohort = _cohort(spark, d)
    return cohort.select("profile_id", "entity_type", "kind", F.array_join("names", "|").alias("names"), "mentions")


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    entities = load(spark, d, "authority_entity").where("entity_status = 'reviewed'")
    names = F.array_sort(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    e = entities.select(F.col("entity_id").alias("profile_id"), "entity_type", F.lit("entity").alias("kind"), names.alias("names"), F.lit(0).cast("bigint").alias("mentions"))
    m = live_mentions(spark, d, "mention_status", "entity_id", "entity_type", "mention_text").where("mention_status = 'reviewed' AND entity_id IS NULL AND mention_text <> ''")
    p = m.groupBy("entity_type", "mention_text").agg(F.count("*").alias("mentions"))
    return e.unionByName(p.select(F.sha2(F.concat("entity_type", F.lit(":"), "mention_text"), 256).alias("profile_id"), "entity_type", F.lit("mention").alias("kind"), F.array("mention_text").alias("names"), "mentions"))


@query()
def identity_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of profiles to review, at most twenty for each profile, ranked: those that share a normalised
    name or have names with similar characters. No SQL; checked against brute force."""
    return identity.candidate_pairs(_cohort(spark, d), most=20)


@query()
def link_candidates(spark: SparkSession, d: str) -> DataFrame:
    """For each typed name the five best entities of its type and the option of none. No SQL, as the
    similarity is that of matching blocks; checked against brute force."""
    names = live_mentions(spark, d, "entity_type", "mention_text").where("mention_text <> ''").select("entity_type", F.col("mention_text").alias("name")).distinct()
    return identity.link_candidates(names, load(spark, d, "authority_entity"))


@query("""WITH s AS (SELECT * FROM (VALUES ('volume', 1, NULL), ('page', 2, 'volume'), ('text', 3, 'page'), ('names', 4, 'text')) AS t(stage, place, after)), v AS (SELECT source, count(DISTINCT page_number) AS pages FROM documents WHERE page_number IS NOT NULL GROUP BY 1),
p AS (SELECT source, unnest(generate_series(1, least(pages, 3)))::INT AS page FROM v), j AS (SELECT source, page, stage, place FROM p, s WHERE place > 1 UNION ALL SELECT source, 0, stage, place FROM v, s WHERE place = 1),
f AS (SELECT source, page, stage, place, sha256('volume|' || source) AS f1 FROM j)
SELECT source, page, stage, CASE place WHEN 1 THEN f1 WHEN 2 THEN sha256('page|' || page || '|' || f1) WHEN 3 THEN sha256('text|' || sha256('page|' || page || '|' || f1)) ELSE sha256('names|' || sha256('text|' || sha256('page|' || page || '|' || f1))) END AS fingerprint FROM f""")
def plan_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of volumes, their first three pages and stages. The fingerprint of a stage covers that of the
    stage before, so a change shows in everything that follows from it."""
    volumes = load(spark, d, "documents").where("page_number IS NOT NULL").groupBy("source").agg(F.countDistinct("page_number").alias("pages"))
    return timeline.expand_plan(volumes, "source", "pages", 3, ["page", "text", "names"])


@query(f"""WITH p AS (SELECT c.text_content AS a, q.text_content AS b FROM {V} c JOIN {V} q ON q.text_version_id = lower(c.parent_text_version_id) WHERE length(c.text_content) = length(q.text_content) AND length(c.text_content) > 0),
x AS (SELECT unnest(string_split(b, '')) AS ch, unnest(string_split(a, '')) AS meant FROM p), s AS (SELECT ch, meant, count(*) AS n FROM x WHERE ch <> meant GROUP BY 1, 2),
t AS (SELECT doc_id, text[1:200] AS t FROM documents WHERE variant = 'corrected_transcription'), b AS (SELECT meant, arg_max(ch, (n, ch)) AS wrong FROM s GROUP BY 1),
c AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, unnest(generate_series(0, length(t) - 1)) AS i FROM t WHERE length(t) > 0)
SELECT doc_id, count(*) AS chars, count(wrong) FILTER (('0x' || sha256('noise:' || doc_id || ':' || i)[1:7])::BIGINT < 26843545) AS changed FROM c LEFT JOIN b ON b.meant = c.ch GROUP BY 1""")
def augmented_texts(spark: SparkSession, d: str) -> DataFrame:
    """Training texts with substitutions that corrections show, put in by digest at one place in ten: how
    many characters change. The beginning of a text is what a training record holds."""
    v = live_versions(spark, d, "parent_text_version_id", "text_content")
    child = v.where("parent_text_version_id IS NOT NULL").select(F.lower("parent_text_version_id").alias("p"), F.col("text_content").alias("a"))
    pairs = child.join(v.select(F.col("text_version_id").alias("p"), F.col("text_content").alias("b")), "p").where("char_length(a) = char_length(b) AND char_length(a) > 0")
    seen = pairs.select(F.explode(F.filter(F.arrays_zip(F.split("b", "").alias("ch"), F.split("a", "").alias("meant")), lambda x: x["ch"] != x["meant"])).alias("c")).groupBy("c.ch", "c.meant").agg(F.count("*").alias("n"))
    wrong = seen.groupBy("meant").agg(F.max_by("ch", F.struct("n", "ch")).alias("wrong"))
    chars = load(spark, d, "documents").where("variant = 'corrected_transcription' AND text <> ''").select("doc_id", F.posexplode(F.split(F.substring("text", 1, 200), "")).alias("i", "ch"))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("noise"), "doc_id", "i"), 256), 1, 7), 16, 10).cast("bigint") < 26_843_545
    return chars.join(wrong, F.col("ch") == F.col("meant"), "left").groupBy("doc_id").agg(F.count("*").alias("chars"), F.count_if(F.col("wrong").isNotNull() & drawn).alias("changed"))


@query("""SELECT event_id, sha256('{"e":"' || event_type || '","p":' || json_extract_string(props, '$.k') || ',"u":' || user_id || '}') AS digest FROM events""")
def payload_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digest of JSON objects in canonical form, whatever the order of their keys."""
    from evidentia.functions.ids import canonical_digest

    payload = F.to_json(F.struct(F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("bigint").alias("p"), F.col("event_type").alias("e")))
    return load(spark, d, "events").select("event_id", canonical_digest(payload).alias("digest"))


@query("""WITH f AS (SELECT mention_id, mention_status, deleted_at IS NOT NULL AS gone, row_number() OVER (PARTITION BY mention_id ORDER BY ingested_at) AS a, row_number() OVER (PARTITION BY mention_id ORDER BY ingested_at DESC) AS b FROM mention_queue)
SELECT x.mention_id FROM f x JOIN f y USING (mention_id) WHERE x.a = 1 AND y.b = 1 AND (x.mention_status IS DISTINCT FROM y.mention_status OR x.gone <> y.gone)""")
def drifted_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Read-back of an insert that must not change anything: records that came again with another mark."""
    rows = load(spark, d, "mention_queue").withColumn("gone", F.col("deleted_at").isNotNull())
    old = merges.first_delivery(rows, "mention_id", ["mention_status", "gone"])
    return merges.drifted(old, current(rows, "mention_id", "mention_status", "gone"), "mention_id")


_SIGNALS = {"years": ("longitudinal_presence", "entity_id", "len(string_split(years, ','))"), "pages": ("multi_page_entities", "entity_id", "pages"), "degree": ("hub_profiles", "profile_id", "degree")}


@query(" UNION ALL ".join(f"SELECT '{s}' AS signal, {k} AS id, ({n})::BIGINT AS n FROM ({relational.ORACLE[q]})" for s, (q, k, n) in _SIGNALS.items()))
def insight_report(spark: SparkSession, d: str) -> DataFrame:
    """The graph's signals in one table: entities of several years, entities of several pages, hubs."""
    years = relational.longitudinal_presence(spark, d).select(F.lit("years").alias("signal"), F.col("entity_id").alias("id"), F.size(F.split("years", ",")).cast("bigint").alias("n"))
    pages = relational.multi_page_entities(spark, d).select(F.lit("pages").alias("signal"), F.col("entity_id").alias("id"), F.col("pages").alias("n"))
    hubs = relational.hub_profiles(spark, d).select(F.lit("degree").alias("signal"), F.col("profile_id").alias("id"), F.col("degree").alias("n"))
    return years.unionByName(pages).unionByName(hubs)


@query()
def article_texts(spark: SparkSession, d: str) -> DataFrame:
    """Pages as articles of their regions' newest reviewed texts: content digest and offsets, or the
    reason why an article cannot be made. No SQL, since offsets go through alignments; checked against
    brute force."""
    regions = live_regions(spark, d, "page_id", "reading_order", "raw_text").where("raw_text <> ''")
    v = live_versions(spark, d, "region_id", "review_status", "text_content", "text_sha256", "created_at").where("review_status = 'reviewed'")
    newest = v.groupBy("region_id").agg(F.max_by(F.struct("text_content", "text_sha256"), F.struct("created_at", "text_version_id")).alias("v"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("reading_order", "region_id")) - 1
    spans_ = regions.withColumn("sequence", place).join(newest, "region_id", "left").select(
        F.col("page_id").alias("article_id"), "region_id", "sequence", "raw_text", F.coalesce("v.text_content", "raw_text").alias("selected_text"), F.coalesce("v.text_sha256", F.sha2("raw_text", 256)).alias("selected_sha256"),
        F.lit(0).alias("raw_start"), F.char_length("raw_text").alias("raw_end"),
    )
    return timeline.materialize(spans_).select("article_id", "status", "reason", "parts", F.sha2("content", 256).alias("digest"), F.char_length("content").alias("size"))
