"""Queries on the text, place and identity of single records: contexts, offsets, labels, vectors and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import spans
from evidentia.plans.relational import M, R, V, live_mentions, live_regions, live_versions
from evidentia.sources.tables import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(f"SELECT mention_id, mention_text FROM {M} WHERE length(trim(mention_text)) >= 2 ORDER BY mention_id LIMIT 50")
def eligible_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty mentions (by id) whose text has two characters or more without outer spaces."""
    rows = live_mentions(spark, d, "mention_text").where(C.longer_than_blank("mention_text"))
    return rows.select("mention_id", "mention_text").orderBy("mention_id").limit(50)


@query(f"SELECT extractor, count(*) AS n, count(*) FILTER (confidence IS NULL) AS unscored FROM {M} WHERE confidence IS NULL OR confidence >= 0.6 GROUP BY 1")
def threshold_keeping_nulls(spark: SparkSession, d: str) -> DataFrame:
    rows = live_mentions(spark, d, "extractor", "confidence").where(C.passes("confidence", 0.6))
    return rows.groupBy("extractor").agg(F.count("*").alias("n"), F.count_if(F.col("confidence").isNull()).alias("unscored"))


@query(f"""WITH a AS (SELECT page_id, region_id, row_number() OVER (PARTITION BY page_id ORDER BY reading_order, region_id) AS i FROM {R} WHERE coalesce(raw_text, '') <> ''),
b AS (SELECT page_id, region_id, row_number() OVER (PARTITION BY page_id ORDER BY created_at, region_id) AS i FROM {R} WHERE confidence IS NOT NULL)
SELECT page_id, count(*) FILTER (a.region_id = b.region_id) AS same_n, count(*) FILTER (a.region_id <> b.region_id) AS other_n, count(*) FILTER (a.region_id IS NULL OR b.region_id IS NULL) AS unpaired
FROM a FULL JOIN b USING (page_id, i) GROUP BY 1""")
def ordinal_zip(spark: SparkSession, d: str) -> DataFrame:
    """Two ordered lists of each page joined by position; what one list has more than the other stays, unpaired."""
    rows = live_regions(spark, d, "page_id", "reading_order", "created_at", "raw_text", "confidence")
    a = rows.where("coalesce(raw_text, '') <> ''").select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("reading_order", "region_id")).alias("i"), F.col("region_id").alias("a"))
    b = rows.where("confidence IS NOT NULL").select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("created_at", "region_id")).alias("i"), F.col("region_id").alias("b"))
    return a.join(b, ["page_id", "i"], "full_outer").groupBy("page_id").agg(
        F.count_if(F.col("a") == F.col("b")).alias("same_n"), F.count_if(F.col("a") != F.col("b")).alias("other_n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unpaired")
    )


@query(f"""SELECT mention_id, region_text[greatest(0, text_start - 12) + 1:text_start] AS left_context, region_text[text_end + 1:text_end + 12] AS right_context FROM {M}
WHERE region_text IS NOT NULL AND text_start IS NOT NULL AND text_end IS NOT NULL""")
def mention_context(spark: SparkSession, d: str) -> DataFrame:
    """Twelve characters before and after each mention, clipped at the ends of its snippet."""
    rows = live_mentions(spark, d, "region_text", "text_start", "text_end").where("region_text IS NOT NULL AND text_start IS NOT NULL AND text_end IS NOT NULL")
    return rows.select("mention_id", C.left_context("region_text", "text_start", 12).alias("left_context"), C.right_context("region_text", "text_end", 12).alias("right_context"))


@query(f"""SELECT page_id, regions, doubtful FROM (SELECT page_id, count(*) AS regions, bool_or(confidence < 0.5) AS doubtful FROM {R} GROUP BY 1)
ORDER BY coalesce(doubtful, false) DESC, regions DESC, page_id LIMIT 30""")
def doubtful_first(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a doubtful region before the others, by a boolean; unknown counts as false."""
    pages = live_regions(spark, d, "page_id", "confidence").groupBy("page_id").agg(F.count("*").alias("regions"), F.bool_or(F.col("confidence") < 0.5).alias("doubtful"))
    return pages.orderBy(F.coalesce("doubtful", F.lit(False)).desc(), F.desc("regions"), "page_id").limit(30)


_BOX = f"(SELECT page_id, region_id, publication_year, list_min([z.x FOR z IN polygon.points]) AS x0, list_min([z.y FOR z IN polygon.points]) AS y0, list_max([z.x FOR z IN polygon.points]) AS x1, list_max([z.y FOR z IN polygon.points]) AS y1 FROM {R} WHERE len(polygon.points) > 0)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = live_regions(spark, d, "page_id", "polygon").where("size(polygon.points) > 0")
    return rows.select("page_id", "region_id", spans.box_of("polygon.points").alias("b")).select("page_id", "region_id", "b.*")


@query(f"SELECT region_id, row_number() OVER (PARTITION BY page_id ORDER BY floor(y0 / 300), -x1, region_id)::INT AS place FROM {_BOX}")
def band_order(spark: SparkSession, d: str) -> DataFrame:
    """Order of the regions of a page by bands of 300 pixels from the top, within a band from the right."""
    order = Window.partitionBy("page_id").orderBy(F.floor(F.col("y0") / 300), -F.col("x1"), "region_id")
    return _boxes(spark, d).select("region_id", F.row_number().over(order).alias("place"))


@query(f"""WITH p AS (SELECT *, max(x1) OVER (PARTITION BY page_id) AS w, max(y1) OVER (PARTITION BY page_id) AS h FROM {_BOX}),
n AS (SELECT *, floor(x0 * 1000 / w) AS nx, floor(y0 * 1000 / h) AS ny FROM p WHERE w > 0 AND h > 0)
SELECT region_id, nx::INT AS nx, ny::INT AS ny, least(greatest(round_even(nx * floor(w) / 1000, 0), 0), floor(w))::INT AS px, least(greatest(round_even(ny * floor(h) / 1000, 0), 0), floor(h))::INT AS py FROM n""")
def pixel_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Corners in thousandths of their page, and back in its pixels."""
    page = Window.partitionBy("page_id")
    rows = _boxes(spark, d).withColumns({"w": F.max("x1").over(page), "h": F.max("y1").over(page)}).where("w > 0 AND h > 0")
    rows = rows.select("region_id", F.floor(F.col("x0") * 1000 / F.col("w")).cast("int").alias("nx"), F.floor(F.col("y0") * 1000 / F.col("h")).cast("int").alias("ny"), F.floor("w").alias("w"), F.floor("h").alias("h"))
    return rows.select("region_id", "nx", "ny", C.to_pixels("nx", "w").alias("px"), C.to_pixels("ny", "h").alias("py"))


@query(f"""WITH c AS (SELECT c.text_version_id, lower(c.parent_text_version_id) AS p, c.text_content AS a, q.text_content AS b FROM {V} c JOIN {V} q ON q.text_version_id = lower(c.parent_text_version_id) WHERE c.text_content IS NOT NULL AND q.text_content IS NOT NULL),
x AS (SELECT text_version_id, ch, sum(a)::INT AS a, sum(b)::INT AS b FROM (SELECT text_version_id, unnest(string_split(regexp_replace(a, '[\\s\\x{{85}}\\p{{Z}}]', '', 'g'), '')) AS ch, 1 AS a, 0 AS b FROM c UNION ALL SELECT text_version_id, unnest(string_split(regexp_replace(b, '[\\s\\x{{85}}\\p{{Z}}]', '', 'g'), '')), 0, 1 FROM c) WHERE ch <> '' GROUP BY 1, 2),
s AS (SELECT text_version_id, sum(least(a, b)) AS m, sum(a) AS a, sum(b) AS b FROM x GROUP BY 1)
SELECT c.text_version_id, CASE WHEN s.m IS NULL THEN 1.0 ELSE round(2.0 * m / (s.a + s.b), 6) END AS f1 FROM c LEFT JOIN s USING (text_version_id)""")
def character_bag_f1(spark: SparkSession, d: str) -> DataFrame:
    """F1 of the characters (with repetition, in any order, without white space) of a version and the one before; 1 if both are blank."""
    v = live_versions(spark, d, "parent_text_version_id", "text_content").where("text_content IS NOT NULL")
    pairs = v.where("parent_text_version_id IS NOT NULL").select("text_version_id", F.lower("parent_text_version_id").alias("p"), F.col("text_content").alias("a"))
    pairs = pairs.join(v.select(F.col("text_version_id").alias("p"), F.col("text_content").alias("b")), "p")
    return spans.bag_f1(pairs, "text_version_id", "a", "b").select("text_version_id", F.round("f1", 6).alias("f1"))


@query(f"""SELECT mention_id, (length(region_text) - length(replace(region_text, mention_text, ''))) // length(mention_text) AS times FROM {M} WHERE mention_text <> '' AND region_text IS NOT NULL""")
def surface_times(spark: SparkSession, d: str) -> DataFrame:
    """How often the surface stands in the snippet without overlap; a surface is unique if once."""
    rows = live_mentions(spark, d, "mention_text", "region_text").where("mention_text <> '' AND region_text IS NOT NULL")
    return rows.select("mention_id", C.times_apart("region_text", "mention_text").cast("bigint").alias("times"))


@query(f"""WITH m AS (SELECT mention_id, region_text AS t, region_text[greatest(0, text_start - 3) + 1:text_start] AS l, mention_text AS s, region_text[text_end + 1:text_end + 3] AS r FROM {M} WHERE mention_text <> '' AND region_text IS NOT NULL AND text_start IS NOT NULL AND text_end IS NOT NULL),
p AS (SELECT mention_id, l, list_filter(generate_series(1, length(t) - length(l || s || r) + 1), lambda i: t[i:i + length(l || s || r) - 1] = l || s || r) AS found FROM m)
SELECT mention_id, CASE WHEN len(found) = 1 THEN (found[1] - 1 + length(l))::INT END AS place FROM p""")
def located_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """The only place of a surface between its neighbouring three characters; null if there are several or none."""
    m = live_mentions(spark, d, "mention_text", "region_text", "text_start", "text_end").where("mention_text <> '' AND region_text IS NOT NULL AND text_start IS NOT NULL AND text_end IS NOT NULL")
    m = m.withColumns({"l": C.left_context("region_text", "text_start", 3), "r": C.right_context("region_text", "text_end", 3)})
    return m.select("mention_id", C.only_place("region_text", "mention_text", "l", "r").alias("place"))


@query("SELECT source, TRY_CAST(nullif(regexp_extract(source, 'vol-([0-9]+)', 1), '') AS INT) AS volume_number, CASE lower(regexp_extract(source, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'djvu' THEN 'image/vnd.djvu' ELSE 'application/octet-stream' END AS media_type, count(*) AS n FROM documents GROUP BY 1")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    """Volume number and media type by the path of each source."""
    counts = load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return counts.select("source", C.number_after("source", "vol-").alias("volume_number"), C.media_type("source").alias("media_type"), "n")


@query(f"SELECT region_id, printf('v%03d-p%04d', volume_number, page_number) AS label FROM {R} WHERE volume_number IS NOT NULL AND page_number IS NOT NULL")
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = live_regions(spark, d, "volume_number", "page_number").where("volume_number IS NOT NULL AND page_number IS NOT NULL")
    return rows.select("region_id", C.page_label("volume_number", "page_number").alias("label"))


_HEADINGS = ["committee", "meeting", "council"]


@query(f"""WITH p AS (SELECT doc_id, {", ".join(f"strpos(text, '{h}') AS p{k}" for k, h in enumerate(_HEADINGS))} FROM documents WHERE text IS NOT NULL)
SELECT doc_id, concat_ws(',', {", ".join(f"CASE WHEN p{k} = 0 THEN '{h}' END" for k, h in enumerate(_HEADINGS))}) AS missing,
list_filter([p0, p1, p2], lambda x: x > 0) = list_sort(list_filter([p0, p1, p2], lambda x: x > 0)) AS ordered FROM p""")
def section_order(spark: SparkSession, d: str) -> DataFrame:
    """Which of the expected headings a text lacks, and whether the others stand in the expected order."""
    missing, ordered = C.sections("text", _HEADINGS)
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", missing.alias("missing"), ordered.alias("ordered"))


@query(f"""SELECT mention_id, length(regexp_replace(region_text[1:text_start], '[\\s\\v]', '', 'g'))::INT AS token_start, length(regexp_replace(region_text[1:text_end], '[\\s\\v]', '', 'g'))::INT AS token_end FROM {M} WHERE region_text IS NOT NULL AND text_start IS NOT NULL AND text_end IS NOT NULL""")
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of mentions counted in characters that are no white space."""
    rows = live_mentions(spark, d, "region_text", "text_start", "text_end").where("region_text IS NOT NULL AND text_start IS NOT NULL AND text_end IS NOT NULL")
    return rows.select("mention_id", C.token_offset("region_text", "text_start").alias("token_start"), C.token_offset("region_text", "text_end").alias("token_end"))


_VEC = "(SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings)"


@query(f"""SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN v])), 6) AS norm, len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS finite, round(v[1] / sqrt(list_sum([x * x FOR x IN v])), 6) AS first FROM {_VEC}""")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.round(C.norm("embedding"), 6).alias("norm"), C.is_finite("embedding").alias("finite"), F.round(C.unit("embedding")[0], 6).alias("first"))


@query(f"""WITH e AS (SELECT label, unnest(v) AS x, unnest(generate_series(0, len(v) - 1))::INT AS place FROM {_VEC})
SELECT label, place, round(avg(x), 6) AS mean FROM e GROUP BY 1, 2""")
def mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the vectors of each label, number by number."""
    return spans.mean_by_place(load(spark, d, "embeddings"), "label", "embedding").select("label", "place", F.round("mean", 6).alias("mean"))


@query("SELECT event_id, greatest(-1.0, least(1.0, (value - 50) / 25)) AS clamped FROM events WHERE value IS NOT NULL")
def clamped_values(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").where("value IS NOT NULL").select("event_id", C.clamp((F.col("value") - 50) / 25).alias("clamped"))


@query("""WITH n AS (SELECT entity_id, name, i, row_number() OVER (PARTITION BY entity_id, name ORDER BY i) AS rn FROM (SELECT entity_id, unnest(list_concat([canonical_name], coalesce(aliases, []), [canonical_name])) AS name, unnest(generate_series(1, 2 + len(coalesce(aliases, [])))) AS i FROM authority_entity))
SELECT entity_id, string_agg(name, '|' ORDER BY i) AS names FROM n WHERE rn = 1 GROUP BY 1""")
def ordered_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of an entity in the order in which they come first."""
    names = F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")), F.array("canonical_name")))
    return load(spark, d, "authority_entity").select("entity_id", F.array_join(names, "|").alias("names"))


@query("SELECT event_id, json_object('kind', event_type, 'user', user_id, 'k', CAST(json_extract(props, '$.k') AS BIGINT))::VARCHAR AS document FROM events")
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects built from columns and from a field of another object, which is merged in."""
    document = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("bigint").alias("k")))
    return load(spark, d, "events").select("event_id", document.alias("document"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (len(list_filter(json_keys(props), lambda k: k NOT IN ('k'))) > 0) AS unknown, count(*) FILTER (NOT list_contains(json_keys(props), 'k')) AS missing FROM events GROUP BY 1""")
def strict_keys(spark: SparkSession, d: str) -> DataFrame:
    """Objects with keys that the schema does not have, or without one that it has."""
    from evidentia.sources.files import unknown_keys

    keys = F.json_object_keys("props")
    return load(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.size(unknown_keys("props", ["k"])) > 0).alias("unknown"), F.count_if(~F.coalesce(F.array_contains(keys, "k"), F.lit(False))).alias("missing")
    )


@query(r"""SELECT doc_id, sha256(regexp_replace(nfc_normalize(regexp_replace(regexp_replace(text, '(?m)(?:[\s\v]*\(?[0-9]{1,4}[\s\v]*,[\s\v]*[0-9]{1,4}\)?[\s\v]*,[\s\v]*\(?[0-9]{1,4}[\s\v]*,[\s\v]*[0-9]{1,4}\)?[\s\v]*)+$', '', 'g'), '<[^>]+>', '', 'g')), '[\p{C}\p{P}\p{S}\p{Z}]', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL""")
def comparison_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digest of what counts of a text in comparisons."""
    from evidentia.functions.text import nfc

    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(C.comparison_text("text", nfc), 256).alias("digest"))


@query()
def polygon_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Area of each region's polygon, whether it is convex, and its intersection over union with the next
    region of the page in reading order, by clipping; null where a polygon is not convex. No SQL;
    checked against boxes and brute force."""
    rows = live_regions(spark, d, "page_id", "reading_order", "polygon").where("size(polygon.points) >= 3").select("page_id", "region_id", "reading_order", F.col("polygon.points").alias("q"))
    nxt = F.lead("q").over(Window.partitionBy("page_id").orderBy("reading_order", "region_id"))
    return rows.withColumn("n", nxt).select("region_id", F.round(spans.polygon_area("q"), 4).alias("area"), spans.is_convex("q").alias("convex"), F.round(spans.polygon_iou("q", "n"), 6).alias("overlap"))


@query()
def article_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of mentions cut into chunks of at most 24 characters at natural boundaries and through no
    mention; a snippet for which that is impossible has a null chunk. No SQL; checked against brute force."""
    m = live_mentions(spark, d, "region_id", "region_text", "text_start", "text_end").where("region_text IS NOT NULL AND text_start < text_end")
    per = m.groupBy("region_id", "region_text").agg(F.array_sort(F.collect_set(F.struct("text_start", "text_end"))).alias("s"))
    return spans.chunks(per, "region_text", "s", 24).select("region_id", F.sha2("region_text", 256).alias("digest"), "chunk_no", "chunk_start", "chunk_end")
