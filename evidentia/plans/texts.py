"""Queries on texts, spans, retrieval, scores and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.operators import retrieval, scoring, selection, spans
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


_T = f"(SELECT *, coalesce(nullif(normalized_text, ''), nullif(raw_text, '')) AS t FROM {R})"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Regions with the first text that is neither null nor empty."""
    return live_regions(spark, d, "page_id", "reading_order", "normalized_text", "raw_text").withColumn("t", F.coalesce(F.nullif("normalized_text", F.lit("")), F.nullif("raw_text", F.lit(""))))


@query(f"""SELECT region_id, page_id, coalesce(sum(length(t) + 1) OVER w, 0)::BIGINT AS start_at, (coalesce(sum(length(t) + 1) OVER w, 0) + length(t))::BIGINT AS end_at
FROM {_T} WHERE t IS NOT NULL WINDOW w AS (PARTITION BY page_id ORDER BY reading_order, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def citation_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of every region in the joined text of its page."""
    placed = spans.running_offsets(_texts(spark, d), "page_id", ["reading_order", "region_id"], "t")
    return placed.select("region_id", "page_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(f"""SELECT page_id, sha256(string_agg(t, chr(10) ORDER BY reading_order, region_id)) AS digest, count(*)::INT AS parts, length(string_agg(t, chr(10)))::BIGINT AS size FROM {_T} WHERE t IS NOT NULL GROUP BY 1""")
def page_documents(spark: SparkSession, d: str) -> DataFrame:
    pages = spans.assemble(_texts(spark, d), "page_id", ["reading_order", "region_id"], "t")
    return pages.select("page_id", F.sha2("content", 256).alias("digest"), "parts", F.char_length("content").cast("bigint").alias("size"))


@query(f"""
WITH RECURSIVE o AS (SELECT page_id, coalesce(length(raw_text), 0) AS n, row_number() OVER (PARTITION BY page_id ORDER BY reading_order, region_id) AS i FROM {R}),
f(page_id, i, n, w, k, c) AS (SELECT page_id, i, n, 0, 1, n FROM o WHERE i = 1 UNION ALL
SELECT o.page_id, o.i, o.n,
 CASE WHEN f.k > 0 AND o.n > 0 AND (f.k >= 4 OR f.c + CASE WHEN f.c > 0 THEN 1 ELSE 0 END + o.n > 300) THEN f.w + 1 ELSE f.w END,
 CASE WHEN f.k > 0 AND o.n > 0 AND (f.k >= 4 OR f.c + CASE WHEN f.c > 0 THEN 1 ELSE 0 END + o.n > 300) THEN 1 ELSE f.k + 1 END,
 CASE WHEN f.k > 0 AND o.n > 0 AND (f.k >= 4 OR f.c + CASE WHEN f.c > 0 THEN 1 ELSE 0 END + o.n > 300) THEN o.n ELSE f.c + CASE WHEN f.c > 0 AND o.n > 0 THEN 1 ELSE 0 END + o.n END
FROM f JOIN o ON o.page_id = f.page_id AND o.i = f.i + 1)
SELECT page_id, w AS window_no, count(*)::INT AS parts, sum(n)::INT AS chars FROM f GROUP BY 1, 2""")
def packed_windows(spark: SparkSession, d: str) -> DataFrame:
    return spans.pack_windows(live_regions(spark, d, "page_id", "reading_order", "raw_text"), "page_id", ["reading_order", "region_id"], "raw_text", 4, 300)


@query(f"""WITH s AS (SELECT region_id, text_start, max(text_end) OVER (PARTITION BY region_id ORDER BY text_start, text_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {M})
SELECT region_id, count(*) FILTER (text_start > b) AS gaps, count(*) FILTER (text_start < b) AS overlaps FROM s GROUP BY 1""")
def span_gaps(spark: SparkSession, d: str) -> DataFrame:
    return spans.gaps(live_mentions(spark, d, "region_id", "text_start", "text_end"), "region_id", "text_start", "text_end")


@query(f"""SELECT region_id, coalesce(string_agg(raw_text, '|') OVER (PARTITION BY page_id ORDER BY reading_order, region_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), '') AS context FROM {R}""")
def context_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each region with its neighbours in reading order, not going over the page."""
    around = Window.partitionBy("page_id").orderBy("reading_order", "region_id").rowsBetween(-1, 1)
    return live_regions(spark, d, "page_id", "reading_order", "raw_text").select("region_id", F.array_join(F.collect_list("raw_text").over(around), "|").alias("context"))


@query(f"""SELECT mention_id, len(list_filter(generate_series(1, length(region_text) - length(mention_text) + 1), lambda i: region_text[i:i + length(mention_text) - 1] = mention_text))::INT AS places FROM {M}
WHERE mention_text <> '' AND length(region_text) >= length(mention_text)""")
def surface_places(spark: SparkSession, d: str) -> DataFrame:
    """How often a mention's surface stands in its snippet, overlapping places included."""
    rows = live_mentions(spark, d, "mention_text", "region_text").where((F.col("mention_text") != "") & (F.char_length("region_text") >= F.char_length("mention_text")))
    return rows.select("mention_id", spans.occurrences("region_text", "mention_text").alias("places"))


@query(f"""SELECT entity_type, count(*) AS n, count(*) FILTER (region_text[text_start + 1:text_end] IS DISTINCT FROM mention_text) AS invalid,
count(*) FILTER (region_text IS NULL) AS no_text FROM {M} GROUP BY 1""")
def quote_validation(spark: SparkSession, d: str) -> DataFrame:
    quote = F.col("region_text").substr(F.col("text_start") + 1, F.col("text_end") - F.col("text_start"))
    return live_mentions(spark, d, "entity_type", "mention_text", "region_text", "text_start", "text_end").groupBy("entity_type").agg(
        F.count("*").alias("n"), F.count_if(~quote.eqNullSafe(F.col("mention_text"))).alias("invalid"), F.count_if(F.col("region_text").isNull()).alias("no_text")
    )


@query(r"SELECT entity_id, regexp_replace(nfc_normalize(canonical_name), '[\s\p{P}\p{S}]', '', 'g') AS key_text FROM authority_entity")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names composed, without white space, punctuation and symbols."""
    from evidentia.functions.text import nfc

    return load(spark, d, "authority_entity").select("entity_id", F.regexp_replace(nfc("canonical_name"), r"[\s\p{P}\p{S}]", "").alias("key_text"))


@query(f"""
WITH c AS (SELECT entity_id, entity_type, list_sort(list_distinct(string_split(canonical_name, ''))) AS s FROM authority_entity WHERE entity_type IN ('school', 'publication')),
p AS (SELECT a.entity_id AS l, b.entity_id AS r, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS u FROM c a JOIN c b ON a.entity_type = b.entity_type AND a.entity_id < b.entity_id)
SELECT l AS left_id, r AS right_id, round(i::DOUBLE / u, 6) AS jaccard FROM p WHERE i::DOUBLE / u >= 0.7""")
def character_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of bodies of one type with similar sets of characters, blocked on shared rare characters.
    Only canonical names of schools and publications from 0.7, as its SQL;
    ``character_jaccard_pairs_all`` takes all types and names."""
    names = load(spark, d, "authority_entity").where(F.col("entity_type").isin("school", "publication"))
    sets = names.select(F.col("entity_id").alias("id"), "entity_type", F.array_distinct(F.split("canonical_name", "")).alias("items"))
    return retrieval.jaccard_pairs(sets, "entity_type", 0.7).select(F.col("left_id"), F.col("right_id"), "jaccard")


@query()
def character_jaccard_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of entities of one type with the best similarity over all their names and aliases, from
    0.35; names without letters and digits are similar to none. Characters are compared as in
    ``identity_key``, without marks. No SQL; checked against brute force."""
    from evidentia.functions.text import identity_key

    value = F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    names = load(spark, d, "authority_entity").select("entity_id", "entity_type", value.alias("value"))
    keys = names.select("entity_id", "entity_type", F.array_sort(F.array_distinct(F.split(F.regexp_replace(identity_key("value"), r"\p{M}+", ""), ""))).alias("items"))
    sets = keys.where("items <> array('')").distinct().select(F.struct("entity_id", F.array_join("items", "").alias("name")).alias("id"), "entity_type", "items")
    met = retrieval.jaccard_pairs(sets, "entity_type", 0.35).where("left_id.entity_id <> right_id.entity_id")
    return met.groupBy(F.col("left_id.entity_id").alias("left_id"), F.col("right_id.entity_id").alias("right_id")).agg(F.max("jaccard").alias("jaccard"))


@query(f"""
WITH m AS (SELECT *, lower(mention_id) AS id FROM {M}),
p AS (SELECT a.region_id, a.id AS subject_id, b.id AS object_id, b.text_start - a.text_end AS gap, row_number() OVER (PARTITION BY a.mention_text, b.mention_text ORDER BY b.text_start - a.text_end, a.id, b.id) AS rn
FROM m a JOIN m b ON a.region_id = b.region_id WHERE a.entity_type = 'person' AND b.entity_type IN ('school', 'organization') AND b.text_start >= a.text_end AND b.text_start - a.text_end <= 40)
SELECT region_id, subject_id, object_id, gap FROM p WHERE rn = 1""")
def relation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pairs person, body within a region at a short gap; the nearest per pair of names."""
    m = live_mentions(spark, d, "region_id", "entity_type", "mention_text", "text_start", "text_end")
    a = m.where("entity_type = 'person'").select("region_id", F.col("mention_id").alias("subject_id"), F.col("mention_text").alias("subject"), "text_end")
    b = m.where("entity_type IN ('school', 'organization')").select("region_id", F.col("mention_id").alias("object_id"), F.col("mention_text").alias("object"), "text_start")
    pairs = spans.within(a, b, ["region_id"], "text_end", "text_start", 0, 40).withColumn("gap", F.col("text_start") - F.col("text_end"))
    return selection.first_of(pairs, ["subject", "object"], ["gap", "subject_id", "object_id"], ["region_id", "subject_id", "object_id", "gap"]).drop("subject", "object")


@query(f"""WITH c AS (SELECT mention_id, region_text || ' [region:' || region_id || '] [region:x' AS answer, region_id FROM {M})
SELECT mention_id, len(regexp_extract_all(answer, '\\[region:([0-9a-fA-F-]{{36}})\\]', 1))::INT AS cited, (length(answer) - length(replace(answer, '[region:', '')))::INT // 8 - len(regexp_extract_all(answer, '\\[region:([0-9a-fA-F-]{{36}})\\]', 1))::INT AS malformed FROM c""")
def citation_parse(spark: SparkSession, d: str) -> DataFrame:
    """Citations of an answer and malformed ones; answers are made of the snippets."""
    answer = F.concat("region_text", F.lit(" [region:"), "region_id", F.lit("] [region:x"))
    cited = F.size(F.regexp_extract_all("answer", F.lit(r"\[region:([0-9a-fA-F-]{36})\]"), 1))
    opened = ((F.char_length("answer") - F.char_length(F.replace("answer", F.lit("[region:"), F.lit("")))) / 8).cast("int")
    return live_mentions(spark, d, "region_text", "region_id").select("mention_id", answer.alias("answer")).select("mention_id", cited.alias("cited"), (opened - cited).alias("malformed"))


@query("""SELECT coalesce((publication_year // 10 * 10)::VARCHAR || 's', 'unknown') AS decade, variant, count(*) AS n, median(length(text)) AS median_size,
quantile_disc(length(text), 0.95)::BIGINT AS p95_size FROM documents GROUP BY 1, 2""")
def decade_strata(spark: SparkSession, d: str) -> DataFrame:
    """Strata with an interpolated median and a nearest-rank percentile."""
    size = F.char_length("text")
    return load(spark, d, "documents").groupBy(scoring.decade("publication_year").alias("decade"), "variant").agg(
        F.count("*").alias("n"), F.median(size).alias("median_size"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY char_length(text))").cast("bigint").alias("p95_size")
    )


@query("""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL AND lang = 'en')
SELECT doc_id, n::INT AS tokens, (1 + greatest(0, ceil((n - 64) / 56.0)))::INT AS windows, (greatest(0, ceil((n - 64) / 56.0)) * 56)::INT AS last_start FROM w""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sliding token windows of 64 with an overlap of an eighth; the last reaches the end. Only rows
    with ``lang`` 'en', as its SQL; ``token_windows_all`` takes every text."""
    return _token_windows(load(spark, d, "documents").where("text IS NOT NULL AND lang = 'en'"))


def _token_windows(documents: DataFrame) -> DataFrame:
    words = documents.select("doc_id", F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).alias("tokens"))
    starts = words.withColumn("s", spans.sliding(F.col("tokens"), 64, 56))
    return starts.select("doc_id", "tokens", F.size("s").alias("windows"), F.element_at("s", -1).alias("last_start"))


@query("""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n::INT AS tokens, (1 + greatest(0, ceil((n - 64) / 56.0)))::INT AS windows, (greatest(0, ceil((n - 64) / 56.0)) * 56)::INT AS last_start FROM w""")
def token_windows_all(spark: SparkSession, d: str) -> DataFrame:
    """``token_windows`` of every text that is not null, whatever its ``lang``; a token is a run
    between white space in any script."""
    return _token_windows(load(spark, d, "documents").where("text IS NOT NULL"))


@query(f"""
WITH p AS (SELECT c.text_content AS a, q.text_content AS b FROM {V} c JOIN {V} q ON q.text_version_id = lower(c.parent_text_version_id) WHERE length(c.text_content) = length(q.text_content)),
x AS (SELECT unnest(string_split(b, '')) AS before, unnest(string_split(a, '')) AS after FROM p WHERE length(a) > 0)
SELECT before, after, count(*) AS n FROM x WHERE before <> after GROUP BY 1, 2""")
def substitution_counts(spark: SparkSession, d: str) -> DataFrame:
    """Which characters corrections of equal length replace."""
    v = live_versions(spark, d, "parent_text_version_id", "text_content")
    child = v.where("parent_text_version_id IS NOT NULL").select(F.lower("parent_text_version_id").alias("p"), F.col("text_content").alias("a"))
    pairs = child.join(v.select(F.col("text_version_id").alias("p"), F.col("text_content").alias("b")), "p").where("char_length(a) = char_length(b) AND char_length(a) > 0")
    chars = pairs.select(F.explode(F.filter(F.arrays_zip(F.split("b", "").alias("before"), F.split("a", "").alias("after")), lambda x: x["before"] != x["after"])).alias("c"))
    return chars.groupBy("c.before", "c.after").agg(F.count("*").alias("n"))


@query(f"""
WITH p AS (SELECT c.variant, regexp_replace(c.text_content, '[^ -~]', '', 'g') AS a, regexp_replace(q.text_content, '[^ -~]', '', 'g') AS b FROM {V} c JOIN {V} q ON q.text_version_id = lower(c.parent_text_version_id))
SELECT variant, count(*) AS n, sum(levenshtein(a, b))::BIGINT AS edits, sum(length(b))::BIGINT AS chars, round(sum(levenshtein(a, b)) / nullif(sum(length(b)), 0), 6) AS rate FROM p GROUP BY 1""")
def character_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Edits per character from a version to the one before, over the ASCII part of the text, which
    its SQL can count; ``character_error_rate_all`` takes whole texts."""
    v = live_versions(spark, d, "parent_text_version_id", "text_content", "variant").withColumn("t", F.regexp_replace("text_content", "[^ -~]", ""))
    child = v.where("parent_text_version_id IS NOT NULL").select(F.lower("parent_text_version_id").alias("p"), "variant", F.col("t").alias("a"))
    pairs = child.join(v.select(F.col("text_version_id").alias("p"), F.col("t").alias("b")), "p")
    edits, chars = F.sum(F.levenshtein("a", "b")), F.sum(F.char_length("b"))
    return pairs.groupBy("variant").agg(F.count("*").alias("n"), edits.alias("edits"), chars.alias("chars"), F.round(edits / F.nullif(chars, F.lit(0)), 6).alias("rate"))


@query()
def character_error_rate_all(spark: SparkSession, d: str) -> DataFrame:
    """Edits per character (code point) from a version to the one before, over whole texts in any
    script; pairs without one of the texts do not count. No SQL: DuckDB's levenshtein counts bytes."""
    v = live_versions(spark, d, "parent_text_version_id", "text_content", "variant").where("text_content IS NOT NULL")
    child = v.where("parent_text_version_id IS NOT NULL").select(F.lower("parent_text_version_id").alias("p"), "variant", F.col("text_content").alias("a"))
    pairs = child.join(v.select(F.col("text_version_id").alias("p"), F.col("text_content").alias("b")), "p")
    edits, chars = F.sum(F.levenshtein("a", "b")), F.sum(F.char_length("b"))
    return pairs.groupBy("variant").agg(F.count("*").alias("n"), edits.alias("edits"), chars.alias("chars"), F.round(edits / F.nullif(chars, F.lit(0)), 6).alias("rate"))


@query(f"""WITH p AS (SELECT region_id, polygon.points AS q FROM {R} WHERE polygon IS NOT NULL)
SELECT region_id, list_min([z.x FOR z IN q]) AS x0, list_max([z.y FOR z IN q]) AS y1,
round(abs(list_sum([q[i].x * q[i % len(q) + 1].y - q[i % len(q) + 1].x * q[i].y FOR i IN generate_series(1, len(q))])) / 2, 4) AS area FROM p WHERE len(q) >= 3""")
def polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    from evidentia.sources.tables import current

    rows = current(load(spark, d, "ocr_region"), "region_id", "polygon", "deleted_at").where("deleted_at IS NULL AND polygon IS NOT NULL").select("region_id", F.col("polygon.points").alias("q")).where("size(q) >= 3")
    return rows.select("region_id", spans.box_of("q").alias("b"), F.round(spans.polygon_area("q"), 4).alias("area")).select("region_id", F.col("b.x0").alias("x0"), F.col("b.y1").alias("y1"), "area")


# ---- retrieval

_TERMS = ["hospital", "concert", "school", "villages", "女子", "学校", "больницы"]
_OTHER = ["committee", "council", "學校"]
_CJK_SQL = r"[\p{Han}\p{Hiragana}\p{Katakana}]"


def terms_sql(text: str) -> str:
    """SQL of the terms of a text: words, and of runs of Han and kana pairs of characters."""
    words = rf"[w FOR w IN regexp_split_to_array(regexp_replace(lower({text}), '({_CJK_SQL}+)', ' \1 ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}]+') IF w <> '']"
    return f"flatten([CASE WHEN regexp_matches(w, '^{_CJK_SQL}') THEN [substr(w, k, 2) FOR k IN generate_series(1, greatest(1, length(w) - 1))] ELSE [w] END FOR w IN {words}])"


def bm25_sql(text: str, terms: list[str], table: str = "documents", key: str = "doc_id") -> str:
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""(WITH d AS (SELECT {key}, {terms_sql(text)} AS w FROM {table} WHERE {text} IS NOT NULL), l AS (SELECT {key}, w, len(w) AS n FROM d), g AS (SELECT count(*) AS c, avg(n) AS a FROM l),
t AS (SELECT {key}, n, unnest(w) AS term FROM l), f AS (SELECT {key}, n, term, count(*) AS tf FROM t WHERE term IN ({wanted}) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
SELECT {key}, sum(ln(1 + (c - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / a))) AS score FROM f JOIN df USING (term), g GROUP BY 1)"""


@query(f"SELECT doc_id, round(score, 6) AS score FROM {bm25_sql('text', _TERMS)} ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical search: BM25 with k1 1.2 and b 0.75 over words of any script and pairs of Han and kana, the best twenty."""
    counts = retrieval.term_counts(load(spark, d, "documents"), "doc_id", ["text"], _TERMS)
    return retrieval.bm25(counts, "doc_id", {"text": 1.0}, _TERMS).orderBy(F.desc("score"), "doc_id").limit(20)


_UNIT = "(SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS n FROM embeddings)"


@query(f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.v) / (q.n * e.n), 6) AS cosine FROM {_UNIT} q JOIN {_UNIT} e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, rank::INT AS rank, cosine FROM k WHERE rank <= 10""")
def cosine_search(spark: SparkSession, d: str) -> DataFrame:
    """Exact dense search: every twentieth vector is a query against all others, in blocks."""
    vectors = load(spark, d, "embeddings")
    return retrieval.nearest(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 10)


@query(f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.v) / (q.n * e.n), 6) AS cosine FROM {_UNIT} q JOIN {_UNIT} e ON q.vec_id <> e.vec_id AND q.label = e.label WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM p) SELECT least(query_id, vec_id) AS left_id, greatest(query_id, vec_id) AS right_id, max(cosine) AS cosine FROM k WHERE rank <= 5 GROUP BY 1, 2""")
def nearest_of_type(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the same type, made undirected with the best score."""
    vectors = load(spark, d, "embeddings")
    found = retrieval.nearest(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 5, same="label")
    return found.groupBy(F.least("query_id", "vec_id").alias("left_id"), F.greatest("query_id", "vec_id").alias("right_id")).agg(F.max("cosine").alias("cosine"))


@query(f"""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {bm25_sql('text', _TERMS)}), b AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {bm25_sql('text', _OTHER)}),
u AS (SELECT doc_id, rank, 'a' AS k FROM a WHERE rank <= 50 UNION ALL SELECT doc_id, rank, 'b' FROM b WHERE rank <= 50)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, CAST(min(rank) FILTER (k = 'a') AS INT) AS first_rank, CAST(min(rank) FILTER (k = 'b') AS INT) AS second_rank FROM u GROUP BY 1 ORDER BY score DESC, first_rank ASC NULLS LAST, doc_id LIMIT 20""")
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists with their component ranks; the texts are read once for both."""
    both = _TERMS + _OTHER
    counts = retrieval.term_counts(load(spark, d, "documents"), "doc_id", ["text"], both)
    lists = [retrieval.top(retrieval.bm25(counts, "doc_id", {"text": 1.0}, both, terms), "doc_id", 50) for terms in (_TERMS, _OTHER)]
    return retrieval.fuse(lists[0], lists[1], "doc_id").orderBy(F.desc("score"), F.col("first_rank").asc_nulls_last(), "doc_id").limit(20)


_TITLE = r"nullif(regexp_extract(text, '^\s*([^\n]*)', 1), '')"
_ARTICLES = f"(SELECT doc_id, {_TITLE} AS title, text AS content, publication_year FROM documents WHERE variant IN ('corrected_transcription', 'approved_reconstruction') AND publication_year BETWEEN 1890 AND 1930)"
_ARTICLE_TERMS = ["committee", "school", "學校", "女士"]


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """Edited documents of some years with their first line as title."""
    rows = load(spark, d, "documents").where(F.col("variant").isin("corrected_transcription", "approved_reconstruction") & F.col("publication_year").between(1890, 1930))
    return rows.select("doc_id", F.nullif(F.regexp_extract("text", r"^\s*([^\n]*)", 1), F.lit("")).alias("title"), F.col("text").alias("content"))


def _article_scores(spark: SparkSession, d: str) -> DataFrame:
    counts = retrieval.term_counts(_articles(spark, d), "doc_id", ["title", "content"], _ARTICLE_TERMS)
    return retrieval.bm25(counts, "doc_id", {"title": 3.0, "content": 1.0}, _ARTICLE_TERMS)


_ARTICLE_SCORES = f"""(WITH r AS {_ARTICLES}, t AS {bm25_sql('title', _ARTICLE_TERMS, 'r')}, c AS {bm25_sql('content', _ARTICLE_TERMS, 'r')}
SELECT doc_id, round(greatest(3 * coalesce(t.score, 0), coalesce(c.score, 0)), 6) AS score FROM t FULL JOIN c USING (doc_id))"""


@query(f"SELECT doc_id, score FROM {_ARTICLE_SCORES} ORDER BY score DESC, doc_id LIMIT 20")
def article_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical search in articles of some years: title three times content, the best field counts."""
    return _article_scores(spark, d).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"""WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v),
q AS (SELECT v, n FROM u WHERE vec_id = 20), r AS {_ARTICLES},
p AS (SELECT u.vec_id AS doc_id, row_number() OVER (ORDER BY round(list_dot_product(u.v, q.v) / (u.n * q.n), 6) DESC, u.vec_id) AS rank FROM u, q WHERE u.vec_id <> 20 AND u.vec_id IN (SELECT doc_id FROM r)),
l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {_ARTICLE_SCORES}),
a AS (SELECT doc_id, rank, 'l' AS k FROM l WHERE rank <= 50 UNION ALL SELECT doc_id, rank, 'd' FROM p WHERE rank <= 50)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, CAST(min(rank) FILTER (k = 'l') AS INT) AS first_rank, CAST(min(rank) FILTER (k = 'd') AS INT) AS second_rank FROM a GROUP BY 1 ORDER BY score DESC, first_rank ASC NULLS LAST, doc_id LIMIT 20""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and dense lists over the same filtered articles, fused by reciprocal rank. The vector of
    an article has its number; the query is vector 20."""
    vectors = load(spark, d, "embeddings")
    own = vectors.join(_articles(spark, d).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    dense = retrieval.nearest(vectors.where("vec_id = 20"), own, "vec_id", "embedding", 50).select(F.col("vec_id").alias("doc_id"), "rank")
    lexical = retrieval.top(_article_scores(spark, d), "doc_id", 50)
    return retrieval.fuse(lexical, dense, "doc_id").orderBy(F.desc("score"), F.col("first_rank").asc_nulls_last(), "doc_id").limit(20)


@query(f"""WITH p AS (SELECT q.vec_id AS query_id, q.label AS ql, e.label AS el, e.vec_id, round(list_dot_product(q.v, e.v) / (q.n * e.n), 6) AS cosine FROM {_UNIT} q JOIN {_UNIT} e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM p),
s AS (SELECT query_id, ql, count(*) FILTER (ql = el AND rank <= 10) AS hits, min(rank) FILTER (ql = el AND rank <= 10) AS first_hit FROM k GROUP BY 1, 2)
SELECT ql AS label, count(*) AS queries, round(avg(coalesce(1.0 / first_hit, 0)), 6) AS mrr, round(sum(hits) / (10.0 * count(*)), 6) AS precision_at_10 FROM s GROUP BY 1""")
def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank and precision of the dense search per label."""
    vectors = load(spark, d, "embeddings")
    queries = vectors.where("vec_id % 20 = 0")
    hits = retrieval.nearest(queries, vectors, "vec_id", "embedding", 10).join(vectors.select("vec_id", F.col("label").alias("found")), "vec_id")
    judged = queries.select(F.col("vec_id").alias("query_id"), "label").join(hits, "query_id", "left").groupBy("query_id", "label").agg(
        F.count_if(F.col("label") == F.col("found")).alias("hits"), F.min(F.when(F.col("label") == F.col("found"), F.col("rank"))).alias("first_hit")
    )
    return judged.groupBy("label").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))), 6).alias("mrr"), F.round(F.sum("hits") / (10.0 * F.count("*")), 6).alias("precision_at_10"))


# ---- scores

_KEYS = "region_id, entity_type, text_start, text_end"
_GOLD = f"(SELECT DISTINCT {_KEYS}, publication_year FROM {M} WHERE mention_status = 'reviewed')"
_SEEN = f"(SELECT DISTINCT {_KEYS}, publication_year FROM {M} WHERE extractor = 'span')"


@query(f"""
WITH j AS (SELECT coalesce(g.entity_type, s.entity_type) AS entity_type, coalesce((coalesce(g.publication_year, s.publication_year) // 10 * 10)::VARCHAR || 's', 'unknown') AS decade,
(g.region_id IS NOT NULL AND s.region_id IS NOT NULL)::INT AS tp, (s.region_id IS NOT NULL)::INT AS p, (g.region_id IS NOT NULL)::INT AS e FROM {_GOLD} g FULL JOIN {_SEEN} s USING ({_KEYS}, publication_year)),
a AS (SELECT entity_type, decade, sum(tp)::BIGINT AS tp, sum(p)::BIGINT AS predicted, sum(e)::BIGINT AS expected FROM j GROUP BY GROUPING SETS ((entity_type), (decade), ()))
SELECT coalesce(entity_type, 'all') AS entity_type, coalesce(decade, 'all') AS decade, tp, predicted, expected, CASE WHEN predicted + expected = 0 THEN 1.0 WHEN predicted = 0 THEN 0.0 ELSE round(tp / predicted, 6) END AS "precision",
CASE WHEN predicted + expected = 0 THEN 1.0 WHEN expected = 0 THEN 0.0 ELSE round(tp / expected, 6) END AS recall, CASE WHEN predicted + expected = 0 THEN 1.0 ELSE round(2 * tp / (predicted + expected), 6) END AS f1 FROM a""")
def span_scores(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of exact spans by type, by decade and in all, in one pass."""
    keys = ["region_id", "entity_type", "text_start", "text_end", "publication_year"]
    flags = live_mentions(spark, d, "region_id", "entity_type", "text_start", "text_end", "publication_year", "mention_status", "extractor").groupBy(*keys).agg(F.bool_or(F.coalesce(F.col("mention_status") == "reviewed", F.lit(False))).alias("e"), F.bool_or(F.coalesce(F.col("extractor") == "span", F.lit(False))).alias("p")).where("e OR p")
    rows = flags.withColumn("decade", scoring.decade("publication_year"))
    rows.createOrReplaceTempView("evidentia_flags")
    sums = spark.sql("SELECT entity_type, decade, count_if(e AND p) AS tp, count_if(p) AS predicted, count_if(e) AS expected FROM evidentia_flags GROUP BY GROUPING SETS ((entity_type), (decade), ())")
    return sums.select(*[F.coalesce(c, F.lit("all")).alias(c) for c in ("entity_type", "decade")], "tp", "predicted", "expected", *scoring.prf("tp", "predicted", "expected"))


@query(f"""
WITH RECURSIVE c AS (SELECT coalesce(volume_number, -1) AS v, count(*) FILTER (mention_status = 'reviewed') AS h, count(*) AS t FROM {M} GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY v) - 1 AS i, h, t FROM c), g AS (SELECT count(*) AS k FROM c),
d AS (SELECT r AS replicate, ('0x' || sha256('1729:' || r || ':' || p)[1:7])::BIGINT % k AS i FROM g, unnest(generate_series(0, 199)) AS x(r), unnest(generate_series(0, k - 1)) AS y(p)),
s AS (SELECT replicate, round(sum(h) / sum(t), 9) AS score FROM d JOIN n USING (i) GROUP BY 1)
SELECT quantile_disc(score, 0.025) AS low, quantile_disc(score, 0.5) AS mid, quantile_disc(score, 0.975) AS high FROM s""")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Share of reviewed mentions with a bootstrap interval over volumes."""
    clusters = live_mentions(spark, d, "volume_number", "mention_status").groupBy(F.coalesce("volume_number", F.lit(-1)).alias("v")).agg(F.count_if(F.col("mention_status") == "reviewed").alias("h"), F.count("*").alias("t"))
    scores = scoring.cluster_bootstrap(clusters, "v", "h", "t", 200, 1729)
    return scores.agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY score)").alias(n) for q, n in ((0.025, "low"), (0.5, "mid"), (0.975, "high"))])


@query("""WITH l AS (SELECT doc_id, rater, max(reading_level) AS v FROM reading_label WHERE reading_level IS NOT NULL GROUP BY 1, 2)
SELECT a.rater AS left_rater, b.rater AS right_rater, count(*) AS shared, count(*) FILTER (a.v > b.v) AS wins, count(*) FILTER (a.v = b.v) AS ties, count(*) FILTER (a.v < b.v) AS losses, round(avg(abs(a.v - b.v)), 6) AS mean_difference
FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.rater < b.rater GROUP BY 1, 2""")
def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Wins, ties, losses and mean difference of every pair of raters."""
    opinions = load(spark, d, "reading_label").where("reading_level IS NOT NULL").groupBy("doc_id", "rater").agg(F.max("reading_level").alias("v"))
    a, b = opinions.select("doc_id", F.col("rater").alias("left_rater"), F.col("v").alias("x")), opinions.select("doc_id", F.col("rater").alias("right_rater"), F.col("v").alias("y"))
    return a.join(b, "doc_id").where("left_rater < right_rater").groupBy("left_rater", "right_rater").agg(
        F.count("*").alias("shared"), F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") == F.col("y")).alias("ties"), F.count_if(F.col("x") < F.col("y")).alias("losses"),
        F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("mean_difference"),
    )


@query(f"""WITH o AS (SELECT page_id, region_id, reading_order AS a, row_number() OVER (PARTITION BY page_id ORDER BY created_at, region_id) AS b FROM {R})
SELECT x.page_id, count(*) AS pairs, count(*) FILTER (x.b < y.b) AS right_pairs FROM o x JOIN o y ON x.page_id = y.page_id AND x.a < y.a GROUP BY 1""")
def order_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of regions of a page that a second order has the same way round."""
    ranked = live_regions(spark, d, "page_id", "reading_order", "created_at").select("page_id", F.col("reading_order").alias("a"), F.row_number().over(Window.partitionBy("page_id").orderBy("created_at", "region_id")).alias("b"))
    other = ranked.select("page_id", F.col("a").alias("a2"), F.col("b").alias("b2"))
    return ranked.join(other, "page_id").where("a < a2").groupBy("page_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("b") < F.col("b2")).alias("right_pairs"))


@query("""SELECT text_digest, splits, n FROM (SELECT sha256(text) AS text_digest, count(DISTINCT CASE WHEN ('0x' || sha256(doc_id::VARCHAR)[1:2])::INT < 205 THEN 'train' ELSE 'test' END)::BIGINT AS splits, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1) WHERE splits > 1""")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Texts that fall into more than one part of a split by digest of the id."""
    part = F.when(F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2), 16, 10).cast("int") < 205, "train").otherwise("test")
    rows = load(spark, d, "documents").where("text <> ''").groupBy(F.sha2("text", 256).alias("text_digest"))
    return rows.agg(F.countDistinct(part).alias("splits"), F.count("*").alias("n")).where("splits > 1")


# ---- samples

@query("""WITH s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM s WHERE n <= 5 OR list_contains([round_even(k * (n - 1) / 4.0, 0)::BIGINT + 1 FOR k IN [0, 1, 2, 3, 4]], i)""")
def evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    """Five evenly spaced documents of each source, both ends included."""
    per = Window.partitionBy("source")
    rows = load(spark, d, "documents").select("source", "doc_id", F.row_number().over(per.orderBy("doc_id")).alias("i"), F.count("*").over(per).alias("n"))
    places = F.transform(F.array(*map(F.lit, range(5))), lambda k: F.bround(k * (F.col("n") - 1) / 4.0).cast("bigint") + 1)
    return rows.where((F.col("n") <= 5) | F.array_contains(places, F.col("i").cast("bigint"))).select("source", "doc_id")


@query("""WITH m AS (SELECT source, median(n_chars) AS m FROM documents GROUP BY 1), k AS (SELECT d.source, doc_id, row_number() OVER (PARTITION BY d.source ORDER BY abs(n_chars - m), doc_id) AS rn FROM documents d JOIN m USING (source) WHERE n_chars IS NOT NULL)
SELECT source, doc_id FROM k WHERE rn = 1""")
def median_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The document of each source whose length is nearest to the source's median."""
    rows = load(spark, d, "documents").select("source", "doc_id", "n_chars")
    medians = rows.groupBy("source").agg(F.median("n_chars").alias("m"))
    far = F.abs(F.col("n_chars") - F.col("m"))
    return selection.first_of(rows.join(medians, "source").where("n_chars IS NOT NULL"), ["source"], [far, "doc_id"], ["doc_id"])


@query("""SELECT mention_id, reason FROM (SELECT mention_id, reason, row_number() OVER (PARTITION BY reason ORDER BY sha256('packet:' || mention_id)) AS rn FROM
(SELECT mention_id, CASE WHEN confidence IS NULL THEN 'unscored' WHEN confidence < 0.6 THEN 'doubtful' WHEN extractor IS NULL THEN 'unknown extractor' ELSE 'usual' END AS reason FROM """ + M + """)) WHERE rn <= 12""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twelve mentions of each reason in a stable pseudo-random order."""
    reason = F.when(F.col("confidence").isNull(), "unscored").when(F.col("confidence") < 0.6, "doubtful").when(F.col("extractor").isNull(), "unknown extractor").otherwise("usual")
    order = Window.partitionBy("reason").orderBy(F.sha2(F.concat(F.lit("packet:"), "mention_id"), 256))
    return live_mentions(spark, d, "confidence", "extractor").select("mention_id", reason.alias("reason")).withColumn("rn", F.row_number().over(order)).where("rn <= 12").drop("rn")


@query(f"""WITH m AS (SELECT region_id, coalesce(extractor, 'none') AS run, entity_type || text_start || '-' || text_end AS item FROM {M}), x AS (SELECT DISTINCT run FROM m), r AS (SELECT DISTINCT region_id FROM m),
s AS (SELECT r.region_id, x.run, coalesce((SELECT string_agg(DISTINCT item, ' ' ORDER BY item) FROM m WHERE m.region_id = r.region_id AND m.run = x.run), '') AS p FROM r, x)
SELECT region_id, count(*) AS runs, count(DISTINCT p) AS kinds FROM s GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT p) > 1""")
def run_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """Regions on which at least two extractors have different sets of predictions; one that predicts
    nothing has the empty set. The extractors are few, so they are added to each region as an array."""
    item = F.concat("entity_type", F.col("text_start").cast("string"), F.lit("-"), F.col("text_end").cast("string"))
    m = live_mentions(spark, d, "region_id", "extractor", "entity_type", "text_start", "text_end").select("region_id", F.coalesce("extractor", F.lit("none")).alias("run"), item.alias("item"))
    sets = m.groupBy("region_id", "run").agg(F.array_join(F.array_sort(F.collect_set("item")), " ").alias("p"))
    found = sets.groupBy("region_id").agg(F.count("*").alias("some"), F.collect_set("p").alias("ps"))
    runs = m.select("run").distinct().agg(F.count("*").alias("runs"))  # one row
    kinds = F.size("ps") + F.when((F.col("some") < F.col("runs")) & ~F.array_contains("ps", ""), 1).otherwise(0)
    return found.crossJoin(F.broadcast(runs)).select("region_id", "runs", kinds.cast("bigint").alias("kinds")).where("runs >= 2 AND kinds > 1")
