"""Queries that score predictions, searches and answers, and that compare runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators import retrieval, scoring, spans
from evidentia.plans.relational import M, P, R, V, live_mentions, live_regions, live_versions
from evidentia.plans.texts import bm25_sql
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


_SPAN = ["region_id", "entity_type", "text_start", "text_end"]
_S = ", ".join(_SPAN)


@query(f"""WITH x AS (SELECT {_S}, coalesce(extractor, 'none') AS extractor, max(coalesce(confidence, 0)) AS score FROM {M} GROUP BY ALL)
SELECT {_S}, round(max(score), 6) AS score, arg_max(extractor, (score, extractor)) AS extractor, string_agg(extractor || '=' || printf('%.3f', score), ' ' ORDER BY extractor) AS support FROM x GROUP BY {_S}""")
def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    """One row per span and type with its best score, the extractor that gave it, and the best score of each."""
    rows = live_mentions(spark, d, *_SPAN, "extractor", "confidence").groupBy(*_SPAN, F.coalesce("extractor", F.lit("none")).alias("x")).agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("score"))
    support = F.array_join(F.array_sort(F.collect_list(F.concat("x", F.lit("="), F.format_string("%.3f", "score")))), " ")  # at most one entry per extractor
    return rows.groupBy(*_SPAN).agg(F.round(F.max("score"), 6).alias("score"), F.max_by("x", F.struct("score", "x")).alias("extractor"), support.alias("support"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """Spans with the best score of two extractors."""
    rows = live_mentions(spark, d, *_SPAN, "extractor", "confidence").where("extractor IN ('span', 'regex')")
    score = F.coalesce("confidence", F.lit(0.0))
    return rows.groupBy(*_SPAN).agg(F.max(F.when(F.col("extractor") == "span", score)).alias("l"), F.max(F.when(F.col("extractor") == "regex", score)).alias("r"))


@query(f"""WITH x AS (SELECT {_S}, max(coalesce(confidence, 0)) FILTER (extractor = 'span') AS l, max(coalesce(confidence, 0)) FILTER (extractor = 'regex') AS r FROM {M} WHERE extractor IN ('span', 'regex') GROUP BY {_S}),
k AS (SELECT *, CASE WHEN r IS NULL THEN 'left' WHEN l IS NULL THEN 'right' ELSE 'common' END AS part, greatest(coalesce(l, 0), coalesce(r, 0)) AS score FROM x),
n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, {_S}) AS place, count(*) OVER (PARTITION BY part) AS n FROM k)
SELECT part, place::INT AS place, n, {_S}, round(score, 6) AS score FROM n WHERE place <= 25""")
def artifact_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The spans that two extractors have in common or alone: how many, and the 25 best of each part."""
    part = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("common")
    k = _flags(spark, d).select(*_SPAN, part.alias("part"), F.greatest(F.coalesce("l", F.lit(0.0)), F.coalesce("r", F.lit(0.0))).alias("score"))
    counts = k.groupBy("part").agg(F.count("*").alias("n"))
    best = k.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), *_SPAN))).where("place <= 25")
    return best.join(F.broadcast(counts), "part").select("part", "place", "n", *_SPAN, F.round("score", 6).alias("score"))  # three rows


@query(f"""WITH g AS (SELECT DISTINCT {_S} FROM {M} WHERE mention_status = 'reviewed'),
p AS (SELECT {_S}, region_text[text_start + 1:text_end] IS NOT DISTINCT FROM mention_text AS valid, row_number() OVER (PARTITION BY {_S} ORDER BY mention_id) AS copy FROM {M} WHERE extractor = 'span'),
j AS (SELECT p.entity_type, count(*) AS predicted, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (valid AND copy > 1) AS duplicates, count(*) FILTER (valid AND copy = 1 AND g.region_id IS NOT NULL) AS tp FROM p LEFT JOIN g USING ({_S}) GROUP BY 1),
e AS (SELECT entity_type, count(*) AS expected FROM g GROUP BY 1)
SELECT entity_type, coalesce(predicted, 0) AS predicted, coalesce(invalid, 0) AS invalid, coalesce(duplicates, 0) AS duplicates, coalesce(expected, 0) AS expected, coalesce(tp, 0) AS tp,
CASE WHEN coalesce(predicted, 0) + coalesce(expected, 0) = 0 THEN 1.0 WHEN coalesce(predicted, 0) = 0 THEN 0.0 ELSE round(coalesce(tp, 0) / predicted, 6) END AS "precision",
CASE WHEN coalesce(predicted, 0) + coalesce(expected, 0) = 0 THEN 1.0 WHEN coalesce(expected, 0) = 0 THEN 0.0 ELSE round(coalesce(tp, 0) / expected, 6) END AS recall,
CASE WHEN coalesce(predicted, 0) + coalesce(expected, 0) = 0 THEN 1.0 ELSE round(2 * coalesce(tp, 0) / (coalesce(predicted, 0) + coalesce(expected, 0)), 6) END AS f1 FROM j FULL JOIN e USING (entity_type)""")
def ner_scores(spark: SparkSession, d: str) -> DataFrame:
    """Exact precision, recall and F1 by type. Predictions whose surface is not what stands at their offsets
    and repeated ones are no hits but stay in the denominator."""
    m = live_mentions(spark, d, *_SPAN, "mention_status", "mention_text", "region_text", "extractor")
    gold = m.where("mention_status = 'reviewed'").select(*_SPAN, F.lit(1).alias("g")).distinct()
    valid = F.col("region_text").substr(F.col("text_start") + 1, F.col("text_end") - F.col("text_start")).eqNullSafe(F.col("mention_text"))
    copy = F.row_number().over(Window.partitionBy(*_SPAN).orderBy("mention_id"))
    seen = m.where("extractor = 'span'").select(*_SPAN, valid.alias("valid"), copy.alias("copy")).join(gold, _SPAN, "left")
    predicted = seen.groupBy("entity_type").agg(
        F.count("*").alias("predicted"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("valid") & (F.col("copy") > 1)).alias("duplicates"),
        F.count_if(F.col("valid") & (F.col("copy") == 1) & F.col("g").isNotNull()).alias("tp"),
    )
    both = predicted.join(gold.groupBy("entity_type").agg(F.count("*").alias("expected")), "entity_type", "full_outer").fillna(0)
    return both.select("entity_type", "predicted", "invalid", "duplicates", "expected", "tp", *scoring.prf("tp", "predicted", "expected"))


_RELATION = """SELECT a.region_id, a.entity_type AS st, b.entity_type AS ot, a.text_start AS s1, a.text_end AS e1, b.text_start AS s2, b.text_end AS e2, a.mention_id AS i, b.mention_id AS k FROM m a JOIN m b ON a.region_id = b.region_id AND a.mention_id <> b.mention_id AND b.text_start - a.text_end BETWEEN -5 AND 60"""


@query(f"""WITH g0 AS (SELECT * FROM {M} WHERE extractor IS NULL OR extractor = 'span'), p0 AS (SELECT * FROM {M} WHERE extractor IS NOT NULL),
g AS (WITH m AS (SELECT * FROM g0) SELECT DISTINCT region_id, s1, e1, s2, e2 FROM ({_RELATION}) WHERE st = 'person' AND ot IN ('school', 'organization') AND s2 >= e1 AND s2 - e1 <= 40),
p AS (WITH m AS (SELECT * FROM p0) SELECT * FROM ({_RELATION}) WHERE st IN ('person', 'place')),
v AS (SELECT p.*, CASE WHEN st <> 'person' THEN 'subject type' WHEN ot NOT IN ('school', 'organization') THEN 'object type' WHEN s2 < e1 THEN 'overlap' WHEN s2 - e1 > 40 THEN 'too far' ELSE 'valid' END AS reason FROM p),
c AS (SELECT v.*, CASE WHEN reason = 'valid' AND row_number() OVER (PARTITION BY region_id, s1, e1, s2, e2, reason ORDER BY i, k) > 1 THEN 'duplicate' ELSE reason END AS verdict FROM v)
SELECT verdict, count(*) AS predicted, count(g.region_id) FILTER (verdict = 'valid') AS tp, (SELECT count(*) FROM g) AS expected FROM c LEFT JOIN g USING (region_id, s1, e1, s2, e2) GROUP BY 1""")
def relation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Predicted ordered pairs by the first reason against them, in a fixed precedence; valid ones that
    repeat a pair of spans are duplicates. Hits are counted among valid ones only."""
    m = live_mentions(spark, d, *_SPAN, "extractor")

    def pairs(rows: DataFrame) -> DataFrame:
        a = rows.select("region_id", F.col("entity_type").alias("st"), F.col("text_start").alias("s1"), F.col("text_end").alias("e1"), F.col("mention_id").alias("i"))
        b = rows.select("region_id", F.col("entity_type").alias("ot"), F.col("text_start").alias("s2"), F.col("text_end").alias("e2"), F.col("mention_id").alias("k"))
        return spans.within(a, b, ["region_id"], "e1", "s2", -5, 60).where("i <> k")

    places = ["region_id", "s1", "e1", "s2", "e2"]
    gold = pairs(m.where("extractor IS NULL OR extractor = 'span'")).where("st = 'person' AND ot IN ('school', 'organization') AND s2 >= e1 AND s2 - e1 <= 40").select(*places).distinct()
    reason = C.first_reason({
        "subject type": F.col("st") != "person", "object type": ~F.col("ot").isin("school", "organization"), "overlap": F.col("s2") < F.col("e1"), "too far": F.col("s2") - F.col("e1") > 40,
    }, "valid")
    seen = pairs(m.where("extractor IS NOT NULL")).where("st IN ('person', 'place')").withColumn("reason", reason)
    copy = F.row_number().over(Window.partitionBy(*places, "reason").orderBy("i", "k"))
    judged = seen.withColumn("verdict", F.when((F.col("reason") == "valid") & (copy > 1), "duplicate").otherwise(F.col("reason")))
    hits = judged.join(gold.withColumn("g", F.lit(1)), places, "left").groupBy("verdict").agg(F.count("*").alias("predicted"), F.count_if((F.col("verdict") == "valid") & F.col("g").isNotNull()).alias("tp"))
    return hits.crossJoin(F.broadcast(gold.agg(F.count("*").alias("expected"))))  # one row


_QUESTIONS = {"q1": ["hospital", "nurse"], "q2": ["school", "學校"], "q3": ["council", "fees"], "q4": ["zzzz"]}


@query(f"""WITH h AS ({" UNION ALL ".join(f"SELECT '{q}' AS question, * FROM (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS hit FROM {bm25_sql('text', t)}) WHERE hit <= 10" for q, t in _QUESTIONS.items())}),
x AS (SELECT question, hit, doc_id, source, page_genre IS NOT NULL AS cited, variant = 'approved_reconstruction' AS gold, row_number() OVER (PARTITION BY question ORDER BY hit) AS rank FROM h JOIN documents USING (doc_id)),
e(question, source) AS (VALUES ('q1', 'archive://lantern/vol-0219.pdf'), ('q1', 'archive://lantern/vol-0001.pdf'), ('q2', 'archive://lantern/vol-0219.pdf'), ('q3', 'archive://lantern/vol-0003.pdf'), ('q4', 'archive://lantern/vol-0219.pdf')),
s AS (SELECT q.question, (SELECT count(DISTINCT x.source) FROM x JOIN e USING (question, source) WHERE x.question = q.question) AS found, (SELECT count(*) FROM e WHERE e.question = q.question) AS expected,
coalesce((SELECT 1.0 / min(rank) FROM x JOIN e USING (question, source) WHERE x.question = q.question), 0.0) AS rr, (SELECT count(*) FROM x WHERE x.question = q.question) AS hits,
(SELECT count(*) FROM x WHERE x.question = q.question AND cited) AS cited, (SELECT count(*) FROM x WHERE x.question = q.question AND gold) AS gold FROM (SELECT DISTINCT question FROM e) q)
SELECT question, round(found / expected, 6) AS recall, round(rr, 6) AS reciprocal_rank, hits, CASE WHEN hits = 0 THEN 1.0 ELSE round(cited / hits, 6) END AS citation_rate, CASE WHEN hits = 0 THEN 1.0 ELSE round(gold / hits, 6) END AS gold_rate FROM s
UNION ALL SELECT 'all', round(avg(found / expected), 6), round(avg(rr), 6), sum(hits)::BIGINT, CASE WHEN sum(hits) = 0 THEN 1.0 ELSE round(sum(cited) / sum(hits), 6) END, CASE WHEN sum(hits) = 0 THEN 1.0 ELSE round(sum(gold) / sum(hits), 6) END FROM s""")
def retrieval_report(spark: SparkSession, d: str) -> DataFrame:
    """Recall of distinct expected sources among the first ten hits, reciprocal rank, and the shares of hits
    with a citation or of the best edition: per question, and in all (means of recall and rank, shares
    weighted by hits)."""
    documents = load(spark, d, "documents")
    terms = sorted({t for own in _QUESTIONS.values() for t in own})
    counts = retrieval.term_counts(documents, "doc_id", ["text"], terms)
    about = documents.select("doc_id", "source", F.col("page_genre").isNotNull().alias("cited"), (F.col("variant") == "approved_reconstruction").alias("gold"))
    volumes = {"q1": ["0219", "0001"], "q2": ["0219"], "q3": ["0003"], "q4": ["0219"]}
    expected = spark.createDataFrame([(q, f"archive://lantern/vol-{v}.pdf") for q, own in volumes.items() for v in own], "question string, source string")

    def search(question: str) -> DataFrame:
        hits = retrieval.top(retrieval.bm25(counts, "doc_id", {"text": 1.0}, terms, _QUESTIONS[question]), "doc_id", 10)
        return hits.select(F.lit(question).alias("question"), "doc_id", F.col("rank").alias("hit"))

    return scoring.retrieval_report(list(_QUESTIONS), search, about, "doc_id", expected, "source", ["cited", "gold"]).select(
        "question", "recall", "reciprocal_rank", "hits", F.col("cited_rate").alias("citation_rate"), "gold_rate"
    )


@query(f"""WITH a AS (SELECT m.mention_id, m.confidence, [lower(x) FOR x IN regexp_extract_all(coalesce(region_text, '') || ' [region:' || region_id || '] [region:' || mention_id || ']', '\\[region:([0-9a-fA-F-]{{36}})\\]', 1)] AS cited, region_id, mention_status FROM {M} m),
s AS (SELECT *, len(list_filter(cited, lambda c: c = region_id)) AS supported FROM a)
SELECT mention_status AS status, count(*) AS answers, round(count(*) / (SELECT count(*) FROM a), 6) AS share, round(sum(supported) / sum(len(cited)), 6) AS citation_precision, round(avg((supported > 0)::INT), 6) AS support_recall,
quantile_disc(confidence, 0.5) AS p50, quantile_disc(confidence, 0.95) AS p95, round(count(confidence) / count(*), 6) AS complete FROM s GROUP BY 1""")
def generation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Answers (made of snippets with two citations, one of them foreign) by status: share, precision of
    citations, share that cite their source, nearest-rank percentiles and completeness of a measure."""
    m = live_mentions(spark, d, "mention_status", "region_id", "region_text", "confidence")
    answer = F.concat(F.coalesce("region_text", F.lit("")), F.lit(" [region:"), "region_id", F.lit("] [region:"), "mention_id", F.lit("]"))
    cited = F.regexp_extract_all(answer, F.lit(r"\[region:([0-9a-fA-F-]{36})\]"), 1)
    rows = m.select("mention_status", "confidence", "region_id", F.transform(cited, F.lower).alias("cited")).withColumn("supported", F.size(F.filter("cited", lambda c: c == F.col("region_id"))))
    per = rows.groupBy(F.col("mention_status").alias("status")).agg(
        F.count("*").alias("answers"), F.round(F.sum("supported") / F.sum(F.size("cited")), 6).alias("citation_precision"), F.round(F.avg((F.col("supported") > 0).cast("int")), 6).alias("support_recall"),
        *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY confidence)").alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"))], F.round(F.count("confidence") / F.count("*"), 6).alias("complete"),
    )
    whole = m.agg(F.count("*").alias("whole"))
    return per.crossJoin(F.broadcast(whole)).withColumn("share", F.round(F.col("answers") / F.col("whole"), 6)).drop("whole")  # one row


@query(f"""WITH a AS (SELECT mention_id, region_id, coalesce(region_text, '') || ' [region:' || upper(region_id) || '] [region:' || mention_id || '] [region:12]' AS t FROM {M}),
c AS (SELECT mention_id, region_id, t, list_sort(list_distinct([lower(x) FOR x IN regexp_extract_all(t, '\\[region:([0-9a-fA-F-]{{36}})\\]', 1)])) AS ids, len(regexp_extract_all(t, '\\[region:')) - len(regexp_extract_all(t, '\\[region:[0-9a-fA-F-]{{36}}\\]')) AS malformed FROM a)
SELECT mention_id, len(list_filter(ids, lambda x: x = region_id))::INT AS allowed, len(list_filter(ids, lambda x: x <> region_id))::INT AS foreign_n, malformed::INT AS malformed FROM c""")
def answer_validation(spark: SparkSession, d: str) -> DataFrame:
    """Distinct citations of an answer that its context allows, foreign ones and malformed ones."""
    m = live_mentions(spark, d, "region_id", "region_text")
    answer = F.concat(F.coalesce("region_text", F.lit("")), F.lit(" [region:"), F.upper("region_id"), F.lit("] [region:"), "mention_id", F.lit("] [region:12]"))
    ids = F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(r"\[region:([0-9a-fA-F-]{36})\]"), 1), F.lower))
    malformed = F.size(F.regexp_extract_all("t", F.lit(r"(\[region:)"), 1)) - F.size(F.regexp_extract_all("t", F.lit(r"(\[region:[0-9a-fA-F-]{36}\])"), 1))
    rows = m.select("mention_id", "region_id", answer.alias("t")).select("mention_id", "region_id", ids.alias("ids"), malformed.alias("malformed"))
    return rows.select("mention_id", F.size(F.filter("ids", lambda x: x == F.col("region_id"))).alias("allowed"), F.size(F.filter("ids", lambda x: x != F.col("region_id"))).alias("foreign_n"), "malformed")


@query(f"""SELECT event_id, count(*) AS participants, string_agg(participant_role || ':' || coalesce(lower(p.entity_id), m.mention_text, '?'), '; ' ORDER BY participant_role || ':' || coalesce(lower(p.entity_id), m.mention_text, '?'), event_participant_id) AS context
FROM {P} p LEFT JOIN {M} m ON m.mention_id = lower(p.mention_id) WHERE p.review_status = 'reviewed' GROUP BY 1""")
def claim_context(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed participants of an event with what they are called, in a fixed order. An event's
    participants are few, so they are collected."""
    people = current(load(spark, d, "event_participant"), "event_participant_id", "event_id", "participant_role", "entity_id", "mention_id", "review_status").where("review_status = 'reviewed'")
    names = live_mentions(spark, d, "mention_text").withColumnRenamed("mention_id", "m")
    said = people.join(names, F.lower("mention_id") == F.col("m"), "left").select("event_id", "event_participant_id", F.concat("participant_role", F.lit(":"), F.coalesce(F.lower("entity_id"), "mention_text", F.lit("?"))).alias("name"))
    entries = F.array_sort(F.collect_list(F.struct("name", "event_participant_id")))
    return said.groupBy("event_id").agg(F.count("*").alias("participants"), F.array_join(F.transform(entries, lambda e: e["name"]), "; ").alias("context"))


@query(f"""WITH l AS (SELECT page_id, region_id, regexp_replace(raw_text, '[\\p{{C}}\\p{{P}}\\p{{S}}\\p{{Z}}]', '', 'g') AS token, reading_order FROM {R} WHERE raw_text IS NOT NULL AND page_id IN (SELECT page_id FROM {R} GROUP BY 1)),
w AS (SELECT page_id, string_agg(token, '' ORDER BY reading_order, region_id) AS whole FROM l GROUP BY 1),
k AS (SELECT page_id, token, whole, strpos(whole, token) AS found, strpos(substr(whole, strpos(whole, token) + 1), token) > 0 AS again FROM l JOIN w USING (page_id)),
o AS (SELECT *, coalesce(max(found + length(token)) OVER (PARTITION BY page_id ORDER BY found ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS cursor FROM k)
SELECT page_id, CASE WHEN bool_or(token = '') THEN 'blank line' WHEN bool_or(again) THEN 'not unique' WHEN bool_or(found <> cursor) OR max(found + length(token)) <> any_value(length(whole)) + 1 THEN 'gaps' ELSE 'accepted' END AS verdict, count(*) AS lines FROM o GROUP BY 1""")
def line_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether the lines of a page stand each once in its whole text, and cover it without gaps."""
    token = F.regexp_replace("raw_text", r"[\p{C}\p{P}\p{S}\p{Z}]", "")
    lines = live_regions(spark, d, "page_id", "reading_order", "raw_text").where("raw_text IS NOT NULL").select("page_id", "region_id", "reading_order", token.alias("token"))
    ordered = F.array_sort(F.collect_list(F.struct("reading_order", "region_id", "token")))
    whole = lines.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["token"]), "").alias("whole"))
    found = F.instr(F.col("whole"), F.col("token"))
    k = lines.join(whole, "page_id").withColumn("found", found).withColumn("again", F.instr(F.substring("whole", F.col("found") + 1, F.char_length("whole")), F.col("token")) > 0)
    before = Window.partitionBy("page_id").orderBy("found").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("found") + F.char_length("token")
    o = k.withColumn("cursor", F.coalesce(F.max(end).over(before), F.lit(1)))
    gaps = F.bool_or(F.col("found") != F.col("cursor")) | (F.max(end) != F.max(F.char_length("whole")) + 1)
    verdict = F.when(F.bool_or(F.col("token") == ""), "blank line").when(F.bool_or("again"), "not unique").when(gaps, "gaps").otherwise("accepted")
    return o.groupBy("page_id").agg(verdict.alias("verdict"), F.count("*").alias("lines"))


@query(f"""SELECT run_id, regions, done, regions = done AS completed FROM (SELECT run_id, count(*) AS regions, count(v.region_id) AS done FROM {R} r LEFT JOIN (SELECT DISTINCT region_id FROM {V} WHERE variant <> 'raw_ocr') v ON v.region_id = r.region_id GROUP BY 1)""")
def completed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs all of whose regions have a result."""
    done = live_versions(spark, d, "region_id", "variant").where("variant <> 'raw_ocr'").select("region_id", F.lit(1).alias("d")).distinct()
    rows = live_regions(spark, d, "run_id").join(done, "region_id", "left")
    return rows.groupBy("run_id").agg(F.count("*").alias("regions"), F.count("d").alias("done")).withColumn("completed", F.col("regions") == F.col("done"))


@query(f"""WITH o AS (SELECT page_id, count(*) AS regions, count(*) FILTER (raw_text = '') AS empty_n FROM {R} GROUP BY 1), p AS (SELECT DISTINCT page_id, volume_number FROM {R})
SELECT volume_number, count(*) AS pages, count(*) FILTER (regions = empty_n) AS failed, round(1 - count(*) FILTER (regions = empty_n) / count(*), 6) AS success FROM p JOIN o USING (page_id) GROUP BY 1""")
def page_failures(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a volume of which nothing was read stay in the denominator as failures."""
    pages = live_regions(spark, d, "page_id", "volume_number", "raw_text").groupBy("page_id", "volume_number").agg(F.count("*").alias("regions"), F.count_if(F.col("raw_text") == "").alias("empty_n"))
    whole = Window.partitionBy("page_id")
    pages = pages.withColumns({"regions": F.sum("regions").over(whole), "empty_n": F.sum("empty_n").over(whole)})
    failed = F.count_if(F.col("regions") == F.col("empty_n"))
    return pages.groupBy("volume_number").agg(F.count("*").alias("pages"), failed.alias("failed"), F.round(1 - failed / F.count("*"), 6).alias("success"))


@query(f"""WITH RECURSIVE c AS (SELECT coalesce(volume_number, -1) AS v, count(*) FILTER (extractor = 'span' AND mention_status = 'reviewed') AS ha, count(*) FILTER (extractor = 'span') AS ta, count(*) FILTER (extractor = 'regex' AND mention_status = 'reviewed') AS hb, count(*) FILTER (extractor = 'regex') AS tb FROM {M} GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY v) - 1 AS i, * FROM c), g AS (SELECT count(*) AS k FROM c),
d AS (SELECT r AS replicate, ('0x' || sha256('17:' || r || ':' || p)[1:7])::BIGINT % k AS i FROM g, unnest(generate_series(0, 199)) AS x(r), unnest(generate_series(0, k - 1)) AS y(p)),
s AS (SELECT replicate, round(CASE WHEN sum(ta) = 0 THEN 1.0 ELSE sum(ha) / sum(ta) END - CASE WHEN sum(tb) = 0 THEN 1.0 ELSE sum(hb) / sum(tb) END, 9) AS score FROM d JOIN n USING (i) GROUP BY 1)
SELECT quantile_disc(score, 0.025) AS low, quantile_disc(score, 0.5) AS mid, quantile_disc(score, 0.975) AS high, round(avg((score > 0)::INT), 6) AS wins FROM s""")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the difference of two extractors' shares, both drawn from the same volumes in every
    replicate, and in how many the first one wins."""
    hit = F.col("mention_status") == "reviewed"
    sums = {f"{n}{k}": F.count_if((F.col("extractor") == e) & c) for k, e in (("a", "span"), ("b", "regex")) for n, c in (("h", hit), ("t", F.lit(True)))}
    clusters = live_mentions(spark, d, "volume_number", "extractor", "mention_status").groupBy(F.coalesce("volume_number", F.lit(-1)).alias("v")).agg(*[c.alias(n) for n, c in sums.items()])
    drawn = scoring.bootstrap_sums(clusters, "v", list(sums), 200, 17)
    score = F.round(scoring.ratio(F.col("ha"), F.col("ta"), 1.0) - scoring.ratio(F.col("hb"), F.col("tb"), 1.0), 9)
    scores = drawn.select(score.alias("score"))
    return scores.agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY score)").alias(n) for q, n in ((0.025, "low"), (0.5, "mid"), (0.975, "high"))], F.round(F.avg((F.col("score") > 0).cast("int")), 6).alias("wins"))
