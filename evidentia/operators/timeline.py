"""Chains, logs and time: closures, state folds, windows and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import cut


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, root`` of all vertices below a root (one row each, the smallest root), roots that
    are not below another root left out. Level by level until nothing is new."""
    reached = cut(edges.join(roots.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("root")))
    front = reached
    while True:
        below = edges.join(front.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("root"))
        better = below.join(reached.withColumnRenamed("root", "known"), "node", "left").where("known IS NULL OR root < known").select("node", "root")
        front = cut(better)
        if front.isEmpty():
            return reached
        reached = cut(reached.unionByName(front).groupBy("node").agg(F.min("root").alias("root")))


def latest_states(log: DataFrame, key: str, as_of: str, seconds: int) -> DataFrame:
    """``key, last_type, last_event, lease`` folded from an event log; the time is a parameter, so
    the result can be repeated."""
    last = F.max_by(F.struct("event_type", "event_id", "ts"), F.struct("ts", "event_id"))
    folded = log.groupBy(key).agg(last.alias("e"))
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp_ntz").cast("timestamp")) - F.unix_timestamp(F.col("e.ts").cast("timestamp"))
    return folded.select(key, F.col("e.event_type").alias("last_type"), F.col("e.event_id").alias("last_event"), F.when(age > seconds, "expired").otherwise("held").alias("lease"))


def tumbling(df: DataFrame, at: str, width: str, keys: list[str], *aggregates: Column) -> DataFrame:
    windows = df.groupBy(F.window(at, width).alias("_w"), *keys).agg(*aggregates)
    return windows.withColumn("start", F.col("_w.start")).drop("_w")



def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """Every left row with the ``columns`` of the last right row of its keys at or before it; null
    where there is none. One shuffle: both sides are stacked and the last right value is carried
    forward in time order."""
    value = F.struct(*columns)
    kept = [c for c in left.columns if c not in (*keys, at)]
    a = left.select(*keys, at, F.lit(1).alias("_side"), F.struct(*kept).alias("_left"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_right"))
    b = right.select(*keys, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), value.alias("_right"))
    before = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(before)).where("_side = 1")
    return carried.select(*keys, at, *[F.col("_left")[c].alias(c) for c in kept], *[F.col("_last")[c].alias(c) for c in columns])


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``island``: the number of the run of consecutive rows with the same value (nulls are
    the same), counted from 1 in each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    fresh = F.when(first | ~F.lag(value).over(w).eqNullSafe(F.col(value)), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def reopened(state: DataFrame, key: str, parent: str, failed: str) -> DataFrame:
    """``key`` of what lies below a failed node, near or far, did not fail itself and has no failed
    sibling."""
    edges = state.where(F.col(parent).isNotNull()).select(F.col(parent).alias("src"), F.col(key).alias("dst"))
    below = descendants(edges, state.where(failed).select(F.col(key).alias("node"))).select(F.col("node").alias(key))
    bad = state.where(F.col(failed) & F.col(parent).isNotNull()).select(parent).distinct()
    return state.where(~F.col(failed)).join(below, key, "left_semi").join(bad, parent, "left_anti").select(key)


def expand_plan(volumes: DataFrame, key: str, pages: str, most: int, stages: list[str]) -> DataFrame:
    """``key, page, stage, fingerprint``: a job for each volume and, for its first ``most`` pages, one for
    each stage. A fingerprint is the digest of the stage, what it works on and the fingerprint of the
    job it follows."""
    first = F.sha2(F.concat(F.lit("volume|"), key), 256)
    chain, prior = [F.struct(F.lit(0).alias("page"), F.lit("volume").alias("stage"), first.alias("fingerprint"))], {}
    whole = volumes.select(key, F.explode(F.array(*chain)).alias("j"))
    page_rows = volumes.where(F.col(pages) > 0).select(key, F.explode(F.sequence(F.lit(1), F.least(F.col(pages), F.lit(most)).cast("int"))).alias("page"))
    prints, before = [], first
    for k, stage in enumerate(stages):
        before = F.sha2(F.concat_ws("|", F.lit(stage), *([F.col("page")] if k == 0 else []), before), 256)
        prints.append(F.struct("page", F.lit(stage).alias("stage"), before.alias("fingerprint")))
    each = page_rows.select(key, F.explode(F.array(*prints)).alias("j"))
    return whole.unionByName(each).select(key, "j.*")


def materialize(spans: DataFrame) -> DataFrame:
    """Articles from ``article_id, region_id, sequence, raw_text, raw_start, raw_end, selected_text,
    selected_sha256``: one row per article with ``status`` (ok or failed), ``reason``, ``parts``,
    ``content`` and ``placed`` (``region_id, start, end`` of each part in the content).

    The stretch of the raw text is carried over to the selected text: as it is if both are equal,
    all of it if it was all of the raw text, else through their alignment. An article fails, alone, if
    its sequence numbers are not 0 to n-1, a digest disagrees, a stretch is empty or lies outside its
    text, or one of its ends lies within a correction. Parts are joined by line ends.
    """
    from evidentia.functions import columns as C
    from evidentia.functions.text import alignment

    whole = (F.col("raw_start") == 0) & (F.col("raw_end") == F.char_length("raw_text"))
    same = F.col("raw_text") == F.col("selected_text")
    partial = ~whole & ~same
    # only stretches that need it are aligned
    rows = spans.withColumn("_ops", alignment(F.when(partial, F.col("raw_text")), F.when(partial, F.col("selected_text"))))
    start = F.when(whole, 0).when(same, F.col("raw_start")).otherwise(C.map_boundary("_ops", "raw_start"))
    end = F.when(whole, F.char_length("selected_text")).when(same, F.col("raw_end")).otherwise(C.map_boundary("_ops", "raw_end"))
    rows = rows.withColumns({"_s": start, "_e": end})
    fault = (
        F.when(~F.coalesce(F.sha2("selected_text", 256) == F.col("selected_sha256"), F.lit(False)), "digest disagrees")
        .when(~F.coalesce((F.col("raw_start") >= 0) & (F.col("raw_start") < F.col("raw_end")) & (F.col("raw_end") <= F.char_length("raw_text")), F.lit(False)), "raw stretch is empty or outside")
        .when(F.col("_s").isNull() | F.col("_e").isNull(), "stretch ends within a correction")
        .when(~((F.col("_s") >= 0) & (F.col("_s") < F.col("_e")) & (F.col("_e") <= F.char_length("selected_text"))), "selected stretch is empty or outside")
    )
    text = F.col("selected_text").substr(F.col("_s") + 1, F.col("_e") - F.col("_s"))
    part = F.struct("sequence", "region_id", fault.alias("fault"), text.alias("text"))
    articles = rows.groupBy("article_id").agg(F.array_sort(F.collect_list(part)).alias("p"))  # an article's parts are few
    numbers = F.transform("p", lambda x: x["sequence"])
    contiguous = numbers == F.sequence(F.lit(0), F.size("p") - 1)
    first_fault = F.get(F.filter(F.transform("p", lambda x: x["fault"]), lambda f: f.isNotNull()), F.lit(0))
    reason = F.when(~F.coalesce(contiguous, F.lit(False)), "sequence numbers are not contiguous").otherwise(first_fault)
    good = F.col("reason").isNull()
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<region_id:string,start:int,end:int>>").alias("out"))

    def place(acc, x):
        stop = acc["at"] + F.char_length(x["text"])
        return F.struct((stop + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(x["region_id"].alias("region_id"), acc["at"].alias("start"), stop.alias("end")))).alias("out"))

    return articles.withColumn("reason", reason).select(
        "article_id", F.when(good, "ok").otherwise("failed").alias("status"), "reason", F.size("p").alias("parts"),
        F.when(good, F.array_join(F.transform("p", lambda x: x["text"]), "\n")).alias("content"), F.when(good, F.aggregate("p", begin, place, lambda acc: acc["out"])).alias("placed"),
    )
