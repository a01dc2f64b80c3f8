"""Operators on ordered texts and on spans within them. Offsets are 0-based, end-exclusive code points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def running_offsets(df: DataFrame, unit: str, order: list[str], text: str, separator: int = 1) -> DataFrame:
    """``df`` with ``start, end`` of each text in its unit when the unit's texts are joined by a
    separator of that many characters. Null and empty texts are left out before."""
    frame = Window.partitionBy(unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kept = df.where(F.col(text).isNotNull() & (F.col(text) != ""))
    start = F.coalesce(F.sum(F.char_length(text) + separator).over(frame), F.lit(0))
    return kept.withColumn("start", start).withColumn("end", F.col("start") + F.char_length(text))


def assemble(df: DataFrame, unit: str, order: list[str], text: str, separator: str = "\n") -> DataFrame:
    """``unit, content, parts``: the texts of each unit in order, joined. A unit is a page or an
    article, so the collected group is bounded by what fits on it."""
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != ""))
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(unit).agg(ordered.alias("_p")).select(unit, F.array_join(F.col("_p._t"), separator).alias("content"), F.size("_p").alias("parts"))


def pack_windows(df: DataFrame, unit: str, order: list[str], text: str, most_parts: int, most_chars: int) -> DataFrame:
    """``unit, window_no, parts, chars``: texts in order, packed into windows of at most so many
    parts and characters; a separator counts as one, a text longer than a window has its own, and
    an empty text never opens one. The state resets at places that depend on the data, so it is a
    fold over the ordered texts of one unit (a page)."""
    size = F.coalesce(F.char_length(text), F.lit(0))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, size.alias("_n")))), lambda p: p["_n"])
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("k"), F.lit(0).alias("c"), F.array().cast("array<struct<w:int,n:int>>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["k"] > 0) & (n > 0) & ((acc["k"] >= most_parts) | (acc["c"] + F.when(acc["c"] > 0, 1).otherwise(0) + n > most_chars))
        w = F.when(full, acc["w"] + 1).otherwise(acc["w"])
        k = F.when(full, 1).otherwise(acc["k"] + 1)
        c = F.when(full, n).otherwise(acc["c"] + F.when((acc["c"] > 0) & (n > 0), 1).otherwise(0) + n)
        return F.struct(w.alias("w"), k.alias("k"), c.alias("c"), F.concat(acc["out"], F.array(F.struct(w.alias("w"), n.alias("n")))).alias("out"))

    folded = df.groupBy(unit).agg(F.aggregate(ordered, start, step, lambda acc: acc["out"]).alias("o"))
    return folded.select(unit, F.explode("o").alias("p")).groupBy(unit, F.col("p.w").alias("window_no")).agg(F.count("*").cast("int").alias("parts"), F.sum("p.n").cast("int").alias("chars"))


def gaps(df: DataFrame, unit: str, start: str, end: str) -> DataFrame:
    """``unit, gaps, overlaps`` between neighbouring spans of a unit."""
    before = F.max(end).over(Window.partitionBy(unit).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(unit, start, before.alias("_b"))
    return marked.groupBy(unit).agg(F.count_if(F.col(start) > F.col("_b")).alias("gaps"), F.count_if(F.col(start) < F.col("_b")).alias("overlaps"))


def within(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, low: int, high: int) -> DataFrame:
    """Range join: pairs of rows that agree in ``keys`` with ``low <= right.start - left.at <= high``. Places
    are cut into bins as wide as the range and joined by equality with two of them, so that a group of
    very many rows is parted and only neighbours meet. Nulls meet nothing."""
    width = high - low + 1
    own = F.floor(F.col(at) / width)
    a = left.withColumn("_bin", F.explode(F.array(own, own + 1)))
    b = right.withColumn("_bin", F.floor((F.col(start) - low) / width))
    return a.join(b, [*keys, "_bin"]).where((F.col(start) - F.col(at)).between(low, high)).drop("_bin")


def occurrences(text: str, part: str) -> Column:
    """Number of (also overlapping) occurrences of a non-empty part in a text."""
    places = F.sequence(F.lit(1), F.char_length(text) - F.char_length(part) + 1)
    found = F.filter(places, lambda i: F.col(text).substr(i, F.char_length(part)) == F.col(part))
    return F.when((F.char_length(part) > 0) & (F.char_length(part) <= F.char_length(text)), F.size(found)).otherwise(0)


def pattern_spans(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """``key, span_start, span_end, surface`` of every match of a pattern (without groups that capture) in a
    text. Matches are marked by a character that is in no text and the text is parted at the marks, so
    offsets are running sums of the lengths of what stands between and within; no Python is involved.
    Null texts have no spans, matches of nothing neither."""
    mark = "\uffff"
    clean = F.replace(F.col(text), F.lit(mark), F.lit(" "))
    parts = F.split(F.regexp_replace(clean, f"({pattern})", f"{mark}$1{mark}"), mark)
    rows = df.where(F.col(text).isNotNull() & F.col(text).rlike(pattern)).select(key, parts.alias("_p")).select(key, F.explode(F.arrays_zip(F.col("_p").alias("s"), _starts("_p").alias("a"), F.sequence(F.lit(0), F.size("_p") - 1).alias("i"))).alias("x"))
    return rows.where("x.i % 2 = 1 AND x.s <> ''").select(key, F.col("x.a").alias("span_start"), (F.col("x.a") + F.char_length("x.s")).alias("span_end"), F.col("x.s").alias("surface"))


def _starts(parts: str) -> Column:
    """Offsets at which the parts of a text begin."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        return F.struct((acc["at"] + F.char_length(part)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    return F.aggregate(parts, begin, step, lambda acc: acc["out"])


def sliding(size: Column, limit: int, step: int) -> Column:
    """Starts of windows of ``limit`` tokens, ``step`` apart; the last one reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((size - limit) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * step)


def box_of(points: str) -> Column:
    """Bounding box of an array of ``x, y`` points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def polygon_area(points: str) -> Column:
    """Area by the shoelace rule; null for fewer than three points."""
    n = F.size(points)
    turned = F.concat(F.slice(points, 2, 1 << 30), F.slice(points, 1, 1))
    terms = F.zip_with(points, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(n >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2)


def bag_f1(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """``key, f1`` of the multisets of characters of two texts, white space left out: 1 if both are
    blank, 0 if one is. Characters are counted per text first, so what is shuffled is bounded by the
    distinct characters of each."""
    plain = [F.split(F.regexp_replace(side, r"[\s\x{85}\p{Z}]", ""), "") for side in (left, right)]
    chars = pairs.select(key, F.explode(F.concat(*[F.transform(p, _marked(k)) for k, p in enumerate(plain)])).alias("c")).select(key, "c.*").where("ch <> ''")
    counted = chars.groupBy(key, "ch").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = counted.groupBy(key).agg(F.sum(F.least("a", "b")).alias("m"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return pairs.select(key).join(sums, key, "left").select(key, F.when(F.col("m").isNull(), 1.0).otherwise(2 * F.col("m") / (F.col("a") + F.col("b"))).alias("f1"))


def _marked(side: int):
    return lambda c: F.struct(c.alias("ch"), F.lit(1 - side).alias("a"), F.lit(side).alias("b"))


def mean_by_place(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, place, mean``: the mean of vectors, number by number (0-based); sums are combined before
    the shuffle, so it does not matter how many vectors a key has. Null vectors are left out."""
    numbers = df.select(key, F.posexplode(vector).alias("place", "x"))
    return numbers.groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def _corner(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float]) -> float:
    return (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])


def convex(points: list[tuple[float, float]]) -> bool:
    """Whether a polygon turns in one direction only; straight corners do not count."""
    n = len(points)
    turns = {t > 0 for k in range(n) if (t := _corner(points[k], points[(k + 1) % n], points[(k + 2) % n])) != 0}
    return n >= 3 and len(turns) == 1


def _signed(points: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 2


def clip(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a convex polygon within another convex one: for each side of the window what lies
    beyond it is cut off."""
    if _signed(window) < 0:
        window = window[::-1]
    out = list(subject)
    for (x1, y1), (x2, y2) in zip(window, window[1:] + window[:1]):
        dx, dy = x2 - x1, y2 - y1
        beside = [dx * (y - y1) - dy * (x - x1) for x, y in out]  # positive on the inner side
        kept: list[tuple[float, float]] = []
        for k, here in enumerate(out):
            before, s0, s1 = out[k - 1], beside[k - 1], beside[k]
            if (s0 < 0) != (s1 < 0):
                t = s0 / (s0 - s1)
                kept.append((before[0] + t * (here[0] - before[0]), before[1] + t * (here[1] - before[1])))
            if s1 >= 0:
                kept.append(here)
        out = kept
        if not out:
            break
    return out


def overlap_of(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float | None:
    """Intersection over union; None unless both are convex, 0 where there is no area."""
    if not convex(a) or not convex(b):
        return None
    common = abs(_signed(clip(a, b)))
    union = abs(_signed(a)) + abs(_signed(b)) - common
    return common / union if union > 0 else 0.0


def _corners(value) -> list[tuple[float, float]] | None:
    return None if value is None else [(float(p["x"]), float(p["y"])) for p in value]


@F.pandas_udf(T.BooleanType())
def is_convex(points: pd.Series) -> pd.Series:
    return points.map(lambda p: None if p is None else convex(_corners(p)))


@F.pandas_udf(T.DoubleType())
def polygon_iou(left: pd.Series, right: pd.Series) -> pd.Series:
    """Intersection over union of two polygons; null for null and concave ones."""
    return pd.Series([None if a is None or b is None else overlap_of(_corners(a), _corners(b)) for a, b in zip(left, right, strict=True)], dtype="float64")


def chunks(df: DataFrame, text: str, protected: str, most: int) -> DataFrame:
    """``df`` with ``chunk_no, chunk_start, chunk_end``, a row for each chunk of the text that
    :func:`evidentia.functions.text.chunk_ranges` makes; a text that cannot be cut has one row of nulls,
    an empty one none. ``protected`` is an array of ``start, end`` structs."""
    from evidentia.functions.text import chunk_ranges

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def cuts(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for value, taken in zip(texts, spans, strict=True):
            ranges = chunk_ranges(value or "", [tuple(x.values()) for x in (taken if taken is not None else [])], most)
            out.append([{"s": None, "e": None}] if ranges is None else [{"s": a, "e": b} for a, b in ranges])
        return pd.Series(out)

    rows = df.select("*", F.posexplode(cuts(text, protected)).alias("chunk_no", "_c"))
    return rows.withColumns({"chunk_start": F.col("_c.s"), "chunk_end": F.col("_c.e")}).drop("_c")
