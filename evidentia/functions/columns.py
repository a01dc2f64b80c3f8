"""Functions of columns that are compositions of built-ins; they stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def passes(value: str | Column, least: float) -> Column:
    """Whether a value reaches a threshold; null, which is not known to fail, passes."""
    value = _column(value)
    return value.isNull() | (value >= least)


def longer_than_blank(text: str | Column, least: int = 2) -> Column:
    """Whether a text has so many characters without outer spaces; null has none."""
    return F.coalesce(F.char_length(F.trim(_column(text))) >= least, F.lit(False))


def left_context(text: str | Column, start: str | Column, size: int) -> Column:
    """At most ``size`` characters before a 0-based offset, clipped at the beginning of the text."""
    text, start = _column(text), _column(start)
    return text.substr(F.greatest(F.lit(0), start - size) + 1, F.least(F.lit(size), start))


def right_context(text: str | Column, end: str | Column, size: int) -> Column:
    """At most ``size`` characters from a 0-based offset on, clipped at the end of the text."""
    return _column(text).substr(_column(end) + 1, F.lit(size))


def places_of(text: str | Column, part: str | Column, left: str | Column = "", right: str | Column = "") -> Column:
    """0-based offsets of all occurrences of ``part``, also overlapping ones, that follow ``left`` and
    precede ``right``; none for an empty part or nulls."""
    text, part = _column(text), _column(part)
    left, right = (F.lit("") if isinstance(x, str) and x == "" else _column(x) for x in (left, right))
    whole = F.concat(left, part, right)
    last = F.char_length(text) - F.char_length(whole)
    starts = F.filter(F.sequence(F.lit(0), last), lambda k: text.substr(k + 1, F.char_length(whole)) == whole)
    found = F.transform(starts, lambda k: k + F.char_length(left))
    return F.coalesce(F.when((last >= 0) & (part != ""), found), F.array().cast("array<int>"))


def only_place(text: str | Column, part: str | Column, left: str | Column = "", right: str | Column = "") -> Column:
    """The 0-based offset of the only occurrence in context; null for none or several."""
    places = places_of(text, part, left, right)
    return F.when(F.size(places) == 1, F.get(places, F.lit(0)))


def times_apart(text: str | Column, part: str | Column) -> Column:
    """Occurrences that do not overlap, counted from the left; 0 for an empty part."""
    text, part = _column(text), _column(part)
    without = F.char_length(F.replace(text, part, F.lit("")))
    return F.when(F.char_length(part) > 0, ((F.char_length(text) - without) / F.char_length(part)).cast("int")).otherwise(0)


def number_after(text: str | Column, mark: str) -> Column:
    """The number behind a mark in a path, such as ``vol-`` in ``vol-0219.pdf``; null without one."""
    return F.expr(f"try_cast(nullif(regexp_extract({text if isinstance(text, str) else text._jc.toString()}, '{mark}([0-9]+)', 1), '') AS int)")


# Media types by file extension.
MEDIA_TYPES = {"pdf": "application/pdf", "djvu": "image/vnd.djvu", "djv": "image/vnd.djvu", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff"}


def media_type(path: str | Column) -> Column:
    """Media type by extension in any case, ``application/octet-stream`` for others."""
    extension = F.lower(F.regexp_extract(_column(path), r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension), F.lit("application/octet-stream"))


def page_label(volume: str | Column, page: str | Column) -> Column:
    """``v219-p0308``; null if a part is null."""
    volume, page = _column(volume), _column(page)
    return F.when(volume.isNotNull() & page.isNotNull(), F.format_string("v%03d-p%04d", volume, page))


def sections(text: str | Column, headings: list[str]) -> tuple[Column, Column]:
    """Headings that a text lacks (joined by commas), and whether those it has stand in this order."""
    at = [F.instr(_column(text), h) for h in headings]
    missing = F.array_join(F.filter(F.array(*[F.when(a == 0, F.lit(h)) for a, h in zip(at, headings, strict=True)]), lambda x: x.isNotNull()), ",")
    present = F.filter(F.array(*at), lambda a: a > 0)
    return missing, present == F.array_sort(present)


def token_offset(text: str | Column, offset: str | Column) -> Column:
    """Number of characters that are no white space before a 0-based offset."""
    return F.char_length(F.regexp_replace(_column(text).substr(F.lit(1), _column(offset)), r"\s", ""))


def norm(vector: str | Column) -> Column:
    return F.sqrt(F.aggregate(_column(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def is_finite(vector: str | Column) -> Column:
    """Whether all numbers of a vector are finite; null vectors are not, empty ones are."""
    bound = F.lit(float("inf"))
    return F.coalesce(F.forall(_column(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < bound)), F.lit(False))


def unit(vector: str | Column) -> Column:
    """The vector with length 1; null for vectors of zeros or with what is no finite number."""
    vector = _column(vector)
    length = norm(vector)
    return F.when(is_finite(vector) & (length > 0), F.transform(vector, lambda x: x.cast("double") / length))


def clamp(value: str | Column, low: float = -1.0, high: float = 1.0) -> Column:
    """The value within bounds; null stays null."""
    value = _column(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def to_pixels(value: str | Column, size: str | Column, scale: int = 1000) -> Column:
    """A coordinate of ``[0, scale]`` in pixels of a page of that size, half to even, within the page."""
    size = _column(size)
    return F.least(F.greatest(F.bround(_column(value) * size / scale), F.lit(0.0)), size.cast("double")).cast("int")


def comparison_text(text: str | Column, composed) -> Column:
    """Characters of a text that count in comparisons: coordinates at line ends and tags left out,
    composed (by the function ``composed``), without controls, punctuation, symbols and spaces."""
    pair = r"\(?\d{1,4}\s*,\s*\d{1,4}\)?\s*"
    plain = F.regexp_replace(F.regexp_replace(_column(text), rf"(?m)(?:\s*{pair},\s*{pair})+$", ""), r"<[^>]+>", "")
    return F.regexp_replace(composed(plain), r"[\p{C}\p{P}\p{S}\p{Z}]", "")


def map_boundary(operations: str | Column, offset: str | Column) -> Column:
    """Where an offset of the left text lies in the right one by alignment operations (``op, a_start,
    a_end, b_start, b_end``); null within a changed stretch and outside the alignment."""
    offset = _column(offset)
    inside = F.filter(_column(operations), lambda o: (o["a_start"] <= offset) & (offset <= o["a_end"]))
    first = F.get(inside, F.lit(0))
    at_end = F.when(first["a_start"] == offset, first["b_start"]).when(first["a_end"] == offset, first["b_end"])
    return F.coalesce(at_end, F.when(first["op"] == "equal", first["b_start"] + (offset - first["a_start"])))


def failed(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold (null counts as not), in their order, joined by commas."""
    return F.array_join(F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull()), ",")


def first_reason(reasons: dict[str, Column], otherwise: str) -> Column:
    """The first reason, in their order, whose condition holds."""
    chain = reduce(lambda done, item: done.when(item[1], item[0]), list(reasons.items())[1:], F.when(*reversed(next(iter(reasons.items())))))
    return chain.otherwise(otherwise)
