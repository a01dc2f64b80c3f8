"""Visually identical text with different characters.

Method: every value is mapped character by character (width, compatibility forms, look-alike
letters, kinds of space and hyphen; invisible characters are dropped), the mapped values are grouped
in SQL under the accent-sensitive Unicode collation, which also takes composed and decomposed
accents as equal, one member of each class is chosen as its canonical form, and the form is joined
back to the rows.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.session import cut
from evidentia.sources.tables import current, load

# Letters of other alphabets that print like a Latin letter, pair by pair.
_CYRILLIC = "АAВBЕEЅSІIЈJКKМMНHОOРPСCТTУYХXаaеeоoрpсcуyхxѕsіiјjһhԁdԛqԜWԝwҮYӀI"
_GREEK = "ΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXοoνvϳjͿJ"
_HYPHENS = "‐‑‒−"
#: Characters without a glyph: format characters, variation selectors, joiners and fillers.
INVISIBLE = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]"


@cache
def _confusable(spark: SparkSession) -> dict[str, str]:
    """Letters of other alphabets than the Latin one and what Latin letter of the same case they print
    like, by the published table of confusable characters in the engine's own Unicode library."""
    letters = [chr(c) for c in [*range(0x370, 0xD800), *range(0x10000, 0x1F000)] if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lo")]
    letters = [c for c in letters if not unicodedata.name(c, "LATIN").startswith(("LATIN", "CJK", "HANGUL", "HIRAGANA", "KATAKANA", "YI ", "CUNEIFORM", "EGYPTIAN", "ANATOLIAN", "TANGUT", "BAMUM", "VAI "))]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    latin = [c for c in map(chr, range(0x41, 0x7B)) if c.isalpha()]

    def skeletons(chars: list[str]) -> list[str]:
        out = checker.getSkeleton("\n".join(chars)).split("\n")
        return out if len(out) == len(chars) else [checker.getSkeleton(c) for c in chars]

    like: dict[tuple[str, str], str] = {}
    for char, skeleton in zip(latin, skeletons(latin), strict=True):
        like.setdefault((skeleton, unicodedata.category(char)), char)
    found = {c: like.get((k, "Lu" if unicodedata.category(c) == "Lu" else "Ll")) for c, k in zip(letters, skeletons(letters), strict=True)}
    return {c: to for c, to in found.items() if to}


@cache
def _mapping(spark: SparkSession | None = None) -> tuple[str, str]:
    """Characters and what each is mapped to. Compatibility forms of one character (full and half
    width, radicals, presentation forms) follow from the Unicode data by rule, letters that print
    like Latin ones from the table of confusable characters; without a session, as for the SQL that
    results are checked against, only the fixed ones count."""
    pairs: dict[str, str] = {}
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x2F800, 0x2FA20)]:
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        if unicodedata.category(char) == "Zs":
            pairs[char] = " "
        # superscripts and the like print differently; accented letters stay whole
        elif plain != char and len(plain) == 1 and not unicodedata.decomposition(char).startswith(("<super>", "<sub>", "<font>", "<circle>")):
            pairs[char] = plain
    pairs.update(_confusable(spark) if spark is not None else {})
    for group in (_CYRILLIC, _GREEK):
        pairs.update(zip(group[::2], group[1::2], strict=True))
    pairs.update(dict.fromkeys(_HYPHENS, "-"))
    # half-width voicing marks follow their letter like combining ones
    pairs["ﾞ"], pairs["ﾟ"] = "゙", "゚"
    return "".join(pairs), "".join(pairs.values())


def mapped(value: Column | str) -> Column:
    """The look-alike-mapped value; null stays null. Letter case, spelling, accents and character
    variants are kept."""
    plain = F.translate(F.regexp_replace(value, INVISIBLE, ""), *_mapping(SparkSession.getActiveSession()))
    for ligature in map(chr, range(0xFB00, 0xFB07)):  # several letters in one
        plain = F.replace(plain, F.lit(ligature), F.lit(unicodedata.normalize("NFKC", ligature)))
    return plain


def canonical_forms(values: DataFrame) -> DataFrame:
    """``value, canonical`` for every distinct ``value`` of the input.

    Values look the same if their mapped forms are equal under the collation. The canonical form
    of a class is its most frequent member, the first in binary order on ties. Nulls are left out,
    the empty text is a class of its own together with values of invisible characters only.
    """
    counted = values.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    keyed = counted.withColumn("look", F.collate(mapped("value"), "UNICODE"))
    keyed.createOrReplaceTempView("evidentia_looks")
    classes = values.sparkSession.sql(
        "SELECT look, min_by(value, struct(-n, value)) AS canonical FROM evidentia_looks GROUP BY look"
    )
    return keyed.join(classes, "look").select("value", "canonical")


def same_looks(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """Pairs of mentions of one region whose value in a field looks the same but differs in
    characters: ``field_name, left_mention_id, right_mention_id``, the smaller id first. ``rows``
    has ``mention_id, region_id, field_name, value``.

    Pairs are formed between the distinct values of a class within a region, and only then between
    mentions, so equal values never meet and no pair is made that is not a result.
    """
    group = ["field_name", "region_id", "canonical"]
    classes = forms.groupBy("canonical").agg(F.count("*").alias("n")).where("n > 1").select("canonical")
    # the values of a class are numbered, so that only the canonical form travels on
    number = F.row_number().over(Window.partitionBy("canonical").orderBy("value")).alias("member")
    various = forms.join(classes, "canonical", "left_semi").select("value", "canonical", number)
    members = rows.where("value IS NOT NULL AND region_id IS NOT NULL").join(various, "value").drop("value")
    several = members.groupBy(*group).agg(F.min("member").alias("least"), F.max("member").alias("most")).where("least < most").select(*group)
    odd = cut(members.join(several, group, "left_semi"))
    values = odd.select(*group, "member").distinct()
    pairs = values.join(values.withColumnRenamed("member", "other"), group).where("member < other")
    left = odd.select(*group, "member", F.col("mention_id").alias("a"))
    right = odd.select(*group, F.col("member").alias("other"), F.col("mention_id").alias("b"))
    return pairs.join(left, [*group, "member"]).join(right, [*group, "other"]).select(
        "field_name", F.least("a", "b").alias("left_mention_id"), F.greatest("a", "b").alias("right_mention_id")
    )


_UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def _packed(column: str) -> Column:
    """A key as bytes: half the size for uuid text, which no codec compresses; others stay whole."""
    plain = F.concat(F.lit(b"\x00"), F.encode(column, "utf-8"))
    return F.when(F.col(column).rlike(_UUID), F.concat(F.lit(b"\x01"), F.unhex(F.replace(column, F.lit("-"), F.lit(""))))).otherwise(plain)


def _unpacked(column: str) -> Column:
    body = F.substring(column, 2, 1 << 20)
    uuid = F.regexp_replace(F.lower(F.hex(body)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(F.substring(column, 1, 1) == F.lit(b"\x01"), uuid).otherwise(F.decode(body, "utf-8"))


FIELDS = ("mention_text", "normalized_text")


def _state(spark: SparkSession, folder: str) -> DataFrame:
    """The state of the mentions with packed ids."""
    rows = load(spark, folder, "mention_queue").select("ingested_at", *FIELDS, *[_packed(c).alias(c) for c in ("mention_id", "region_id")])
    return current(rows, "mention_id", "region_id", *FIELDS)


def _forms(state: DataFrame) -> DataFrame:
    return canonical_forms(state.select(F.explode(F.array(*FIELDS)).alias("value")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    state = _state(spark, folder)
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS]))
    rows = state.select("mention_id", "region_id", fields.alias("f")).select("mention_id", "region_id", "f.*")
    forms = cut(_forms(load(spark, folder, "mention_queue")))  # classes of all values that were ever delivered
    pairs = same_looks(rows, forms).select("field_name", _unpacked("left_mention_id").alias("a"), _unpacked("right_mention_id").alias("b"))
    return pairs.select("field_name", F.least("a", "b").alias("left_mention_id"), F.greatest("a", "b").alias("right_mention_id"))


def p7_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every mention with the consistent form of both fields."""
    state = _state(spark, folder)
    forms = _forms(state)
    for field in FIELDS:
        own = forms.select(F.col("value").alias(field), F.col("canonical").alias(f"{field}_form"))
        state = state.join(own, field, "left")
    return state.select(_unpacked("mention_id").alias("mention_id"), *[f"{field}_form" for field in FIELDS])


def _found_sql() -> str:
    """The same pairs with composed text instead of a collation."""
    source, target = (part.replace("'", "''") for part in _mapping())
    parts = [
        f"""SELECT '{field}' AS field_name, region_id, mention_id, {field} AS v, nfc_normalize(translate(regexp_replace({field}, '{INVISIBLE}', '', 'g'), '{source}', '{target}')) AS look FROM m"""
        for field in FIELDS
    ]
    return f"""WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY ingested_at DESC) AS rn FROM mention_queue) WHERE rn = 1),
    l AS ({" UNION ALL ".join(parts)})
    SELECT a.field_name, a.mention_id AS left_mention_id, b.mention_id AS right_mention_id FROM l a JOIN l b
    ON a.field_name = b.field_name AND a.region_id = b.region_id AND a.look = b.look AND a.v <> b.v AND a.mention_id < b.mention_id"""


def _forms_sql() -> str:
    source, target = (part.replace("'", "''") for part in _mapping())
    look = f"nfc_normalize(translate(regexp_replace(v, '{INVISIBLE}', '', 'g'), '{source}', '{target}'))"
    return f"""WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY ingested_at DESC) AS rn FROM mention_queue) WHERE rn = 1),
    c AS (SELECT v, count(*) AS n FROM (SELECT mention_text AS v FROM m UNION ALL SELECT normalized_text FROM m) WHERE v IS NOT NULL GROUP BY 1), k AS (SELECT v, n, {look} AS look FROM c),
    f AS (SELECT look, arg_min(v, (-n, v)) AS canonical FROM k GROUP BY 1), x AS (SELECT v, canonical FROM k JOIN f USING (look))
    SELECT mention_id, a.canonical AS mention_text_form, b.canonical AS normalized_text_form FROM m LEFT JOIN x a ON a.v = mention_text LEFT JOIN x b ON b.v = normalized_text"""


QUERIES = {"p7_found": p7_found, "p7_forms": p7_forms}
ORACLE = {"p7_found": _found_sql(), "p7_forms": _forms_sql()}
