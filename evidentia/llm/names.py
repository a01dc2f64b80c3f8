"""Variant spellings of names typed by people.

Method: names are parted into tokens (words; in scripts without spaces whole runs), and similar
tokens of mentions and catalogue are found by a set-similarity join on their q-grams with prefix
filtering: grams are ordered by rarity, and only the rarest of each token, as many as the threshold
requires, are joined. Catalogue names that share enough token weight with a mention are candidates
and are verified by a soft weighted token similarity, in which rare tokens count more: tokens are
soft equals if one is an initial, an abbreviation, a familiar form, a homophone or a slip of the
other. A mention is linked if one entity is best by a margin.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.lookalikes import mapped
from evidentia.session import cut
from evidentia.sources.tables import current, load

#: Least Jaccard similarity of the q-grams of two tokens.
SIMILAR = 0.3
#: Share of a catalogue name's token weight that a candidate must have in similar tokens.
WEIGHT_SHARE = 0.3
#: Least score of a link, and least lead over the next entity (more for lower scores).
ACCEPT, MARGIN, LEAD = 0.72, 0.015, 0.3

# Forms of address and legal forms around a name, in lower case.
_TITLES = "mr mrs ms miss mme mlle dr rev prof sir lady madame monsieur frau frl herr".split()
_TITLES_HAN = "女士 夫人 小姐 先生 醫生 女史 太太 博士 君 氏".split()
_AROUND_HAN = "株式會社 本埠 私立 本店 支店".split()
_FILLERS = frozenset("the of de and".split())
# One-character names of cities, as on number plates and newspaper mastheads.
_CITIES = {"津": "天津", "漢": "漢口", "甬": "寧波", "粵": "廣州", "穗": "廣州", "閩": "福州", "榕": "福州", "滬": "上海", "申": "上海", "蘇": "蘇州", "杭": "杭州", "錫": "無錫", "鎮": "鎮江", "寧": "南京"}
_HAN = regex.compile(r"[\p{Han}\p{Katakana}\p{Hiragana}ー]+")
_NOT_HAN_NAME = regex.compile(r"[^\p{Han}\p{Katakana}\p{Hiragana}ー]+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}'’]+\.?")


@cache
def bare(word: str) -> str:
    """Letters without accents and apostrophes."""
    folded = unicodedata.normalize("NFD", word.replace("ø", "o"))
    return "".join(c for c in folded if c.isalnum())


def is_han(text: str) -> bool:
    return bool(_HAN.search(text))


class Hanzi(NamedTuple):
    """Simplified forms and toneless readings of Han characters, as the Unicode data of the engine's own
    library has them. Names are compared in simplified form, since many traditional characters
    have one, but not the other way round."""

    simplified: dict[int, str]
    readings: dict[str, str]

    def fold(self, text: str) -> str:
        return text.translate(self.simplified)


@cache
def hanzi(spark: SparkSession, chars: str) -> Hanzi:
    """What is known of the given characters; a few thousand, whatever the number of names."""
    if not chars:
        return Hanzi({}, {})
    icu = spark._jvm.com.ibm.icu.text.Transliterator
    simple = icu.getInstance("Traditional-Simplified").transliterate(chars)
    if len(simple) != len(chars):
        return Hanzi({}, {})
    own = sorted(set(simple))
    spoken = icu.getInstance("Han-Latin; NFD; [:Mn:] Remove; Lower").transliterate("\n".join(own)).split("\n")
    readings = {c: r for c, r in zip(own, spoken, strict=False) if r.isascii() and r.isalpha()} if len(spoken) == len(own) else {}
    return Hanzi({ord(a): b for a, b in zip(chars, simple, strict=True) if a != b}, readings)


def name_key(value: str, kind: str | None, known: Hanzi = Hanzi({}, {})) -> str:  # noqa: B008
    """Tokens of a look-alike-mapped name, separated by spaces; what is no part of a name (titles,
    legal forms, brackets, fillers) is left out. An acronym keeps its capitals."""
    value = unicodedata.normalize("NFKC", value).strip()
    if is_han(value):
        fold = known.fold
        place = regex.search(r"[(（]([\p{Han}]+)[)）]\s*$", value)
        text = fold(_NOT_HAN_NAME.sub("", value[: place.start()] if place else value))
        if place:
            text = fold(place.group(1)) + text
        for mark in map(fold, _AROUND_HAN):
            text = text.removeprefix(mark).removesuffix(mark) if len(text) > len(mark) + 1 else text
        if kind == "person":
            for title in map(fold, _TITLES_HAN):
                if text.endswith(title) and len(text) - len(title) >= 2:
                    text = text.removesuffix(title)
                    break
                if text[1:].startswith(title) and len(text) - len(title) >= 2:
                    text = text[0] + text[1 + len(title) :]
                    break
        else:
            cities = {fold(a): fold(b) for a, b in _CITIES.items()}
            if text[:1] in cities and text[:2] not in cities.values():
                text = cities[text[0]] + text[1:]
        return text
    letters = regex.sub(r"[^\p{L}]", "", value)
    if 3 <= len(letters) <= 6 and letters.isupper() and len(_WORD.findall(value.replace(".", ". "))) in (1, len(letters)) and (kind != "person"):
        return letters
    words = _WORD.findall(regex.sub(r"(?<=\p{L})[-‐–](?=\p{L})", " ", value.replace("’", "'")).casefold())
    words = [w if len(w) > 3 else w.rstrip(".") for w in words]
    if kind == "person":
        words = [w for w in words if w.rstrip(".") not in _TITLES] or words
    words = [w for w in words if w.strip("'.") and w not in _FILLERS]
    return " ".join(w.strip("'") if kind == "person" else w for w in words)


def syllables(names: list[tuple[str, list[str]]], known: Hanzi = Hanzi({}, {})) -> dict[str, str]:  # noqa: B008
    """Romanised form of each (simplified) character, from names that have an alias with as many syllables."""
    seen: dict[str, Counter] = {}
    for name, aliases in names:
        if is_han(name) and len(name) <= 4:
            for alias in aliases:
                parts = regex.split(r"[\s-]+", alias.casefold())
                if not is_han(alias) and len(parts) == len(name):
                    for char, part in zip(known.fold(name), parts, strict=False):
                        seen.setdefault(char, Counter())[part] += 1
    return {char: min(c.items(), key=lambda x: (-x[1], x[0]))[0] for char, c in seen.items()}


def one_slip(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours makes ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


class Verifier:
    """Soft weighted token similarity of a mention's key and a catalogue name's key."""

    def __init__(self, weights: dict[str, float], readings: dict[str, str], nicknames: dict[str, set[str]], spoken: dict[str, str] | None = None):
        self.weights, self.readings, self.nicknames, self.spoken = weights, readings, nicknames, spoken or {}
        self.most = max(weights.values(), default=1.0)

    def weight(self, token: str) -> float:
        return self.weights.get(token, self.most)

    def score(self, mention: str, name: str, kind: str) -> float:
        if mention == name:
            return 1.0
        if is_han(name):
            if not is_han(mention):
                return 0.0
            return self._person_han(mention, name) if kind == "person" else self._body_han(mention, name)
        if is_han(mention):
            return 0.0
        return self._latin(mention.split(), name.split(), kind)

    def _sound_alike(self, a: str, b: str) -> bool:
        """By the romanised names of the catalogue or by the readings of the characters."""
        return any(known.get(a) is not None and known.get(a) == known.get(b) for known in (self.readings, self.spoken))

    def _person_han(self, mention: str, name: str) -> float:
        if len(mention) == len(name) and len(name) > 1:
            odd = [(a, b) for a, b in zip(mention, name, strict=True) if a != b]
            if len(odd) == 1 and mention[0] == name[0] and self._sound_alike(*odd[0]):
                return 0.9
            return 0.0
        if len(mention) == len(name) - 1 >= 2 and name[1:] == mention:  # the given name alone
            return 0.8
        return 0.0

    def _body_han(self, mention: str, name: str) -> float:
        if len(mention) == len(name) and sorted(mention) == sorted(name) and mention in name + name:
            return 0.95
        rows = [[0.0] * (len(name) + 1) for _ in range(len(mention) + 1)]  # heaviest common subsequence
        for i, a in enumerate(mention, 1):
            for j, b in enumerate(name, 1):
                rows[i][j] = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + self.weight(b) if a == b else 0.0)
        extra = list(mention)
        i, j = len(mention), len(name)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                extra[i - 1] = ""
                i, j = i - 1, j - 1
        # a doubled character and one (but no more) that no name has are slips; the end of a name
        # tells its kind
        known = [k for k, c in enumerate(extra) if c and c in self.weights and c not in mention[max(0, k - 1) : k] + mention[k + 1 : k + 2]]
        strange = [k for k, c in enumerate(extra[: len(mention) - 2]) if c and c not in self.weights]
        more = sum(self.weight(mention[k]) * (0.3 if k >= len(mention) - 2 else 1.0) for k in known) + self.most * max(0, len(strange) - 1)
        common, whole = rows[-1][-1], sum(map(self.weight, name))
        return 0.0 if more > 0.08 * whole else 0.98 * common / (0.65 * common + 0.35 * whole + more)

    def _soft(self, a: str, b: str, kind: str) -> float:
        if a == b:
            return 1.0
        plain_a, plain_b = bare(a), bare(b)
        if plain_a == plain_b:
            return 0.98
        if not plain_a or not plain_b:
            return 0.0
        if len(plain_a) == 1:
            return 0.85 if kind == "person" and plain_b[0] == plain_a else 0.0
        if b in self.nicknames.get(a, ()):
            return 0.95
        if a.endswith(".") and len(plain_a) >= 3 and plain_a[0] == plain_b[0] and len(plain_b) > len(plain_a):
            rest = iter(plain_b)
            return 0.92 if all(c in rest for c in plain_a) else 0.0
        if kind != "person" and a not in self.weights and plain_a[0] == plain_b[0] and 2 <= len(plain_a) < 0.75 * len(plain_b):
            rest = iter(plain_b)
            if all(c in rest for c in plain_a):
                return 0.91
        if a not in self.weights and min(len(plain_a), len(plain_b)) >= 3 and max(len(plain_a), len(plain_b)) >= 4 and one_slip(plain_a, plain_b):
            return 0.9
        return 0.0

    def _unlisted(self, mention: list[str]) -> str:
        """The first word of a name that no catalogue name has, if there is one longer than an initial."""
        return next((t for t in mention if t not in self.weights and len(bare(t)) > 2), "")

    def _latin(self, mention: list[str], name: list[str], kind: str) -> float:
        if len(mention) == 1 and mention[0].isupper():
            return 0.9 if mention[0] == "".join(t[0] for t in name).upper() else 0.0
        free, total, extra, slips = list(range(len(name))), 0.0, 0.0, 0
        found = [0.0] * len(name)
        for token in sorted(mention, key=lambda t: (len(bare(t)) == 1, mention.index(t))):
            best = max(((self._soft(token, name[k], kind), -abs(k - mention.index(token)), k) for k in free), default=(0.0, 0, 0))
            if best[0]:
                free.remove(best[2])
                found[best[2]] = best[0]
                slips += best[0] == 0.9
                total += self.weight(name[best[2]]) * best[0]
            else:
                extra += self.weight(token) if token in self.weights else self.most
        person = kind == "person"
        if person and extra and len(mention) == 2 and len(free) and found[-1] >= 0.98 and 0 in free and self._unlisted(mention) and len(name) > 1:
            # a familiar form that no list has, beside the surname
            alike = 0.7 if self._unlisted(mention)[0] == name[0][0] else 0.62
            total, extra, found[0] = total + alike * self.weight(name[0]), 0.0, alike
            free.remove(0)
        if person and (sum(map(bool, found)) < 2 or (slips > 1)):
            return 0.0
        if person and max(found[0] if len(found) == 3 and found[-1] == 0 else 0.0, found[-1]) < 0.86:
            return 0.0
        missing = sum(self.weight(name[k]) * (0.25 if person and 0 < k < len(name) - 1 else 1.0) for k in free)
        whole = sum(self.weight(name[k]) for k in range(len(name)) if k not in free)
        order = 0.01 * ([t for t in mention if t in name] != [t for t in name if t in mention])
        return total / (whole + missing + extra) - order


def q_grams(token: str) -> list[str]:
    """Distinct pairs of neighbouring characters of the token with both ends marked; in scripts
    without spaces the single characters too."""
    han = is_han(token)
    text = f"^{token if han else bare(token) or token}$"
    return sorted({text[k : k + 2] for k in range(len(text) - 1)} | (set(token) if han else set()))


_KEYS = "value string, entity_type string, key string, tokens array<string>"


def keyed(values: DataFrame, known: Hanzi = Hanzi({}, {})) -> DataFrame:  # noqa: B008
    """``value, entity_type, key, tokens`` of ``value, entity_type, look`` (the mapped value)."""
    schema = pa.schema([("value", pa.string()), ("entity_type", pa.string()), ("key", pa.string()), ("tokens", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [name_key(v or "", k, known) for v, k in zip(batch.column("look").to_pylist(), batch.column("entity_type").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("entity_type"), pa.array(keys, pa.string()), pa.array([k.split() for k in keys], pa.list_(pa.string()))], schema=schema)

    return values.select("value", "entity_type", "look").mapInArrow(run, _KEYS)


def _grams(tokens: DataFrame) -> DataFrame:
    """``token, gram, size`` of distinct tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array([q_grams(t) for t in batch.column("token").to_pylist()], pa.list_(pa.string()))], names=["token", "grams"])

    sets = tokens.mapInArrow(run, "token string, grams array<string>")
    return sets.select("token", F.size("grams").alias("size"), F.explode("grams").alias("gram"))


def similar_tokens(left: DataFrame, right: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """``token, other``: pairs of distinct tokens whose q-gram sets have at least this Jaccard
    similarity. Prefix filter: in the order of rarity, two such sets share a gram among the first
    ``size - ceil(threshold * size) + 1`` of each."""
    a, b = cut(_grams(left)), cut(_grams(right))
    rarity = b.groupBy("gram").agg(F.count("*").alias("df"))

    def prefixes(grams: DataFrame) -> DataFrame:
        ranked = grams.join(rarity, "gram", "left").withColumn(
            "rank", F.row_number().over(Window.partitionBy("token").orderBy(F.coalesce("df", F.lit(0)), "gram"))
        )
        return ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1)

    met = (
        prefixes(a).select("gram", "token", "size")
        .join(prefixes(b).select("gram", F.col("token").alias("other"), F.col("size").alias("other_size")), "gram")
        .where((F.col("size") * threshold <= F.col("other_size")) & (F.col("other_size") * threshold <= F.col("size")))
        .select("token", "other", "size", "other_size").distinct()
    )
    sets_a = a.groupBy("token").agg(F.collect_list("gram").alias("grams"))
    sets_b = b.groupBy(F.col("token").alias("other")).agg(F.collect_list("gram").alias("other_grams"))
    shared = F.size(F.array_intersect("grams", "other_grams"))
    return (
        met.join(sets_a, "token").join(sets_b, "other")
        .where(shared >= threshold * (F.col("size") + F.col("other_size") - shared))
        .select("token", "other")
    )


def catalogue_names(catalogue: DataFrame, readings: dict[str, str], known: Hanzi = Hanzi({}, {})) -> DataFrame:  # noqa: B008
    """``entity_id, entity_type, key, tokens, acronym, derived``: names, aliases and the forms that
    follow from them by rule (derived): the romanised name by the characters' readings, a body's
    name without its place, and with any place if none of its names has one."""
    first = F.substring("canonical_name", 1, 2).isin(sorted(set(_CITIES.values())))
    rows = catalogue.select(
        "entity_id", "entity_type", first.alias("placed"), F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("value")
    ).where("value IS NOT NULL").withColumn("look", mapped("value"))
    schema = pa.schema([("entity_id", pa.string()), ("entity_type", pa.string()), ("key", pa.string()), ("tokens", pa.list_(pa.string())), ("acronym", pa.string()), ("derived", pa.bool_())])
    cities = sorted(set(map(known.fold, _CITIES.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for entity, kind, value, placed in zip(*(batch.column(c).to_pylist() for c in ("entity_id", "entity_type", "look", "placed")), strict=True):
                key = name_key(value, kind, known)
                out.append((entity, kind, key, False))
                if kind == "person" and is_han(key):
                    if len(key) <= 4 and all(c in readings for c in key):
                        spoken = [readings[c] for c in key]
                        out += [(entity, kind, " ".join(spoken), True), (entity, kind, f"{spoken[0]} {''.join(spoken[1:])}", True)]
                elif is_han(key) and regex.match(r"\p{Han}", key):
                    if key[:2] in cities:
                        out.append((entity, kind, key[2:], True))
                    elif not placed:
                        out += [(entity, kind, city + key, True) for city in cities]
            acronyms = ["".join(t[0] for t in k.split()).upper() if kind != "person" and not is_han(k) else None for _, kind, k, _ in out]
            columns = [[r[c] for r in out] for c in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.string()) for c in columns[:3]], pa.array([k.split() for k in columns[2]], pa.list_(pa.string())), pa.array(acronyms, pa.string()), pa.array(columns[3], pa.bool_())],
                schema=schema,
            )

    out = "entity_id string, entity_type string, key string, tokens array<string>, acronym string, derived boolean"
    return rows.select("entity_id", "entity_type", "look", "placed").mapInArrow(run, out).distinct()


def link_names(values: DataFrame, catalogue: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``value, entity_type, entity_id``: each distinct typed name with the entity it means.

    ``values`` has ``value, entity_type``; a name is compared with entities of its own type. Names
    that are near no entity, or near two, have no row; null and empty names neither. An empty
    catalogue links nothing. The catalogue's tokens, readings and the list of familiar forms are
    sent to the workers: they are bounded by the reviewed catalogue, which is of fixed size.
    """
    distinct = cut(values.where("value IS NOT NULL AND value <> ''").select("value", "entity_type").distinct())
    written = distinct.select("value").unionByName(catalogue.select(F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("value")))
    # the alphabet of the names, which is that of Unicode at most
    alphabet = written.select(F.explode(F.regexp_extract_all("value", F.lit(r"(\p{IsHan})"), 1)).alias("c")).distinct().agg(F.array_join(F.array_sort(F.collect_list("c")), "")).first()[0]
    fixed = "".join([*_TITLES_HAN, *_AROUND_HAN, *_CITIES, *_CITIES.values()])
    known = hanzi(values.sparkSession, "".join(sorted({*(alphabet or ""), *fixed})))
    source = [(r.canonical_name, r.aliases or []) for r in catalogue.where("entity_type = 'person' AND canonical_name IS NOT NULL").select("canonical_name", "aliases").toLocalIterator()]
    readings = syllables(source, known)
    names = cut(catalogue_names(catalogue, readings, known))
    plain = names.where("NOT derived OR entity_type = 'person'")
    total = plain.count()
    kinds = F.explode(F.array_distinct(F.concat("tokens", F.split("key", ""))))
    counted = plain.select("key", kinds.alias("token")).distinct().groupBy("token").agg(F.count("*").alias("n"))
    weights = {r.token: math.log(1 + total / r.n) for r in counted.where("token <> ''").toLocalIterator()}
    familiar: dict[str, set[str]] = {}
    for row in nicknames.where("short_name IS NOT NULL AND full_name IS NOT NULL").toLocalIterator():
        familiar.setdefault(row.short_name.casefold(), set()).add(row.full_name.casefold())

    own = cut(keyed(distinct.withColumn("look", mapped("value")), known).where("key <> ''"))
    keys = own.select("entity_type", "key", "tokens").distinct()

    name_tokens = names.select("entity_type", F.col("key").alias("name"), F.explode(F.array_distinct("tokens")).alias("other")).distinct()
    weighed = name_tokens.join(F.broadcast(counted.select(F.col("token").alias("other"), F.log(1 + total / F.col("n")).alias("w"))), "other", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    whole = weighed.groupBy("entity_type", "name").agg(F.sum("w").alias("whole"))
    tokens = keys.select("entity_type", "key", F.explode(F.array_distinct("tokens")).alias("token"))
    long = F.char_length(F.regexp_replace("token", "[.']", "")) > 1
    alike = similar_tokens(tokens.where(long).select("token").distinct(), weighed.select(F.col("other").alias("token")).distinct())
    # a familiar form leads to the full names, however they are spelled
    spelled = nicknames.where("short_name IS NOT NULL AND full_name IS NOT NULL").select(F.lower("short_name").alias("token"), F.lower("full_name").alias("other"))
    near = cut(alike.unionByName(spelled).distinct())
    candidates = (
        tokens.join(near, "token").join(weighed, ["other", "entity_type"])
        .select("entity_type", "key", "name", "other", "w").distinct()
        .groupBy("entity_type", "key", "name").agg(F.sum("w").alias("met"))
        .join(whole, ["entity_type", "name"]).where(F.col("met") >= WEIGHT_SHARE * F.col("whole"))
        .select("entity_type", "key", "name")
    )
    acronyms = keys.join(names.where("acronym IS NOT NULL").select("entity_type", F.col("acronym").alias("key"), F.col("key").alias("name")), ["entity_type", "key"])
    pairs = candidates.unionByName(acronyms.select("entity_type", "key", "name")).distinct()
    schema = pa.schema([("entity_type", pa.string()), ("key", pa.string()), ("name", pa.string()), ("score", pa.float64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verifier = Verifier(weights, readings, familiar, known.readings)
        for batch in batches:
            scores = [verifier.score(m, n, k or "") for k, m, n in zip(*(batch.column(c).to_pylist() for c in ("entity_type", "key", "name")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], schema=schema)

    scored = pairs.mapInArrow(verify, "entity_type string, key string, name string, score double").where(F.col("score") >= ACCEPT - MARGIN - LEAD * (1 - ACCEPT))
    owners = names.select("entity_type", F.col("key").alias("name"), "entity_id").distinct()
    per_entity = scored.join(owners, ["entity_type", "name"]).groupBy("entity_type", "key", "entity_id").agg(F.max("score").alias("score"))
    ranked = per_entity.groupBy("entity_type", "key").agg(F.sort_array(F.collect_list(F.struct("score", "entity_id")), asc=False).alias("best"))
    sure = ranked.where(
        (F.col("best")[0]["score"] >= ACCEPT) & ((F.size("best") == 1) | (F.col("best")[0]["score"] - F.get("best", F.lit(1))["score"] >= MARGIN + LEAD * (1 - F.col("best")[0]["score"])))
    ).select("entity_type", "key", F.col("best")[0]["entity_id"].alias("entity_id"))
    return own.join(sure, ["entity_type", "key"]).select("value", "entity_type", "entity_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    mentions = current(load(spark, folder, "mention_queue"), "mention_id", "entity_type", "mention_text")
    catalogue = load(spark, folder, "authority_entity")
    linked = link_names(mentions.select(F.col("mention_text").alias("value"), "entity_type"), catalogue, load(spark, folder, "nickname"))
    exact = catalogue.select("entity_id", F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("value"))
    variants = linked.join(exact, ["entity_id", "value"], "left_anti")
    return mentions.join(variants.withColumnRenamed("value", "mention_text"), ["mention_text", "entity_type"]).select("mention_id", "entity_id")


QUERIES = {"p3_found": p3_found}
ORACLE: dict[str, str] = {}
