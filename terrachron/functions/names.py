"""Rules for names: signals of small places, hydronyms, multilingual names, provenance of sources."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that mark a part of a town, endings of small administrative units, endings of names of waters.
PART_WORDS = "neighbou?rhood|borough|suburb|district|ward|arrondissement|quarter|campus|airport|station|hospital|university|industrial zone"
MICRO_ENDINGS = r"[-\s](?:gu|eup|myeon|dong|ri)|[구읍면동리]"
KOREAN_ENDINGS = "호수|강|천|호"
ENGLISH_ENDINGS = "river|stream|creek|lake|reservoir"
UNNAMED = "미명명"
RIVER_ENDINGS = ("강", "천", "수계")
LAKE_ENDINGS = ("호", "호수", "해", "만", "저수지")
SOURCE_KINDS = ("user", "builtin", "library", "gis", "legacy", "plugin", "unsupported")

BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def part_of_town(name: Column) -> Column:
    """Whether a name holds a word for a part of a town. Null for null."""
    return name.rlike(rf"(?iu)\b({PART_WORDS})\b")


def micro_unit(name: Column, country: Column) -> Column:
    """Whether a Korean name ends like a small administrative unit; false elsewhere."""
    return F.coalesce((country == "KR") & name.rlike(rf"(?iu)(?:{MICRO_ENDINGS})\z"), F.lit(False))


def squeezed(name: Column) -> Column:
    """Runs of white space as one space, none at either end."""
    return F.regexp_replace(F.regexp_replace(name, f"{BLANK}+", " "), r"\A +| +\z", "")


def stripped_hydronym(name: Column) -> Column:
    """A squeezed name with its Korean ending joined and written once, and without an English word for water."""
    joined = F.regexp_replace(name, rf"{BLANK}+({KOREAN_ENDINGS})\z", "$1")
    once = F.regexp_replace(joined, rf"({KOREAN_ENDINGS})\1\z", "$1")
    return F.when(once.rlike("[A-Za-z]"), squeezed(F.regexp_replace(once, rf"(?iu){BLANK}+(?:{ENGLISH_ENDINGS})\z", ""))).otherwise(once)


def finished_hydronym(name: Column, category: Column) -> Column:
    """Korean names without spaces and with an ending for their kind of water."""
    korean = name.rlike("[가-힣]")
    close = F.when(korean & ~name.startswith(UNNAMED), F.regexp_replace(name, f"{BLANK}+", "")).otherwise(name)
    ends = close.rlike(r"[가-힣]\z")
    without = lambda endings: ends & ~close.rlike(rf"(?:{'|'.join(endings)})\z")
    return F.when((category == "river") & without(RIVER_ENDINGS), F.concat(close, F.lit("강"))).when((category == "lake") & without(LAKE_ENDINGS), F.concat(close, F.lit("호"))).otherwise(close)


def _valid_name(row: Column, native: bool) -> Column:
    """Whether a JSON object is a name: a common or a formal form, distinct aliases, and a language tag if native."""
    fields = F.from_json(row, "map<string,string>")
    allowed = ["common", "formal", "aliases", *(["language"] if native else [])]
    filled = lambda key: ~F.map_contains_key(fields, key) | F.coalesce(F.trim(fields[key]) != "", F.lit(False))
    aliases = F.from_json(fields["aliases"], "array<string>")
    distinct = ~F.map_contains_key(fields, "aliases") | F.coalesce((F.size(F.array_distinct(aliases)) == F.size(aliases)) & F.forall(aliases, lambda a: F.coalesce(F.trim(a) != "", F.lit(False))), F.lit(False))
    named = F.map_contains_key(fields, "common") | F.map_contains_key(fields, "formal")
    tagged = fields["language"].rlike(r"\A[A-Za-z0-9-]+\z") if native else F.lit(True)
    known = F.forall(F.map_keys(fields), lambda k: k.isin(allowed))
    return F.coalesce(known & named & filled("common") & filled("formal") & distinct & tagged, F.lit(False))


def valid_names(names: Column) -> Column:
    """Whether a JSON text holds multilingual names: ko, en and a list of native ones with distinct languages. False for null."""
    fields = F.from_json(names, "map<string,string>")
    native = F.from_json(F.coalesce(fields["native"], F.lit("[]")), "array<string>")
    languages = F.transform(native, lambda n: F.get_json_object(n, "$.language"))
    known = F.forall(F.map_keys(fields), lambda k: k.isin("ko", "en", "native"))
    single = lambda key: ~F.map_contains_key(fields, key) | _valid_name(fields[key], False)
    some = F.map_contains_key(fields, "ko") | F.map_contains_key(fields, "en") | (F.size(native) > 0)
    natives = native.isNotNull() & F.forall(native, lambda n: _valid_name(n, True)) & (F.size(F.array_distinct(languages)) == F.size(languages))
    return F.coalesce(known & some & single("ko") & single("en") & natives, F.lit(False))


def source_kind(kind: Column, default: Column) -> Column:
    """The kind of a source: the given or else the default one; what isn't known is unsupported."""
    given = F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.trim(default))
    return F.when(given.isin(*SOURCE_KINDS), given).otherwise("unsupported")


def unmapped(fields: Column, known: list[str]) -> Column:
    """The fields of a map that a record has no place for."""
    return F.map_filter(fields, lambda k, _: ~k.isin(known))
