"""Names, search texts and fingerprints as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F


def search_text(text: Column) -> Column:
    """Lower-cased, white space of any script collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def compatible(text: Column) -> Column:
    """The compatibility form (NFKC) of a text, for which Spark has no function: one Arrow call for each batch."""
    return F.arrow_udf(_nfkc, "string")(text)


def place_query(text: Column) -> Column:
    """What a place is looked up by: the compatibility form as a search text."""
    return search_text(compatible(text))


def finds(text: Column, query: str) -> Column:
    """Whether a text holds a query; a blank query finds nothing."""
    q = " ".join(query.lower().split())
    return search_text(text).contains(q) if q else F.lit(False)


def starts(text: Column, query: str) -> Column:
    q = " ".join(query.lower().split())
    return search_text(text).startswith(q) if q else F.lit(False)


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns' JSON, null fields kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def resource_key(values: Column) -> Column:
    """The JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def common_name(names: Column, formal: Column) -> Column:
    """From a struct (ko, en, native array): ko, else en, else the first native; else the formal name."""
    return F.coalesce(names["ko"], names["en"], F.get(names["native"], F.lit(0)), formal)


def label_width(text: Column, narrow: float, wide: float) -> Column:
    """Characters beyond U+024F are wide."""
    n = F.length(F.regexp_replace(text, "[\\x{0000}-\\x{024F}]", ""))
    return n * wide + (F.length(text) - n) * narrow
