"""Gazetteer places: candidate policy, names at a date, urban lifetimes, display scores, near namesakes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.functions import temporal
from terrachron.functions.numeric import haversine_m
from terrachron.functions.text import search_text
from terrachron.operators.ranking import stage
from terrachron.operators.spatial import crowding, neighbours

#: Fixed values of the candidate policy and of the display model.
ADMIN_REASONS = {"PPLC": "capital", "PPLG": "capital", "PPLA": "admin-seat-1", "PPLA2": "admin-seat-2"}
POPULATION_MINIMUM, REVIEW_MINIMUM, MILLION = 50_000, 100_000, 1_000_000
NEIGHBOURHOOD_KM, DECAY_KM, PEER_FRACTION, ISOLATION_KM, ISOLATION_WEIGHT, CROWDING_WEIGHT = 200.0, 65.0, 0.25, 220.0, 0.62, 0.24
TIER_POPULATIONS = [1_000_000, 500_000, 200_000, 100_000, 50_000]
TIER_ZOOMS = [1.0, 1.4, 2.0, 3.0, 5.0]


def candidates(rows: DataFrame) -> DataFrame:
    """Rows (feature_class, feature_code, population) that are discovery candidates, with reason, bucket and display mode."""
    code, population = F.col("feature_code"), F.col("population")
    reason = F.when((code == "PPL") & (population >= POPULATION_MINIMUM), "population-50k")
    for k, v in ADMIN_REASONS.items():
        reason = F.when(code == k, v).otherwise(reason)
    bucket = F.when(population >= MILLION, "1m-plus").when(population >= REVIEW_MINIMUM, "100k-999k").when(population >= POPULATION_MINIMUM, "50k-99k").otherwise("under-50k-admin")
    mode = F.when(population >= REVIEW_MINIMUM, "auto-review").otherwise("search-only")
    found = rows.where("feature_class = 'P'").withColumn("inclusion_reason", reason).where("inclusion_reason is not null")
    return found.withColumns({"population_bucket": bucket, "display_mode": mode})


def name_at(timeline: Column, base: Column, language: str, date_key: int) -> Column:
    """The struct (name, evidenced): the last name of a language whose boundary has been reached, else the base name.

    timeline: array of structs (from_key, ko, en, native), in order; reading stops at the first later boundary.
    """
    later = F.transform(timeline, lambda t: t["from_key"] > date_key)
    end = F.coalesce(F.nullif(F.array_position(later, F.lit(True)), F.lit(0)) - 1, F.size(timeline).cast("long"))
    named = F.filter(F.slice(timeline, 1, F.greatest(end.cast("int"), F.lit(0))), lambda t: t[language].isNotNull())
    last = F.try_element_at(named, F.lit(-1))[language]
    return F.struct(F.coalesce(last, base).alias("name"), last.isNotNull().alias("evidenced"))


def selected_names(name: Column, name_en: Column, name_native: Column, extras: Column, timeline: Column) -> Column:
    """All names a place may be found by, first seen first, without blanks."""
    of_times = F.flatten(F.transform(timeline, lambda t: F.array(t["ko"], t["en"], t["native"])))
    every = F.concat(F.array(name, name_en, name_native), F.coalesce(extras, F.array()), F.coalesce(of_times, F.array()))
    return F.array_distinct(F.filter(every, lambda n: n.isNotNull() & (F.trim(n) != "")))


def labels_once(rows: DataFrame, key: str, name: str, position: str) -> DataFrame:
    """Of a place's labels that read alike the first."""
    same = rows.withColumn("_label", search_text(F.col(name)))
    first = same.groupBy(key, "_label").agg(F.min(position).alias(position))
    return same.join(first, [key, "_label", position], "left_semi").drop("_label")


def urban_at(places: DataFrame, evidence: DataFrame, date: Column) -> DataFrame:
    """Places (source_id) that are towns on a date: without evidence, with provisional evidence, or inside a half-open interval.

    evidence: (source_id, provisional, valid_from, until); a null side is open.
    """
    inside = (F.col("valid_from").isNull() | (F.col("valid_from") <= date)) & (F.col("until").isNull() | (F.col("until") > date))
    known = evidence.groupBy("source_id").agg(F.bool_or(F.coalesce("provisional", F.lit(False)) | inside).alias("_active"))
    return places.join(known, "source_id", "left").where(F.coalesce("_active", F.lit(True))).drop("_active")


def display_scores(places: DataFrame) -> DataFrame:
    """Places (id, lon, lat, population) with crowding, nearest peer, score, tier and least zoom.

    The nearest peer is looked for within NEIGHBOURHOOD_KM first. Beyond ISOLATION_KM a peer changes nothing, so the search
    ends there; a place without one is wholly isolated.
    """
    points = places.select("id", "lon", "lat", "population")
    crowded = crowding(points, "population", NEIGHBOURHOOD_KM, DECAY_KM).select("id", "crowding")
    near = neighbours(points, ISOLATION_KM).join(points.select("id", F.col("population").alias("_own")), "id").join(points.select(F.col("id").alias("other"), F.col("population").alias("_other")), "other")
    peer = near.where(F.col("_other") >= F.greatest(F.lit(float(POPULATION_MINIMUM)), F.col("_own") * PEER_FRACTION)).groupBy("id").agg(F.min("distance").alias("nearest_peer_km"))
    rows = places.join(crowded, "id").join(peer, "id", "left")
    isolation = ISOLATION_WEIGHT * F.least(F.lit(1.0), F.coalesce("nearest_peer_km", F.lit(ISOLATION_KM)) / ISOLATION_KM)
    score = F.log10(1 + F.col("population")) + isolation - CROWDING_WEIGHT * F.log2(1 + F.col("crowding"))
    rows = rows.withColumn("score", score).withColumn("tier", F.coalesce(stage(F.pow(F.lit(10.0), F.col("score")) - 1, TIER_POPULATIONS), F.lit(len(TIER_POPULATIONS))))
    return rows.withColumn("min_zoom", F.element_at(F.array(*map(F.lit, TIER_ZOOMS)), F.col("tier")))


def near_namesakes(places: DataFrame, metres: float = 1000.0) -> DataFrame:
    """Pairs (a_id, b_id, distance_m) of one country and normalised name no further apart than so many metres.

    The join is on country, name and a cell of about the distance's size, so one common name is spread over its places.
    """
    size = metres / 111_000.0 * 1.01
    rows = places.select("id", "country", search_text(F.col("name")).alias("name"), "lon", "lat").withColumn("cy", F.floor(F.col("lat") / size))
    a = rows.select(*(F.col(c).alias(f"a_{c}") for c in rows.columns)).withColumn("cy", F.explode(F.expr("array(a_cy - 1, a_cy, a_cy + 1)")))
    on = (F.col("a_country") == F.col("country")) & (F.col("a_name") == F.col("name")) & (a["cy"] == rows["cy"]) & (F.col("a_id") < F.col("id"))
    distance = haversine_m(F.col("a_lon"), F.col("a_lat"), F.col("lon"), F.col("lat"))
    return a.join(rows, on).withColumn("distance_m", distance).where(F.col("distance_m") <= metres).select("a_id", F.col("id").alias("b_id"), "distance_m")


def place_order() -> list[Column]:
    return [F.desc("priority"), F.desc("population"), F.asc("id")]


def valid_on(valid_from: Column, valid_to: Column, date: str) -> Column:
    """Whether a place's closed interval meets a calendar value."""
    i = temporal.interval(valid_from, valid_to)
    return F.coalesce(temporal.contains(i["lo"], i["hi"], temporal.constant_start(date), temporal.constant_end(date)), F.lit(False))
