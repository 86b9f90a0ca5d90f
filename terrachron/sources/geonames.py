"""Gazetteer rows: tab-separated text of 19 columns, no quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The columns of a gazetteer row, in order.
COLUMNS = (
    "geoname_id", "name", "ascii_name", "alternate_names", "latitude", "longitude", "feature_class", "feature_code", "country_code", "cc2",
    "admin1_code", "admin2_code", "admin3_code", "admin4_code", "population", "elevation", "dem", "timezone", "modification_date",
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows with `population_missing` and `issue` (null for a sound row). Text files split and gzip files are read whole."""
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).select("value", parts.alias("p"))
    sized = rows.select(F.size("p").alias("n"), *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(COLUMNS)))
    whole = lambda c: F.col(c).rlike(r"^-?\d+$")
    number = lambda c, kind: F.expr(f"try_cast({c} as {kind})")
    population = F.when(F.col("population") == "", 0).otherwise(number("population", "long"))
    lat, lon = number("latitude", "double"), number("longitude", "double")
    issue = (
        F.when(F.col("n") != len(COLUMNS), "expected 19 columns")
        .when(~whole("geoname_id") | ((F.col("population") != "") & ~whole("population")), "invalid numeric field")
        .when((number("geoname_id", "long") <= 0) | (F.col("name") == ""), "invalid ID or name")
        .when(lat.isNull() | F.isnan(lat) | (F.abs(lat) > 90), "invalid latitude")
        .when(lon.isNull() | F.isnan(lon) | (F.abs(lon) > 180), "invalid longitude")
        .when(population < 0, "negative population")
    )
    typed = {"geoname_id": number("geoname_id", "long"), "latitude": lat, "longitude": lon, "population": population}
    return sized.withColumn("issue", issue).withColumn("population_missing", F.col("population") == "").withColumns(typed).drop("n")


def sound(rows: DataFrame) -> DataFrame:
    return rows.where("issue is null").drop("issue")
