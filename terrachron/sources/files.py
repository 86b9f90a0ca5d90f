"""Sinks and checks for files: size-bounded parts, content hashes, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrachron.operators import ranges


def features(rows: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    """Rows as GeoJSON features: one JSON text each. geometry is a struct (type, coordinates)."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.col(geometry).alias("geometry"))
    return rows.select(*[c for c in rows.columns if c not in (geometry, *properties)], F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def parts(rows: DataFrame, key: str, text: str, most_bytes: int) -> DataFrame:
    """rows with `part`: by running size within each key, so a part has at most most_bytes plus its last row. A key may be of any size: it is dealt by ranges."""
    placed = ranges.running(rows, [key], [text], F.octet_length(text) + 1, "_at")
    return placed.withColumn("part", F.floor(F.col("_at") / most_bytes).cast("int")).drop("_at")


def write_parts(rows: DataFrame, key: str, text: str, path: str, most_bytes: int = 512 * 1024) -> None:
    """One text file for each key and part, under key=/part= folders."""
    parts(rows, key, text, most_bytes).select(key, "part", F.col(text).alias("value")).repartition(key, "part").sortWithinPartitions("value").write.partitionBy(key, "part").text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and sha256 of the files that a path matches."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_issues(declared: DataFrame, found: DataFrame) -> DataFrame:
    """name and issue (missing, unexpected, size, content) where a declared manifest and the files differ."""
    d, f = declared.alias("d"), found.alias("f")
    both = d.join(f, "name", "full_outer")
    issue = (
        F.when(F.col("f.sha256").isNull(), "missing").when(F.col("d.sha256").isNull(), "unexpected")
        .when(F.col("d.bytes") != F.col("f.bytes"), "size").when(F.col("d.sha256") != F.col("f.sha256"), "content")
    )
    return both.select("name", issue.alias("issue")).where("issue is not null")


def reassembled(chunks: DataFrame) -> DataFrame:
    """Chunks (name, position, content) joined in order: name, content, sha256. A name's content is one value, so bounded by what a row may hold."""
    ordered = chunks.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("c"))
    joined = ordered.select("name", F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["content"])).alias("content"))
    return joined.withColumn("sha256", F.sha2("content", 256))
