"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = own = tempfile.mkdtemp(prefix="terrachron-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return _own_dirs[context.applicationId]


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: a lost executor costs no recomputation, and plans stay small."""
    path = f"{shared_dir(df.sparkSession)}/tc-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """df settled, and how many of its rows meet a condition (all without one): counted while they are written, without another job."""
    seen = Observation()
    rows = settled(df.observe(seen, (F.count(F.lit(1)) if condition is None else F.count_if(condition)).alias("n")))
    found = seen.get.get("n")
    return rows, (rows if condition is None else rows.where(condition)).count() if found is None else found


def spread(df: DataFrame) -> DataFrame:
    """df as a side that is joined by sorted parts: a table that grows with the input isn't collected on the driver because its files are small."""
    return df.hint("merge")


#: Rows of a task that sorts them.
SORTED = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as its rows ask for, the session's shuffle partitions at least, so that what one sorts doesn't grow with the table."""
    return df.repartition(tasks_for(df.sparkSession, df.count(), SORTED), *keys)


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for so many rows: the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
