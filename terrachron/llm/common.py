"""Shared helpers of the corpus operators: lineage cuts, text columns, Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table: A-Z to a-z, everything else as it is.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Arrow's buffers come from the system's allocator, which gives a batch's memory back when the batch goes.
pa.set_memory_pool(pa.system_memory_pool())

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session without one gets its own folder."""
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


def _write(df: DataFrame) -> str:
    path = f"{shared_dir(df.sparkSession)}/tc-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends at files that outlive any executor."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df))


def counted(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """df materialised, and how many of its rows meet a condition: counted while they are written, without another job."""
    seen = Observation()
    rows = materialise(df.observe(seen, F.count_if(condition).alias("n")))
    found = seen.get.get("n")
    return rows, rows.where(condition).count() if found is None else found


#: A written table of so many bytes may be broadcast. Hashes and ids hardly compress; in memory it is a few times that.
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df written out, and marked for broadcast if its files have `limit` bytes at most; beyond, it is joined like any other table."""
    spark = df.sparkSession
    path = _write(df)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    found = spark.read.schema(df.schema).parquet(path)
    return F.broadcast(found) if size <= limit else found.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch of texts: a few MB in the JVM and as much in the Python worker, instead of Spark's 10,000 rows.
BATCH_ROWS, BATCH_SETTING = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Sends texts to Python in short batches from now on in this session, unless it has a setting of its own."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words split at the bytes 20 and 09-0D (as UTF-8, so other letters stay whole)."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split()


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) over uint64 arrays."""
    h = h ^ np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def texts_in(batch: pa.RecordBatch, column: str, at_once: int = 1024):
    """The strings of a column as Python objects, a slice at a time: (first row, strings)."""
    values = batch.column(batch.schema.get_field_index(column))
    for start in range(0, len(values), at_once):
        yield start, values.slice(start, at_once).to_pylist()


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """docs with another text, and with its length in n_chars where they have that column and the text has changed."""
    same = F.col("text").eqNullSafe(text)
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return docs.withColumns(made)


def document_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """What a row belongs to, as two longs: its document and its text.

    A row without doc_id is a document by its text: equal texts without id are one document, below all usual ids. The
    second one parts the rows of one document, so what is gathered for a row is bounded by that row's own text.
    """
    by_text = F.xxhash64(text)
    own = F.lit(-(2**62)) - F.pmod(by_text, F.lit(2**62))
    return F.coalesce(doc_id.cast("long"), own), by_text
