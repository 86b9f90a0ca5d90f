"""Vector bin packing of documents into shards: bytes, words and rows are balanced jointly.

Items are groups of equal texts, placed from the largest, each where the dot product of its vector with the shard's
residual capacity is highest. A group with more than `alone` of one shard's share of any dimension is placed first, on
the driver (there are shards / alone of these for each dimension at most); one larger than a shard's share is split
into parts by a hash of doc_id. All other groups are dealt to tasks by their hash, some `task_groups` to each, and each
task places its own ones against its share of the capacity that is left. So every group is placed by its dot product,
and nothing that grows with the table meets in one place. A task fills its share evenly but for its smallest groups,
so the shards are even.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from terrachron.llm.common import materialise

DIMENSIONS = ("bytes", "words", "rows")


def place(vectors: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each item, and the capacity left. Items and capacities (shard x dimension) are shares of one whole."""
    residual = capacity.copy()
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-vectors.max(axis=1, initial=0), kind="stable"):
        out[i] = shard = int((residual @ vectors[i]).argmax())
        residual[shard] -= vectors[i]
    return out, residual


def _place(shares: np.ndarray):
    """Groups (g1, g2, bytes, words, rows) of one task to (g1, g2, shard); shares: each shard's share of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        g1, g2, *sizes = (table.column(i).to_numpy() for i in range(5))
        order = np.lexsort((g2, g1))  # as a task that is run again may get its rows in another order
        vectors = np.stack(sizes, axis=1)[order].astype(float)
        vectors /= np.maximum(1, vectors.sum(axis=0))
        # Shards are counted from another one in each task, so that ties don't always fall to the first.
        turn = int(g1[order[0]] % len(shares))
        found = (place(vectors, np.roll(shares, -turn, axis=0))[0] + turn) % len(shares)
        yield pa.RecordBatch.from_arrays([pa.array(g1[order]), pa.array(g2[order]), pa.array(found, pa.int32())], names=["g1", "g2", "shard"])

    return run


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def assign_shards(docs: DataFrame, shards: int = 24, alone: float = 1 / 64, task_groups: int = 100_000, slot_rows: int = 20_000) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`. Equal texts share a shard unless their group is larger than a shard's share. A null text is
    a group of its own kind with 8 bytes and crc 0; repeated rows are further members of their group; a null doc_id
    stays null; an empty table gives no rows; other columns are ignored. `slot` counts a shard's rows from 0 in no
    meaningful order.
    """
    text = F.col("text")
    base = docs.select(
        "doc_id", _size(text).alias("bytes"), F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("crc"),
        F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("words"),
        F.lit(1).cast("long").alias("rows"), F.xxhash64(text, F.lit(0)).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    base = materialise(base)
    sums = [F.sum(c).alias(c) for c in DIMENSIONS]
    groups = materialise(base.groupBy("g1", "g2").agg(*sums))
    total = groups.agg(*sums, F.count("*").alias("groups")).first()
    if not total["rows"]:
        return _slots(base.withColumn("shard", F.lit(0)), 1)
    share = F.greatest(*(F.col(c) * float(shards) / max(1, total[c]) for c in DIMENSIONS))
    # At most shards / alone groups in each dimension can be this large: a bounded table, so it may be broadcast.
    large = F.broadcast(groups.where(share > alone).select("g1", "g2", F.when(share > 1, F.ceil(share * 4)).otherwise(1).cast("long").alias("parts")))
    big = base.join(large, ["g1", "g2"]).withColumn("item", F.concat_ws(":", "g1", "g2", F.pmod("salt", "parts")))
    items = big.groupBy("item").agg(*sums).orderBy("item").collect()  # bounded: see the module's text
    vectors = np.array([[r[c] / max(1, total[c]) for c in DIMENSIONS] for r in items], float).reshape(-1, len(DIMENSIONS))
    placed, left = place(vectors, np.full((shards, len(DIMENSIONS)), 1.0 / shards))
    shard_of = docs.sparkSession.createDataFrame([(r["item"], int(s)) for r, s in zip(items, placed)], "item string, shard int")
    left = np.maximum(left, 0)
    left /= np.maximum(left.sum(axis=0), 1e-300)
    small = groups.join(large, ["g1", "g2"], "left_anti").repartition(-(-total["groups"] // task_groups), "g1", "g2")
    found = materialise(small.select("g1", "g2", *DIMENSIONS).mapInArrow(_place(left), "g1 long, g2 long, shard int"))
    rest = base.join(large, ["g1", "g2"], "left_anti").join(found, ["g1", "g2"])
    members = big.join(F.broadcast(shard_of), "item").select(*base.columns, "shard").unionByName(rest.select(*base.columns, "shard"))
    return _slots(members, -(-total["rows"] // (shards * slot_rows)))


def _slots(members: DataFrame, parts: int) -> DataFrame:
    """Counts each shard's rows from 0: within (shard, part), after the rows of the parts before."""
    rows = members.select("doc_id", "bytes", "crc", "shard", "salt", F.pmod(F.xxhash64("salt"), F.lit(parts)).alias("part"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place_in = F.row_number().over(Window.partitionBy("shard", "part").orderBy("salt"))
    numbered = rows.withColumn("within", place_in).join(counts, ["shard", "part"])
    return numbered.select(
        "doc_id", F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
