"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

A document's signature is 8 chunks of 5 positions of 12 bits, one for each hash function. Two signatures within 15
differing positions have, by the pigeonhole principle, a chunk with one differing position at most. So each chunk
is indexed five times, each time without one position (the enumerated error): documents within 15 always share a
key. Documents of similarity 0.8 differ in 8 positions on average and share no key with probability 2e-5 (0.9: 1e-9).

Documents that share a key get a sketch of 512 further positions of 4 bits; pairs whose sketches differ in more than
`sketch_distance` positions (4.5 standard deviations beyond what similarity 0.8 gives) are dropped, the others are
confirmed on their full shingle sets. Equal sets are contracted before all that, and a key shared by many
documents is not expanded into pairs (see buckets.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from terrachron.llm.buckets import linked_components
from terrachron.llm.common import materialise, mix, small_side, texts_in, words_of

CHUNKS, WIDTH, BITS = 8, 5, 12
POSITIONS = CHUNKS * WIDTH
SKETCH, SKETCH_LANES = 512, 32
_seeds = mix(np.arange(1, 2 * (POSITIONS + SKETCH) + 1, dtype=np.uint64))
XORS, FACTORS = _seeds[: POSITIONS + SKETCH], _seeds[POSITIONS + SKETCH :] | np.uint64(1)
#: A chunk's positions side by side in one long; a sketch's in 16 fields of each long.
CHUNK_SHIFTS = np.arange(WIDTH, dtype=np.uint64) * np.uint64(BITS)
SKETCH_SHIFTS = np.arange(16, dtype=np.uint64) * np.uint64(4)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence where there are fewer words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(mix(out, len(h) if len(h) < k else 0))


def least_values(shingles: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The least value of each of the hash functions start to stop over a set, mixed."""
    low = np.full(stop - start, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[None, at : at + 2048] ^ XORS[start:stop, None]
        part *= FACTORS[start:stop, None]
        np.minimum(low, part.min(axis=1), out=low)
    return mix(low)


def signature(shingles: np.ndarray) -> np.ndarray:
    """A long for each chunk: 12 bits for each of its positions."""
    values = (least_values(shingles, 0, POSITIONS) >> np.uint64(64 - BITS)).reshape(CHUNKS, WIDTH)
    return (values << CHUNK_SHIFTS).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    values = (least_values(shingles, POSITIONS, POSITIONS + SKETCH) >> np.uint64(60)).reshape(SKETCH_LANES, 16)
    return (values << SKETCH_SHIFTS).sum(axis=1, dtype=np.uint64).view(np.int64)


def _lists(rows: list[np.ndarray], width: int) -> pa.ListArray:
    flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), flat)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, lanes = [], [], [], []
            for _, texts in texts_in(batch, "text"):
                for text in texts:
                    s = shingle_set(text, k)
                    n.append(len(s))
                    one.append(int(s.sum(dtype=np.uint64)))
                    two.append(int(np.bitwise_xor.reduce(mix(s, 7))) if len(s) else 0)
                    lanes.append(signature(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), _lists(lanes, CHUNKS)],
                names=["doc_id", "n", "s1", "s2", "sig"],
            )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of each signature: a chunk without one position. The key's low six bits number the two."""
    for batch in batches:
        ids = batch.column(0)
        lanes = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), CHUNKS)
        for c in range(CHUNKS):
            for e in range(WIDTH):
                without = lanes[:, c] & ~(np.uint64((1 << BITS) - 1) << CHUNK_SHIFTS[e])
                slot = c * WIDTH + e
                key = mix(without, slot + 1) & ~np.uint64(63) | np.uint64(slot)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids], names=["key", "id"])


def _differing(x: Column, y: Column, folds: tuple[int, ...], mask: int) -> Column:
    """In how many fields two longs differ: the lowest bit of each field gathers the field's bits."""
    d = x.bitwiseXOR(y)
    for step in folds:
        d = d.bitwiseOR(F.shiftrightunsigned(d, step))
    return F.bit_count(d.bitwiseAND(F.lit(mask)))


def _chunk_differs(x: Column, y: Column) -> Column:
    d = x.bitwiseXOR(y)
    for step in (6, 3):
        d = d.bitwiseOR(F.shiftrightunsigned(d, step))
    d = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2))
    return F.bit_count(d.bitwiseAND(F.lit(sum(1 << BITS * i for i in range(WIDTH)))))


def _first_key(key: str, a: str, b: str) -> Column:
    """Whether a key is the first that two signatures share: no chunk before has one differing position or none, and of a chunk with none it is the first key."""
    slot = F.col(key).bitwiseAND(F.lit(63))
    chunk = F.floor(slot / WIDTH)
    out = F.lit(False)
    for c in reversed(range(CHUNKS)):
        n = _chunk_differs(F.col(f"sig{a}")[c], F.col(f"sig{b}")[c])
        out = F.when(n <= 1, (chunk == c) & ((n == 1) | (slot == c * WIDTH))).otherwise(out)
    return out


def _compare(share: tuple[int, int]):
    """Rows (a, b, a's set, b's set) to the pairs (a, b) with share[1] * intersection >= share[0] * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(share[1] * both >= share[0] * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in texts_in(batch, "text"):
                sets = [shingle_set(t, k) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array([len(s) for s in sets], pa.int64()), _lists([signature(s) for s in sets], CHUNKS), _lists([sketch(s) for s in sets], SKETCH_LANES), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["id", "n", "sig", "sketch", "set"],
                )

    return run


def near_duplicates(docs: DataFrame, k: int = 5, share: tuple[int, int] = (80, 100), sketch_distance: int = 136) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if share[1] * |intersection| >= share[0] * |union| of their sets of k-word shingles (of the
    whole sequence where there are fewer words). A null or empty text has an empty set and no links. Rows with one
    doc_id are one node, with the links of all of them. A null doc_id has no links, a null component_id and is kept.
    An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialise(docs.mapInArrow(_describe(k), "doc_id long, n long, s1 long, s2 long, sig array<long>"))
    full = described.where("doc_id is not null and n > 0")
    sets = full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    copies = full.select("doc_id", "s1", "s2", "n").join(sets, ["s1", "s2", "n"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    copies = materialise(copies.distinct())
    # One row for each set; two sets of one doc_id stay two rows.
    reps = full.join(sets, ["s1", "s2", "n"]).where("doc_id = rep").dropDuplicates(["s1", "s2", "n"]).select("doc_id", "sig")
    keys = materialise(reps).mapInArrow(_keys, "key long, id long")
    candidates: list[DataFrame] = []

    def facts_of(ids: DataFrame) -> DataFrame:
        paired = docs.join(small_side(ids.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi").select("doc_id", "text")
        candidates.append(materialise(paired.mapInArrow(_sets(k), "id long, n long, sig array<long>, sketch array<long>, set binary")))
        return candidates[0].select("id", "n", "sig", "sketch")

    def near(a: str, b: str) -> Column:
        sizes = [F.col(f"n{a}"), F.col(f"n{b}")]
        # Lane by lane in a loop: written out, the generated code would be too large to compile.
        lanes = F.zip_with(f"sketch{a}", f"sketch{b}", lambda x, y: _differing(x, y, (2, 1), 0x1111111111111111))
        differing = F.aggregate(lanes, F.lit(0), lambda total, n: total + n)
        return (share[1] * F.least(*sizes) >= share[0] * F.greatest(*sizes)) & (differing <= sketch_distance)

    def confirm(pairs: DataFrame) -> DataFrame:
        x, y = (candidates[0].select(F.col("id").alias(s), F.col("set").alias(f"x{s}")) for s in "ab")
        return pairs.join(x, "a").join(y, "b").select("a", "b", "xa", "xb").mapInArrow(_compare(share), "a long, b long")

    found = linked_components(keys, facts_of, near, confirm, copies, _first_key)
    out = described.join(found, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs without the rows whose doc_id is not the least of its component; all columns stay.

    Rows with a null doc_id and rows without words stay, and so do all rows of a doc_id that stays. An empty table
    gives no rows.
    """
    gone = near_duplicates(docs, k, share).where(~F.col("kept")).select(F.col("doc_id").alias("_tc_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_tc_gone"), "left_anti")
