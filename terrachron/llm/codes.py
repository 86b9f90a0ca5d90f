"""Vector codes: sixteen codebook indices for each vector, found by partial-distance search in integers.

The codebooks hold 64 entries for each part, whatever the number of vectors, so they go to the driver and to every
task; vectors never do. A round adds up the parts of each entry within the tasks, and only those sums are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from terrachron.llm.common import materialise, small_side

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components are kept within this, so that no sum of squares leaves 64 bits; it stands for components of 65,536.
LARGEST = 1 << 24
#: Vectors whose distances are computed at once.
AT_ONCE = 4_096


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector isn't null and has no null or non-finite component."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & ~bad)


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.float64(SCALE) * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end: equal parts where `size` is a multiple, else as equal as may be."""
    return [(size * p // parts, size * (p + 1) // parts) for p in range(parts)]


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of least squared distance for each point, ties to the lower index, and that distance.

    Dimensions come in descending variance of the codebook. The entry nearest in the first one gives each point a complete distance;
    a mask drops every entry as soon as its sum so far is strictly greater, and complete sums take its place where they are less.
    """
    n = len(points)
    if not book.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    so_far = (points[:, order[0], None] - book[None, :, order[0]]) ** 2
    best = ((points - book[so_far.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(so_far <= best[:, None])
    so_far = so_far[row, entry]
    for i, d in enumerate(order[1:], 1):
        so_far = so_far + (points[row, d] - book[entry, d]) ** 2
        if i == len(order) // 2:  # halfway, the entry that leads is completed: few others stay below it
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            leads = np.flatnonzero(so_far == np.minimum.reduceat(so_far, starts)[row])
            best = np.minimum(best, ((points - book[entry[leads[np.searchsorted(row[leads], np.arange(n))]]]) ** 2).sum(axis=1))
        keep = so_far <= best[row]
        row, entry, so_far = row[keep], entry[keep], so_far[keep]
    least = np.minimum.reduceat(so_far, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]))
    ties = np.flatnonzero(so_far == least[row])
    return entry[ties[np.searchsorted(row[ties], np.arange(n))]], least


def _slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for start in range(0, batch.num_rows, AT_ONCE):
        rows = batch.slice(start, AT_ONCE)
        values = rows.column(rows.schema.get_field_index(column))
        yield rows, integers(values.flatten().to_numpy(zero_copy_only=False)).reshape(len(rows), size)


def _sums(kept: DataFrame, column: str, size: int, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, n, sums): of the vectors whose part is nearest to an entry, added up within each task."""
    cuts = bounds(size, len(books))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for _, whole in _slices(batch, column, size):
                for p, (lo, hi) in enumerate(cuts):
                    entry, _ = nearest(whole[:, lo:hi], books[p])
                    n[p] += np.bincount(entry, minlength=len(n[p]))
                    for d in range(hi - lo):
                        np.add.at(sums[p][:, d], entry, whole[:, lo + d])
        used = [(p, e) for p in range(len(books)) for e in np.flatnonzero(n[p])]
        columns = [[p for p, _ in used], [int(e) for _, e in used], [int(n[p][e]) for p, e in used], [sums[p][e].tolist() for p, e in used]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["part", "entry", "n", "sums"])

    return kept.select(column).mapInArrow(add_up, "part int, entry int, n long, sums array<long>")


def fit_codebooks(kept: DataFrame, column: str, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook for each part: the first rows by vec_id (ties by vector, a null id last), moved to the floor of their vectors' means in each round."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), column).select(column).limit(entries).collect()
    seeds = integers(np.array([r[0] for r in first], np.float64).reshape(len(first), size))
    books = [seeds[:, lo:hi].copy() for lo, hi in bounds(size, parts)]
    widest = max(b.shape[1] for b in books)
    for _ in range(rounds):
        found = _sums(kept, column, size, books).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(widest)))
        for r in found.collect():  # entries times components, whatever the number of vectors
            book = books[r.part]
            book[r.entry] = [r[f"s{d}"] // r.n for d in range(book.shape[1])]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each whole vector of vectors (vec_id, label, `column`).

    Vectors that are null or hold null or non-finite components are left out, and so are those of another than the commonest
    length (ties: the longer one). Components beyond 65,536 count as that. Repeated rows and ids are coded each for itself. With fewer
    rows than entries the codebooks are shorter. label_error adds up the errors of equal labels, nulls together. An empty table gives an empty result.
    """
    kept = whole_vectors(vectors.select("vec_id", "label", column), column)
    common = kept.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 0
    kept = kept.where(F.size(column) == size)
    books = fit_codebooks(kept, column, size, parts, entries, rounds)
    cuts = bounds(size, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, whole in _slices(batch, column, size):
                code, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
                for p, (lo, hi) in enumerate(cuts):
                    code[:, p], least = nearest(whole[:, lo:hi], books[p])
                    error += least
                digits = code.tobytes().hex()
                texts = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array(texts, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = materialise(kept.mapInArrow(encode, schema))
    labels = small_side(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    joined = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
