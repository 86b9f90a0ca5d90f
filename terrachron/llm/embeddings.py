"""Embedding near-duplicates: int8 tile products with rigorous error bounds, exact recomputation near the threshold.

Vectors of one label are scaled to length 1 and quantised to int8 with one scale each. For x = s*a + e and
y = t*b + f, where a and b hold integers and |e|, |f| are known exactly, |x.y - st*a.b| <= |e|*|y| + |f|*|s*a|. A tile is
about `tile` vectors, and a vector is sent to as many tasks as its label has tiles; the integer products of two tiles are one matrix product (exact in float32, as they stay below
2**24 for up to 1000 components). Only pairs whose product plus bound reaches the threshold are computed again in
double precision from the original components.

Equal vectors of a label are one node, so large groups of copies cost one row. A tile pair gives the number of
links of each of its vectors and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terrachron.llm.common import materialise
from terrachron.llm.components import connected_components


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, the error's length and the length of the scaled codes, of vectors of length 1. Bounds are rounded up."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    up = 1 + 1e-9
    return codes, scale, np.linalg.norm(unit - near, axis=1) * up + 1e-12, np.linalg.norm(near, axis=1) * up


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def links_between(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked rows of x and y; with `same`, each pair of one tile once. `rows` of x at a time, so a large tile needs little memory."""
    ux, uy = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    (a, s, e, n), (b, t, f, _) = quantise(ux), quantise(uy)
    exact = np.float64 if x.shape[1] > 1000 else np.float32
    a, b = a.astype(exact), b.astype(exact).T
    found = []
    for at in range(0, len(x), rows):
        part = slice(at, at + rows)
        products = (a[part] @ b).astype(np.float64)
        most = products * (s[part, None] * t[None, :]) + e[part, None] * (1 + 1e-9) + f[None, :] * n[part, None]
        i, j = np.nonzero(most >= threshold - 1e-9)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 65536):
            p, q = i[k : k + 65536], j[k : k + 65536]
            hit = _cosines(x[p], y[q]) >= threshold
            found.append((p[hit], q[hit]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(side) for side in zip((none, none), *found))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of links i-j among n nodes."""
    parent, out = list(range(n)), []

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in zip(i.tolist(), j.tolist()):
        p, q = root(a), root(b)
        if p != q:
            parent[q] = p
            out.append((a, b))
    return out


def _tile_pair(threshold: float):
    def run(key, rows):
        left, right = (int(k.as_py()) for k in key[-2:])
        tile = rows.column("t").to_numpy()
        ids, weight = rows.column("id").to_numpy(), rows.column("weight").to_numpy()
        flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        vectors = flat.reshape(len(ids), -1)
        at = [np.flatnonzero(tile == left), np.flatnonzero(tile == right)]
        node, count, a, b = [], [], [], []
        if len(at[0]) and len(at[1]):
            i, j = links_between(vectors[at[0]], vectors[at[1]], threshold, left == right)
            i, j = at[0][i], at[1][j]
            total = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
            some = np.flatnonzero(total)
            node, count = ids[some], total[some].astype(np.int64)
            pairs = forest(i, j, len(ids))
            a, b = [ids[p] for p, _ in pairs], [ids[q] for _, q in pairs]
        zeros = np.zeros(len(a), np.int64)
        nulls = [None] * len(node)
        return pa.table({
            "id": pa.array([*map(int, node), *map(int, a)], pa.int64()),
            "links": pa.array([*map(int, count), *zeros.tolist()], pa.int64()),
            "other": pa.array([*nulls, *map(int, b)], pa.int64()),
        })

    return run


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = 4096) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors with equal labels are linked if their cosine, in double precision, is at least `threshold`. No links: a
    null label, a vector that is null, empty or zero, or that has null, infinite or NaN components, vectors of another
    length, a null vec_id (its component_id is null and it is kept). Rows with one vec_id are one node; each
    counts as a link of what it is linked with. An empty table gives no rows; other columns are ignored.
    """
    # Single precision stays as it is on the way: half the bytes, and exact in double precision.
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"), "label")
    sound = rows.where("vec_id is not null and label is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vector, x -> x <> 0)")
    # -0.0 and 0.0 are one value.
    sound = sound.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(kind)))
    sound = sound.withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64("vector", F.lit(5), "label"))
    sound = materialise(sound)
    nodes = sound.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    nodes = materialise(nodes)
    # The tiles of a label: as many as its nodes need, dealt by a hash of the vector.
    tiles = nodes.groupBy("label", F.size("vector").alias("width")).agg(F.ceil(F.count("*") / tile).alias("tiles"))
    placed = nodes.join(tiles, (nodes["label"] == tiles["label"]) & (F.size("vector") == tiles["width"])).drop(tiles["label"])
    placed = placed.withColumn("t", F.pmod(F.xxhash64("h1", "h2"), "tiles"))
    every = placed.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    every = every.withColumn("lo", F.least("t", "u")).withColumn("hi", F.greatest("t", "u"))
    found = materialise(every.groupBy("label", "width", "lo", "hi").applyInArrow(_tile_pair(threshold), "id long, links long, other long"))
    copies = sound.join(nodes.select("label", "h1", "h2", "id", "weight"), ["label", "h1", "h2"]).select("vec_id", "id", "weight")
    copies = materialise(copies)
    edges = found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    component = connected_components(edges.union(copies.select(F.col("vec_id").alias("a"), F.col("id").alias("b"))))
    more = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    per_row = copies.join(more, "id", "left").select("vec_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    per_id = per_row.groupBy("vec_id").agg(F.max("n").cast("long").alias("n_links"))
    out = rows.select("vec_id").join(per_id, "vec_id", "left").join(component, F.col("vec_id") == F.col("node"), "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
