"""Packs of rivers and lakes: an index of tiles, and packs of features with zig-zag coded corners, decoded a whole batch at a time.

Numbers are read as columns: all varints of a batch at once, headers of all packs or geometries in step. What loops is the number of features
of a pack and of rings of a feature, never the values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the format: magic numbers, version, sizes of the records, units.
INDEX_MAGIC, PACK_MAGIC, FORMAT = 0x34495741, 0x46485741, 4
PACK_HEAD, FEATURE_HEAD = 12, 44
MICRO, MILLI = 1e6, 1e3
FEATURE = np.dtype([("fid", "<u4"), ("logical_fid", "<u4"), ("kind", "u1"), ("stage", "u1"), ("geometry_kind", "u1"), ("flags", "u1"), ("fragment_index", "<u2"), ("fragment_count", "<u2"), ("stroke_width", "<f4"), ("w", "<i4"), ("s", "<i4"), ("e", "<i4"), ("n", "<i4"), ("geometry_length", "<u4"), ("width_length", "<u4")])

LINE = pa.struct([("polygon", pa.int32()), ("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("widths", pa.list_(pa.float64()))])
FEATURES = "pack long, fid long, logical_fid long, kind int, stage int, geometry_kind int, flags int, fragment_index int, fragment_count int, stroke_width float, w double, s double, e double, n double, lines array<struct<polygon:int,points:array<struct<x:double,y:double>>,widths:array<double>>>"


def varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All unsigned varints of bytes, and where each begins. The last byte must end one; one has five bytes at most."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 0x80)
    if not len(ends) or ends[-1] != len(data) - 1:
        raise ValueError("a number isn't complete")
    starts = np.r_[0, ends[:-1] + 1]
    sizes = ends - starts + 1
    if sizes.max() > 5:
        raise ValueError("a number is too long")
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    return np.add.reduceat((data & 0x7F).astype(np.int64) << (7 * place), starts), starts


def to_varints(values: np.ndarray) -> np.ndarray:
    """The bytes of unsigned numbers."""
    values = np.asarray(values, np.int64)
    sizes = 1 + (values[:, None] >= 1 << np.array([7, 14, 21, 28])).sum(axis=1)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return (np.repeat(values, sizes) >> (7 * place) & 0x7F | np.where(place < np.repeat(sizes, sizes) - 1, 0x80, 0)).astype(np.uint8)


def unzigzag(values: np.ndarray) -> np.ndarray:
    return values >> 1 ^ -(values & 1)


def zigzag(values: np.ndarray) -> np.ndarray:
    values = np.asarray(values, np.int64)
    return values << 1 ^ values >> 63


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all stretches, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _headers(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of packs in bytes: the heads of their features, which pack each belongs to, and where what follows it begins. All packs go one feature on at a time."""
    word = lambda at, kind: data[at[:, None] + np.arange(np.dtype(kind).itemsize)].view(kind)[:, 0]
    if (sizes < PACK_HEAD).any() or (word(begins, "<u4") != PACK_MAGIC).any() or (word(begins + 4, "<u2") != FORMAT).any():
        raise ValueError("not a pack")
    stage, count = word(begins + 6, "<u2"), word(begins + 8, "<u4").astype(np.int64)
    at, ends, open_ = begins + PACK_HEAD, begins + sizes, np.flatnonzero(count > 0)
    heads, packs, bodies, left = [], [], [], count.copy()
    while len(open_):
        if (at[open_] + FEATURE_HEAD > ends[open_]).any():
            raise ValueError("a pack ends within a feature")
        head = data[at[open_][:, None] + np.arange(FEATURE_HEAD)].view(FEATURE)[:, 0]
        heads.append(head)
        packs.append(open_)
        bodies.append(at[open_] + FEATURE_HEAD)
        at[open_] += FEATURE_HEAD + head["geometry_length"].astype(np.int64) + head["width_length"]
        left[open_] -= 1
        open_ = open_[left[open_] > 0]
    if (at != ends).any():
        raise ValueError("bytes behind the last feature")
    if not heads:
        return np.zeros(0, FEATURE), np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads, packs, bodies = np.concatenate(heads), np.concatenate(packs), np.concatenate(bodies)
    order = np.lexsort((bodies, packs))
    heads, packs, bodies = heads[order], packs[order], bodies[order]
    if (heads["stage"] != stage[packs]).any() or not np.isin(heads["kind"], (1, 2)).all() or (heads["fragment_index"] >= heads["fragment_count"]).any() or ((heads["kind"] == 1) != (heads["geometry_kind"] <= 2)).any() or not np.isin(heads["geometry_kind"], (1, 2, 3, 4)).all():
        raise ValueError("a feature's head is unsound")
    return heads, packs, bodies


def _lines(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, areas: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of geometries in values: their lines or rings, as (geometry, polygon, first value, corners). All geometries go one ring on at a time."""
    at = begins + 1
    parts = values[begins].copy()  # lines, or polygons, to come
    rings = np.where(areas, 0, parts)  # rings of the polygon at hand to come
    polygon = np.where(areas, -1, 0)
    left = np.where(areas, parts, 0)
    found = []
    open_ = np.flatnonzero(parts > 0)
    if len(open_) < len(begins):
        raise ValueError("a geometry without parts")
    while len(open_):
        new = open_[(rings[open_] == 0) & (left[open_] > 0)]
        if (at[open_] >= ends[open_]).any():
            raise ValueError("a geometry isn't complete")
        rings[new] = values[at[new]]
        if (rings[new] == 0).any():
            raise ValueError("a polygon without rings")
        at[new] += 1
        left[new] -= 1
        polygon[new] += 1
        n = values[np.minimum(at[open_], len(values) - 1)]
        found.append((open_, polygon[open_].copy(), at[open_] + 1, n))
        at[open_] += 1 + 2 * n
        rings[open_] -= 1
        if (at[open_] > ends[open_]).any():
            raise ValueError("a line has more corners than numbers")
        open_ = open_[(rings[open_] > 0) | (left[open_] > 0)]
    if (at != ends).any():
        raise ValueError("numbers behind a geometry")
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.lexsort((columns[2], columns[0]))
    return tuple(c[order] for c in columns)


def _running(deltas: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums from the start of each stretch."""
    total = np.cumsum(deltas)
    starts = np.cumsum(sizes) - sizes
    some = sizes > 0
    base = np.zeros(len(sizes), np.int64)
    base[some] = total[starts[some]] - deltas[starts[some]]
    return total - np.repeat(base, sizes)


def decoded(ids: np.ndarray, packs: pa.BinaryArray) -> pa.RecordBatch:
    """The features of packs, a row each, in the order of the packs."""
    data = np.frombuffer(b"".join(packs.to_pylist()), np.uint8)
    sizes = np.array([len(p) for p in packs.to_pylist()], np.int64)
    heads, of, bodies = _headers(data, np.cumsum(sizes) - sizes, sizes)
    lengths, wide = heads["geometry_length"].astype(np.int64), heads["width_length"].astype(np.int64)
    if (lengths == 0).any():
        raise ValueError("a feature without geometry")
    values, starts = varints(data[_stretches(bodies, lengths)])
    bytes_before = np.cumsum(lengths) - lengths
    begins = np.searchsorted(starts, bytes_before)
    ends = np.r_[begins[1:], len(values)] if len(begins) else begins
    if len(begins) and (starts[begins] != bytes_before).any():
        raise ValueError("a number runs over the end of a geometry")
    feature, polygon, first, n = _lines(values, begins, ends, heads["geometry_kind"] >= 3) if len(heads) else (np.zeros(0, np.int64),) * 4
    at = _stretches(first, 2 * n).reshape(-1, 2)
    xy = np.stack([_running(unzigzag(values[at[:, i]]), n) for i in (0, 1)], axis=1) if len(at) else np.zeros((0, 2), np.int64)
    # Widths: for each line its number of corners, the first width, and differences.
    has = wide[feature] > 0
    widths, where = varints(data[_stretches((bodies + lengths), wide)])
    lines_of = np.bincount(feature, minlength=len(heads))
    per_feature = np.where(wide > 0, 1 + lines_of + np.bincount(feature, n, len(heads)).astype(np.int64), 0)
    if per_feature.sum() != len(widths):
        raise ValueError("widths don't fit their corners")
    head_at = np.cumsum(per_feature) - per_feature
    run = np.cumsum(1 + n) - (1 + n)
    line_first = np.cumsum(lines_of) - lines_of
    before = run - run[line_first[feature]] if len(n) else run
    begin = head_at[feature] + 1 + before  # of each line's count
    if has.any() and ((widths[begin[has]] != n[has]).any() or (widths[head_at[feature[has]]] != lines_of[feature[has]]).any()):
        raise ValueError("widths don't fit their corners")
    rows = n * has
    raw = widths[_stretches(begin + 1, rows)]
    lead = np.zeros(len(raw), bool)
    lead[(np.cumsum(rows) - rows)[rows > 0]] = True
    width = _running(np.where(lead, raw, unzigzag(raw)), rows) / MILLI
    offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    points = pa.ListArray.from_arrays(offsets(n), pa.StructArray.from_arrays([pa.array(xy[:, i] / MICRO) for i in (0, 1)], ["x", "y"]))
    wlist = pa.ListArray.from_arrays(offsets(rows), pa.array(width), mask=pa.array(~has))
    lines = pa.ListArray.from_arrays(offsets(lines_of), pa.StructArray.from_arrays([pa.array(polygon, pa.int32()), points, wlist], ["polygon", "points", "widths"]))
    names = [c.split()[0] for c in FEATURES.split(", ")]
    whole = lambda c, kind: pa.array(heads[c].astype(np.int64), kind)
    columns = [pa.array(ids[of], pa.int64()), whole("fid", pa.int64()), whole("logical_fid", pa.int64()), *(whole(c, pa.int32()) for c in names[3:9]), pa.array(heads["stroke_width"], pa.float32()), *(pa.array(heads[c] / MICRO) for c in "wsen"), lines]
    return pa.RecordBatch.from_arrays(columns, names=names)


def features(packs: DataFrame) -> DataFrame:
    """The features of packs (pack, content). A pack that isn't sound fails the query, as a part of a map mustn't be missing unseen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield decoded(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), part.column(1))

    return packs.where("content is not null").select(F.col("pack").cast("long"), "content").mapInArrow(run, FEATURES)


def encode(rows: list[dict], stage: int) -> bytes:
    """A pack of features: dicts with the fields of a feature's head, and lines (polygon, points in millionths, widths in thousandths or None)."""
    out = [struct.pack("<IHHI", PACK_MAGIC, FORMAT, stage, len(rows))]
    for r in rows:
        lines, area = r["lines"], r["geometry_kind"] >= 3
        polygons = [p for p, _, _ in lines]
        numbers, seen = [[len(set(polygons)) if area else len(lines)]], -1
        for p, xy, _ in lines:
            if area and p != seen:
                numbers.append([polygons.count(p)])
                seen = p
            xy = np.asarray(xy, np.int64).reshape(-1, 2)
            numbers += [[len(xy)], zigzag(np.diff(xy, axis=0, prepend=[[0, 0]])).ravel()]
        geometry = to_varints(np.concatenate(numbers)).tobytes()
        widths = b""
        if any(w is not None for _, _, w in lines):
            numbers = [[len(lines)]]
            for _, _, w in lines:
                w = np.asarray(w, np.int64)
                numbers += [[len(w)], w[:1], zigzag(np.diff(w))]
            widths = to_varints(np.concatenate(numbers)).tobytes()
        head = np.zeros(1, FEATURE)
        for name in FEATURE.names[:-2]:
            head[name] = r[name]
        head["geometry_length"], head["width_length"] = len(geometry), len(widths)
        out += [head.tobytes(), geometry, widths]
    return b"".join(out)


INDEX = "stage int, x int, y int, logical long, pack long, shard int, offset long, length long"


def index_rows(files: DataFrame) -> DataFrame:
    """The rows of index files (content): tile rows (stage, x, y, pack), logical rows (logical, pack) and pack rows (pack, shard, offset, length, stage) in one table, told apart by what is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = list(zip(*_index(content), strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    return files.select("content").mapInArrow(run, INDEX)


def _index(content: bytes) -> list[list]:
    magic, version, spare, tiles, logicals, packs = struct.unpack_from("<IHHIII", content)
    if (magic, version, spare) != (INDEX_MAGIC, FORMAT, 0):
        raise ValueError("not an index")
    at, rows, specs = 20, [], set()
    for layout, count in (("<BHHH", tiles), ("<IH", logicals)):
        for _ in range(count):
            *key, n = struct.unpack_from(layout, content, at)
            at += struct.calcsize(layout)
            ids = np.frombuffer(content, "<u4", n, at).tolist()
            at += 4 * n
            if not n or (len(key) == 3 and key[0] >= 4):
                raise ValueError("an entry of the index is unsound")
            rows += [[*(key if len(key) == 3 else (None,) * 3), key[0] if len(key) == 1 else None, i, None, None, None] for i in ids]
    for _ in range(packs):
        pack, shard, offset, length, stage = struct.unpack_from("<IHIIB", content, at)
        at += 15
        if stage >= 4 or not length or pack in specs:
            raise ValueError("a pack of the index is unsound")
        specs.add(pack)
        rows.append([stage, None, None, None, pack, shard, offset, length])
    if at != len(content) or any(r[4] not in specs for r in rows):
        raise ValueError("the index isn't closed")
    return rows


def packs_at(index: DataFrame, shards: DataFrame, tiles: DataFrame) -> DataFrame:
    """(pack, content) of the packs that tiles (stage, x, y) need, cut out of shards (shard, content): each pack once, and no shard without one."""
    wanted = index.where("x is not null").join(tiles.select("stage", "x", "y").distinct(), ["stage", "x", "y"], "left_semi").select("pack").distinct()
    specs = index.where("shard is not null").join(wanted, "pack", "left_semi")
    return shards.join(specs.select("pack", "shard", "offset", "length"), "shard").select("pack", F.col("content").substr(F.col("offset").cast("int") + 1, F.col("length").cast("int")).alias("content"))
