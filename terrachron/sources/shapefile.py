"""Shapefiles (.shp, .shx, .dbf) as a Spark data source: read by ranges of records, filtered by their stored boxes.

    spark.dataSource.register(Shapefile)
    spark.read.format("shapefile").option("box", "10,40,12,42").load("/shared/*.shp")

Rows are (file, record, w, s, e, n, parts) and the attributes of the .dbf file. With the option box (west, south, east, north) a shape's corners are
read only if its stored box meets that one. With the option pushdown (and spark.sql.python.filterPushdown.enabled) comparisons of the
box columns and of record with constants are pushed down as well; Spark 4.1 keeps what was pushed with the loaded DataFrame, so
load one for each query then. With a schema of fewer columns, what isn't in it isn't decoded, parts included. The files
must be on a path that every executor mounts; each partition reads its own stretch of them.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# Fixed values of the format: file code, version, and the shape types without heights.
CODE, VERSION, NULL_SHAPE, KINDS = 9994, 1000, 0, {1: "Point", 3: "PolyLine", 5: "Polygon", 8: "MultiPoint"}
BOX = ("w", "s", "e", "n")
PARTS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
ARROW_PARTS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
#: Records of a partition, and of a batch within it.
RANGE, BATCH = 50_000, 4_096

COMPARISONS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def _fields(dbf: str) -> tuple[int, int, int, list[tuple[str, str, int, int, int]]]:
    """Of a .dbf file: records, where they begin, their length, and the fields (name, type, offset, width, decimals)."""
    with open(dbf, "rb") as f:
        head = f.read(32)
        count, begin, size = struct.unpack("<IHH", head[4:12])
        table = f.read(begin - 32)
    fields, at = [], 1
    for i in range(0, len(table) - 31, 32):
        if table[i] == 0x0D:
            break
        name, kind, width, decimals = table[i : i + 11].split(b"\0")[0].decode("ascii"), chr(table[i + 11]), table[i + 16], table[i + 17]
        fields.append((name, kind, at, width, decimals))
        at += width
    if at != size:
        raise ValueError(f"{dbf}: fields don't fill a record")
    return count, begin, size, fields


def _type(kind: str, width: int, decimals: int) -> T.DataType:
    if kind == "N":
        return T.LongType() if not decimals and width <= 18 else T.DoubleType()
    return {"F": T.DoubleType(), "L": T.BooleanType()}.get(kind, T.StringType())


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _files(self) -> list[str]:
        found = sorted(glob.glob(self.options["path"]))
        if not found:
            raise FileNotFoundError(self.options["path"])
        return found

    def schema(self) -> T.StructType:
        """The attributes are those of the first file."""
        found = T.StructType([T.StructField("file", T.StringType()), T.StructField("record", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in BOX), T.StructField("parts", PARTS)])
        for name, kind, _, width, decimals in _fields(self._files()[0][:-4] + ".dbf")[3]:
            found = found.add(name, _type(kind, width, decimals))
        return found

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = _PushReader if self.options.get("pushdown", "false").lower() == "true" else _Reader
        found = kind(self._files(), schema, int(self.options.get("range", RANGE)), self.options.get("encoding", "utf-8"))
        if "box" in self.options:
            west, south, east, north = map(float, self.options["box"].split(","))
            found.tests = [("w", LessThanOrEqual, east), ("s", LessThanOrEqual, north), ("e", GreaterThanOrEqual, west), ("n", GreaterThanOrEqual, south)]
        return found

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, self.options.get("kind", "Polygon"))


class _Range(InputPartition):
    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], schema: T.StructType, size: int, encoding: str):
        self.files, self.schema, self.size, self.encoding = files, schema, size, encoding
        self.tests: list[tuple[str, type, float]] = []

    def partitions(self) -> list[InputPartition]:
        """Ranges of records; those that a test on record rules out aren't read at all."""
        out = []
        for file in self.files:
            count = (os.path.getsize(file[:-4] + ".shx") - 100) // 8
            for first in range(0, count, self.size):
                last = min(count, first + self.size)
                ends = np.array([first, last - 1])
                if all(COMPARISONS[kind](ends, value).any() or (kind is EqualTo and first <= value < last) for column, kind, value in self.tests if column == "record"):
                    out.append(_Range(file, first, last))
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        base = partition.file[:-4]
        with open(partition.file, "rb") as shp, open(base + ".shx", "rb") as shx, open(base + ".dbf", "rb") as dbf:
            kind = _header(shp.read(100), partition.file)
            _, begin, size, fields = _fields(base + ".dbf")
            for first in range(partition.first, partition.last, BATCH):
                last = min(partition.last, first + BATCH)
                shx.seek(100 + 8 * first)
                index = np.frombuffer(shx.read(8 * (last - first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
                dbf.seek(begin + size * first)
                records = np.frombuffer(dbf.read(size * (last - first)), np.uint8).reshape(-1, size)
                yield self._batch(partition.file, first, kind, index, shp, records, fields)

    def _batch(self, file: str, first: int, kind: int, index: np.ndarray, shp, records: np.ndarray, fields: list) -> pa.RecordBatch:
        start, end = int(index[:, 0].min()), int((index[:, 0] + 8 + index[:, 1]).max())
        shp.seek(start)
        data = np.frombuffer(shp.read(end - start), np.uint8)
        at = index[:, 0] - start + 8  # behind a record's own header
        number = _numbers(data, at - 8, ">i4")
        if (number != first + 1 + np.arange(len(at))).any():
            raise ValueError(f"{file}: records out of order")
        kinds = _numbers(data, at, "<i4")
        real = kinds != NULL_SHAPE
        if (kinds[real] != kind).any():
            raise ValueError(f"{file}: mixed shapes")
        box = np.full((len(at), 4), np.nan)
        for i in range(4):
            box[real, i] = _numbers(data, at[real] + 4 + 8 * (i % 2 if kind == 1 else i), "<f8")
        keep = records[:, 0] != 0x2A  # deleted
        known = dict(zip(BOX, box.T, strict=True)) | {"record": first + np.arange(len(at))}
        for column, test, value in self.tests:
            keep &= COMPARISONS[test](known[column], value) & (real if column in BOX else True)
        rows = np.flatnonzero(keep)
        columns = []
        for f in self.schema.fields:
            if f.name == "file":
                columns.append(pa.array([file] * len(rows), pa.string()))
            elif f.name == "record":
                columns.append(pa.array(known["record"][rows], pa.int64()))
            elif f.name in BOX:
                columns.append(pa.array(known[f.name][rows], pa.float64(), mask=~real[rows]))
            elif f.name == "parts":
                columns.append(_parts(data, at[rows], real[rows], kind, index[rows, 1]))
            else:
                _, code, offset, width, _ = next(x for x in fields if x[0] == f.name)
                columns.append(_attribute(records[rows, offset : offset + width], code, f.dataType, self.encoding))
        return pa.RecordBatch.from_arrays(columns, names=self.schema.names)


class _PushReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in COMPARISONS and column in (*BOX, "record") and isinstance(f.value, int | float):
                self.tests.append((column, type(f), f.value))
            else:
                yield f


def _header(head: bytes, file: str) -> int:
    kind = struct.unpack("<i", head[32:36])[0]
    if struct.unpack(">i", head[:4])[0] != CODE or struct.unpack("<i", head[28:32])[0] != VERSION or kind not in KINDS:
        raise ValueError(f"{file}: not a shapefile of plane shapes")
    return kind


def _numbers(data: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    """The number at each place, wherever it is aligned."""
    size = np.dtype(kind).itemsize
    return data[at[:, None] + np.arange(size)].view(kind)[:, 0].astype(kind[1:].replace("i4", "i8"))


def _parts(data: np.ndarray, at: np.ndarray, real: np.ndarray, kind: int, sizes: np.ndarray) -> pa.Array:
    """The corners of shapes as lists of parts; a null shape is null."""
    where = at[real]
    if kind == 1:
        parts = points = np.ones(len(where), np.int64)
        begins, origin = np.zeros(len(where), np.int64), where + 4
    elif kind == 8:
        points = _numbers(data, where + 36, "<i4")
        parts, begins, origin = np.ones(len(where), np.int64), np.zeros(len(where), np.int64), where + 40
    else:
        parts, points = _numbers(data, where + 36, "<i4"), _numbers(data, where + 40, "<i4")
        if (44 + 4 * parts + 16 * points != sizes[real]).any() or (parts < 1).any():
            raise ValueError("a shape's size isn't that of its parts")
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begins, origin = _numbers(data, np.repeat(where + 44, parts) + 4 * within, "<i4"), where + 44 + 4 * parts
    shape = np.repeat(np.arange(len(where)), parts)
    before = np.cumsum(points) - points
    starts = before[shape] + begins  # of each part among all corners
    total = int(points.sum())
    corner = np.arange(total) - np.repeat(before, points)
    place = np.repeat(origin, points) + 16 * corner
    xy = pa.StructArray.from_arrays([pa.array(_numbers(data, place + 8 * i, "<f8")) for i in (0, 1)], ["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(np.r_[starts, total].astype(np.int32)), xy)
    counts = np.zeros(len(at), np.int64)
    counts[real] = parts
    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, rings, mask=pa.array(~real))


def _attribute(cells: np.ndarray, code: str, kind: T.DataType, encoding: str) -> pa.Array:
    """One attribute of all records: fixed-width text, cut and converted as a column; blank is null."""
    width = cells.shape[1]
    if not len(cells):
        return pa.array([], {T.BooleanType: pa.bool_(), T.LongType: pa.int64(), T.DoubleType: pa.float64()}.get(type(kind), pa.string()))
    text = np.ascontiguousarray(cells).view(f"S{width}")[:, 0] if width else np.array([b""] * len(cells))
    text = np.char.strip(text, b" \0")
    blank = text == b""
    if isinstance(kind, T.BooleanType):
        unknown = blank | (text == b"?")
        return pa.array(np.isin(text, [b"T", b"t", b"Y", b"y"]), pa.bool_(), mask=unknown)
    if isinstance(kind, T.StringType):
        return pa.array(np.char.decode(text, encoding, "replace").astype(object), pa.string(), mask=blank)
    unset = blank | (np.char.replace(text, b"*", b"") == b"")  # stars fill a number that doesn't fit
    values = np.where(unset, b"0", text)
    return pa.array(values.astype(np.int64) if isinstance(kind, T.LongType) else values.astype(np.float64), pa.int64() if isinstance(kind, T.LongType) else pa.float64(), mask=unset)


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class _Writer(DataSourceWriter):
    """One shapefile for each task, under its own name; it appears under its final name once all tasks are done."""

    def __init__(self, folder: str, schema: T.StructType, kind: str):
        self.folder, self.schema, self.code = folder, schema, {v: k for k, v in KINDS.items()}[kind]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        name = f"{self.folder}/{uuid.uuid4().hex}"
        fields = [(f.name, *_column(f.dataType)) for f in self.schema.fields if f.name not in ("file", "record", *BOX, "parts")]
        with open(f"{name}.shp.part", "wb") as shp, open(f"{name}.shx.part", "wb") as shx, open(f"{name}.dbf.part", "wb") as dbf:
            for f in (shp, shx):
                f.write(bytes(100))
            dbf.write(bytes(33 + 32 * len(fields)))
            whole, at, count = [np.inf, np.inf, -np.inf, -np.inf], 50, 0
            for row in rows:
                body, box = _encode(self.code, row["parts"])
                if box:
                    whole = [*map(min, whole[:2], box[:2]), *map(max, whole[2:], box[2:])]
                count += 1
                shp.write(struct.pack(">2i", count, len(body) // 2) + body)
                shx.write(struct.pack(">2i", at, len(body) // 2))
                at += 4 + len(body) // 2
                dbf.write(b" " + b"".join(_cell(row[n], code, width) for n, code, width, _ in fields))
            dbf.write(b"\x1a")
            box = [0.0 if not np.isfinite(x) else x for x in whole]
            for f, words in ((shp, at), (shx, 50 + 4 * count)):
                f.seek(0)
                f.write(struct.pack(">7i", CODE, 0, 0, 0, 0, 0, words) + struct.pack("<2i", VERSION, self.code) + struct.pack("<4d", *box))
            dbf.seek(0)
            dbf.write(struct.pack("<4BIHH20x", 3, 100, 1, 1, count, 33 + 32 * len(fields), 1 + sum(w for _, _, w, _ in fields)))
            for n, code, width, decimals in fields:
                dbf.write(struct.pack("<11sc4xBB14x", n.encode("ascii")[:10], code.encode(), width, decimals))
            dbf.write(b"\r")
        return _Written(name)

    def commit(self, messages: list) -> None:
        for m in filter(None, messages):
            for end in ("dbf", "shx", "shp"):
                os.replace(f"{m.name}.{end}.part", f"{m.name}.{end}")

    def abort(self, messages: list) -> None:
        for m in filter(None, messages):
            for end in ("dbf", "shx", "shp"):
                os.remove(f"{m.name}.{end}.part")


def _column(kind: T.DataType) -> tuple[str, int, int]:
    if isinstance(kind, T.BooleanType):
        return "L", 1, 0
    if isinstance(kind, T.IntegralType):
        return "N", 18, 0
    return ("F", 24, 12) if isinstance(kind, T.FractionalType) else ("C", 120, 0)


def _cell(value, code: str, width: int) -> bytes:
    if value is None:
        return b"?" if code == "L" else b" " * width
    if code == "L":
        return b"T" if value else b"F"
    if code == "C":
        data = value.encode()[:width]
        return data.decode("utf-8", "ignore").encode().ljust(width)
    return (f"{value:d}" if code == "N" else f"{value:.15e}").encode().rjust(width)


def _encode(code: int, parts) -> tuple[bytes, list[float] | None]:
    """A record's content, and its box; no corners make a null shape."""
    xy = [(p["x"], p["y"]) for part in parts or () for p in part]
    if not xy:
        return struct.pack("<i", NULL_SHAPE), None
    xs, ys = zip(*xy, strict=True)
    box = [min(xs), min(ys), max(xs), max(ys)]
    corners = np.array(xy, "<f8").tobytes()
    if code == 1:
        return struct.pack("<i", code) + corners[:16], [*xy[0], *xy[0]]
    if code == 8:
        return struct.pack("<i4di", code, *box, len(xy)) + corners, box
    begins = np.cumsum([0, *(len(p) for p in parts[:-1])]).astype("<i4")
    return struct.pack("<i4d2i", code, *box, len(parts), len(xy)) + begins.tobytes() + corners, box
