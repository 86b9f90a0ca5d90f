"""Project tables of GeoPackage files (SQLite) as a Spark data source, and their geometry blobs.

    spark.dataSource.register(GeoPackage)
    spark.read.format("geopackage").option("table", "projectState").load("/shared/*.gpkg")

One partition for each file; rows come as (file, row_number, json). The files must be on a path that every executor mounts.
"""

from __future__ import annotations

import glob
import json
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coords", T.ArrayType(T.ArrayType(T.ArrayType(POINT))))])
#: Well-known-binary types, in order from 1.
TYPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")


class GeoPackage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return "file string, row_number long, json string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options["table"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        con = sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True)
        try:
            known = {r[0] for r in con.execute("select name from sqlite_master where type = 'table'")}
            if self.table not in known:
                raise ValueError(f"{partition.value} has no table {self.table}")
            quoted = '"' + self.table.replace('"', '""') + '"'
            rows = con.execute(f"select * from {quoted}")
            names = [c[0] for c in rows.description]
            for i, row in enumerate(rows):
                yield partition.value, i, json.dumps({k: v.hex() if isinstance(v, bytes) else v for k, v in zip(names, row)}, ensure_ascii=False)
        finally:
            con.close()


def decode(blob: bytes | None) -> tuple | None:
    """A geometry blob as (type, coords), coords being polygons of rings of points (lines and points nest likewise)."""
    if blob is None:
        return None
    if blob[:2] != b"GP" or blob[2] != 0:
        raise ValueError("not a geometry blob")
    flags = blob[3]
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[flags >> 1 & 7]
    if struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)[0] != 4326:
        raise ValueError("only longitude and latitude (4326)")
    at = 8 + envelope

    def take(fmt: str):
        nonlocal at
        out = struct.unpack_from(fmt, blob, at)
        at += struct.calcsize(fmt)
        return out

    def points(order: str) -> list[tuple[float, float]]:
        n = take(order + "I")[0]
        flat = take(f"{order}{2 * n}d")
        return list(zip(flat[::2], flat[1::2]))

    def one() -> tuple[str, list]:
        order = "<" if take("B")[0] else ">"
        kind = take(order + "I")[0]
        if not 1 <= kind <= 6:
            raise ValueError("unknown geometry type")
        name = TYPES[kind - 1]
        if kind == 1:
            return name, [[[take(order + "2d")]]]
        if kind == 2:
            return name, [[points(order)]]
        if kind == 3:
            return name, [[points(order) for _ in range(take(order + "I")[0])]]
        return name, [part for _ in range(take(order + "I")[0]) for part in one()[1]]

    out = one()
    if at != len(blob):
        raise ValueError("bytes behind the geometry")
    return out


def encode(kind: str, coords: list) -> bytes:
    """The inverse of decode: little endian, without an envelope."""
    head = lambda n: struct.pack("<BI", 1, n)
    line = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<2d", *p) for p in ps)
    single = {
        "Point": lambda part: head(1) + struct.pack("<2d", *part[0][0]),
        "LineString": lambda part: head(2) + line(part[0]),
        "Polygon": lambda part: head(3) + struct.pack("<I", len(part)) + b"".join(map(line, part)),
    }
    if kind in single:
        body = single[kind](coords[0])
    else:
        of = single[kind.removeprefix("Multi")]
        body = head(TYPES.index(kind) + 1) + struct.pack("<I", len(coords)) + b"".join(map(of, coords))
    return b"GP\x00\x01" + struct.pack("<i", 4326) + body


@F.udf(GEOMETRY, useArrow=True)
def geometry_of(blob):
    found = decode(blob)
    return None if found is None else {"type": found[0], "coords": [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in found[1]]}
