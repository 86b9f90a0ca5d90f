"""Packs: what is encoded is decoded, whole batches at once; unsound bytes are refused; tiles read their packs only."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from terrachron.sources import hydro


def made(rng, n, stage):
    out = []
    for i in range(n):
        kind = rng.randint(1, 4)
        parts = 1 if kind in (1, 3) else rng.randint(1, 3)
        lines = []
        for p in range(parts):
            for _ in range(1 if kind <= 2 else rng.randint(1, 3)):
                k = rng.choice((0, 1, 2, 40)) if kind <= 2 else rng.randint(4, 9)
                xy = [(rng.randint(-(2**31), 2**31 - 1), rng.randint(-90_000_000, 90_000_000)) for _ in range(k)]
                lines.append((0 if kind <= 2 else p, xy, [rng.randint(0, 10**6) for _ in range(k)] if kind <= 2 else None))
        if rng.random() < 0.4:
            lines = [(p, xy, None) for p, xy, _ in lines]
        out.append({"fid": 100 * stage + i, "logical_fid": i, "kind": 1 if kind <= 2 else 2, "stage": stage, "geometry_kind": kind, "flags": i % 2, "fragment_index": i % 3, "fragment_count": 3, "stroke_width": 1.5, "w": -i, "s": 2 * i, "e": 5, "n": 6, "lines": lines})
    return out


def test_numbers():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**21, 2**28, 2**32 - 1])
    assert hydro.varints(hydro.to_varints(values))[0].tolist() == values.tolist()
    signed = np.array([0, -1, 1, -2, 2**31 - 1, -(2**31)])
    assert hydro.unzigzag(hydro.zigzag(signed)).tolist() == signed.tolist()
    with pytest.raises(ValueError, match="complete"):
        hydro.varints(np.array([0x80], np.uint8))


def test_round_trip():
    rng = random.Random(4)
    packs = [made(rng, n, n % 4) for n in (7, 0, 30, 1)]
    got = hydro.decoded(np.arange(10, 14), pa.array([hydro.encode(p, i) for p, i in zip(packs, (3, 0, 2, 1), strict=True)], pa.binary())).to_pylist()
    want = [(10 + i, r) for i, p in enumerate(packs) for r in p]
    assert len(got) == len(want)
    for g, (pack, r) in zip(got, want, strict=True):
        assert g["pack"] == pack and all(g[k] == r[k] for k in ("fid", "logical_fid", "kind", "stage", "geometry_kind", "flags", "fragment_index", "fragment_count", "stroke_width"))
        assert [g[k] for k in "wsen"] == [r[k] / 1e6 for k in "wsen"]
        assert [(x["polygon"], [(p["x"], p["y"]) for p in x["points"]], x["widths"]) for x in g["lines"]] == [(p, [(a / 1e6, b / 1e6) for a, b in xy], None if w is None else [v / 1e3 for v in w]) for p, xy, w in r["lines"]]


def test_unsound_packs_are_refused():
    pack = hydro.encode(made(random.Random(1), 5, 2), 2)
    wrong = [pack[:-1], pack + b"\0", b"x" + pack[1:], pack[:6] + b"\3" + pack[7:], pack[:8] + b"\6" + pack[9:], pack[:20] + b"\7" + pack[21:], pack[:5]]
    for data in wrong:
        with pytest.raises(ValueError):
            hydro.decoded(np.array([1]), pa.array([data], pa.binary()))


def test_tiles_read_their_packs(spark):
    rng = random.Random(2)
    packs = {i: hydro.encode(made(rng, 3, 1), 1) for i in range(6)}
    shards = [b"".join(packs[i] for i in (0, 1, 2)), b"".join(packs[i] for i in (3, 4, 5))]
    offset = lambda i: sum(len(packs[j]) for j in range(3 * (i // 3), i))
    index = struct.pack("<IHHIII", hydro.INDEX_MAGIC, 4, 0, 2, 1, 6)
    index += struct.pack("<BHHH2I", 1, 5, 6, 2, 1, 4) + struct.pack("<BHHHI", 1, 5, 7, 1, 2) + struct.pack("<IH2I", 77, 2, 0, 1)
    index += b"".join(struct.pack("<IHIIB", i, i // 3, offset(i), len(packs[i]), 1) for i in packs)
    rows = hydro.index_rows(spark.createDataFrame([(bytearray(index),)], "content binary"))
    assert sorted(r.pack for r in rows.where("logical = 77").collect()) == [0, 1]
    cut = hydro.packs_at(rows, spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(shards)], "shard int, content binary"), spark.createDataFrame([(1, 5, 6), (1, 5, 6), (1, 9, 9)], "stage int, x int, y int"))
    assert {r.pack: bytes(r.content) for r in cut.collect()} == {i: packs[i] for i in (1, 4)}
    assert hydro.features(cut).count() == 6
    with pytest.raises(Exception, match="isn't closed"):
        hydro._index(struct.pack("<IHHIII", hydro.INDEX_MAGIC, 4, 0, 1, 0, 0) + struct.pack("<BHHHI", 1, 5, 7, 1, 2))
