"""Vector codes against distances computed one by one in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from terrachron.llm.codes import nearest, vector_codes


def plain(rows, parts=16, entries=64):
    """rows (vec_id, label, vector), vec_ids distinct."""
    kept = sorted((r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: r[0])
    w = len(kept[0][2]) // parts
    ints = [[math.floor(256 * x) for x in r[2]] for r in kept]
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            row = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)) for e in books[p]]
                row.append((min(d), d.index(min(d))))
            out.append(row)
        return out

    for _ in range(2):
        now = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, now, strict=True) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    now = assign()
    error = [sum(d for d, _ in a) for a in now]
    by = {}
    for r, e in zip(kept, error, strict=True):
        by[r[1]] = by.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {(r[0], "".join(f"{e:02x}" for _, e in a), x, by[r[1]], digest) for r, a, x in zip(kept, now, error, strict=True)}


SCHEMA = "vec_id long, label int, embedding array<double>, code int, error string"


def found(df):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize(("n", "size"), [(300, 64), (40, 32), (90, 16)])
def test_equals_plain_version(spark, n, size):
    rng = random.Random(n)
    rows = [(7 * i % 1009, rng.choice((None, 1, 1, 1, 2)), [rng.choice((rng.gauss(0, 1), 0.5, -0.5)) for _ in range(size)]) for i in range(n)]
    rows[5] = (rows[5][0], 1, list(rows[4][2]))
    rows += [(5000, 1, None), (5001, 1, [None] * size), (5002, None, [float("nan")] * size), (5003, 2, [float("inf")] + [0.0] * (size - 1))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert found(vector_codes(df)) == sorted(plain(rows))


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, i % 3, [rng.random() for _ in range(32)], 1, "x") for i in range(200)], SCHEMA)
    assert found(vector_codes(df.repartition(7))) == found(vector_codes(df.coalesce(1)))


def test_edges(spark):
    assert vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vector_codes(spark.createDataFrame([(1, 1, None, 1, "x")], SCHEMA)).collect() == []
    odd = [(1, 1, [0.5] * 20, 1, "x"), (1, 1, [0.5] * 20, 1, "x"), (None, None, [0.25] * 20, 1, "x"), (3, 1, [1.0] * 3, 1, "x"), (4, 1, [], 1, "x"), (5, 1, [1e300] * 20, 1, "x")]
    got = found(vector_codes(spark.createDataFrame([r for r in odd if r[0] is not None], SCHEMA)))
    assert [(r[0], r[2]) for r in got] == [(1, 0), (1, 0), (5, 0)] and got[0] == got[1]
    assert vector_codes(spark.createDataFrame(odd, SCHEMA)).count() == 4


def test_partial_distances_keep_ties_and_the_nearest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        points, book = rng.integers(-6, 6, (80, 5)), rng.integers(-6, 6, (64, 5))
        distances = ((points[:, None] - book[None]) ** 2).sum(-1)
        entry, least = nearest(points, book)
        assert (entry == distances.argmin(1)).all() and (least == distances.min(1)).all()
