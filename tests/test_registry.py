"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from terrachron.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in NAMES:
        con.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the supplied tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sql, name):
    got, want = QUERIES[name](spark, FOLDER), sql.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    rows = lambda found: sorted((tuple((v is None, str(v)) for v in r) for r in found))
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(tuple(r[i] for i in order) for r in want.fetchall())
