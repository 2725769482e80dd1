"""Each query against its SQL on the smallest tables, as multisets of rows."""

import os

import duckdb
import pytest

from tessaly.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


def _rows(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    found = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    assert rows
    if name in catalogue.ORACLES:
        oracle.execute(catalogue.ORACLES[name])
        names = [d[0] for d in oracle.description]
        assert sorted(names) == columns
        want = [tuple(r[names.index(c)] for c in columns) for r in oracle.fetchall()]
        assert _rows(rows) == _rows(want)
