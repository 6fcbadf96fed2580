import glob

import duckdb
import pytest

import __spark_entry__
from millrace.plans import catalog

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_duckdb(spark, duck, name):
    found = catalog.QUERIES[name](spark, SMALL)
    rows = found.collect()
    assert rows or name in ("in_subquery",)
    if name not in catalog.ORACLES:
        return
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    order = sorted(names)
    expected = [tuple(canon(r[names.index(c)]) for c in order) for r in want.fetchall()]
    got = [tuple(canon(r[c]) for c in order) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
