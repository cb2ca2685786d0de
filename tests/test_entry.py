import math

import duckdb
import pytest

import __spark_entry__ as entry
from stemmata.plans.queries import QUERIES
from stemmata.plans.sql import ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "null" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        at = [want.columns.index(c) for c in cols]
        assert sorted(want.columns) == cols
        assert got == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)
