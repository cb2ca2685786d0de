import os

import duckdb
import pytest

from stemmata.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    df = QUERIES[name](spark, SF)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(names) == sorted(df.columns) and want == sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
