"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from wakeline import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees(spark, name):
    df = registry.queries()[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    cur = con.execute(registry.oracle_sql()[name])
    cols = sorted(c[0] for c in cur.description)
    assert sorted(df.columns) == cols
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else str(v) for v in row)
    assert Counter(map(plain, df.select(*cols).collect())) == Counter(plain([r[i] for i in at]) for r in cur.fetchall())
