"""The operators' queries against their SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from ferrule.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    named = [c[0] for c in found.description]
    assert sorted(named) == sorted(df.columns)
    order = [named.index(c) for c in df.columns]
    assert Counter(tuple(r) for r in df.collect()) == Counter(tuple(r[i] for i in order) for r in found.fetchall())
