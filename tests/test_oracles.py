"""Every registered query of the library proper against its SQL, on the smallest tables."""

import datetime
import decimal
import functools
import math
from collections import Counter

import duckdb
import pytest

import ferrule.plans.coverage_queries
import ferrule.plans.detector_queries
import ferrule.plans.event_queries
import ferrule.plans.import_queries
import ferrule.plans.system_queries  # noqa: F401
from ferrule.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
#: Queries that have no rows on the smallest tables.
LARGER = {"finding_page": "/root/testdata/sf0.01"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return "nan" if math.isnan(value) else round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


@pytest.fixture(scope="module")
def duck():
    def connected(place):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{place}/{t}.parquet')")
        return con

    return functools.cache(connected)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if sql))
def test_query_agrees_with_its_sql(spark, duck, name):
    run, sql = REGISTRY[name]
    place = LARGER.get(name, SF)
    df = run(spark, place)
    found = duck(place).execute(sql)
    named = [c[0] for c in found.description]
    assert sorted(named) == sorted(df.columns)
    order = [named.index(c) for c in df.columns]
    expected = Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    got = Counter(tuple(plain(v) for v in r) for r in df.collect())
    assert sum(got.values()) > 0 and got == expected
