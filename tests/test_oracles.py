import math
import os

import duckdb
import pytest

from siftwell.plans.table_queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(repr([tidy(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(map(tuple, df.collect()), df.columns) == rows(cur.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
