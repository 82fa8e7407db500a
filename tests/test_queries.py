"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest
from structdoc.plans.built_sql import ORACLES as BUILT
from structdoc.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return int(v) if isinstance(v, bool | int) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR"}
    told = {d[0]: str(d[1]) for d in want.description}
    assert {c: told[c] for c, t in got.dtypes if t in kinds} == {c: kinds[t] for c, t in got.dtypes if t in kinds} or name not in BUILT
    rows = sorted(repr(tuple(map(plain, r))) for r in got.select(*columns).collect())
    assert rows == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
