import os

import duckdb
import pytest

TABLES = "documents benchmark labels pages".split()


@pytest.fixture(scope="session")
def duck_tables():
    """DuckDB with the given tables as views, and their folder."""
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con, sf
