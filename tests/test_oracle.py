"""Every registered query of the library that has SQL, against DuckDB on the same tables."""

import duckdb
import pytest

from millrace.plans import QUERIES, SQL
from millrace.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in SQL:
        assert rows
        return
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    at = [got.columns.index(n) for n in names]
    assert sorted(repr(tuple(r[i] for i in at)) for r in rows) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
