"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import duckdb
import pytest

from isoframe.plans import carried, carriers, samples

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ORACLE_SQL = carriers.ORACLE_SQL | carried.ORACLE_SQL | samples.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = (carriers.QUERIES | carried.QUERIES | samples.QUERIES)[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    b = sorted(map(repr, want.select(*columns).fetchall()))
    assert a == b


@pytest.mark.parametrize("name", sorted(samples.QUERIES))
def test_file_queries_run(spark, name):
    assert samples.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
