"""Every catalogued query against its oracle SQL, on the small tables."""

import datetime as dt
import os

import duckdb
import pytest

from heronbase import catalogue, surface  # noqa: F401  the second adds to the first

HERE = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, float):
        return round(x, 6)
    if hasattr(x, "toPython"):
        return x.toPython()
    return x


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{HERE}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, HERE)
    rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr)
    if name not in catalogue.SQL:
        assert rows
        return
    want = oracle.sql(catalogue.SQL[name])
    order = [want.columns.index(c) for c in sorted(got.columns)]
    assert sorted(want.columns) == sorted(got.columns)
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")
def test_table_flatten_reads_every_vector(spark, oracle):
    got = catalogue.QUERIES["fn_table_flatten"](spark, HERE).select("vec_id").distinct().count()
    assert got == len(oracle.sql("SELECT DISTINCT vec_id FROM embeddings").fetchall())


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")
def test_sort_puts_every_null_row_last(spark, oracle):
    got = [r.seg is None for r in catalogue.QUERIES["sort_nulls_last"](spark, HERE).collect()]
    assert any(got) and got == sorted(got)
    assert len(got) == len(oracle.sql("SELECT * FROM customer").fetchall())


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")
def test_cross_join_pairs_every_nation(spark, oracle):
    assert catalogue.QUERIES["join_cross"](spark, HERE).count() == len(oracle.sql("SELECT 1 FROM region, nation").fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
