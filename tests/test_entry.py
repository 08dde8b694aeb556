"""Registered queries against their DuckDB equivalents on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from quillveil.plans import audit, conditions, contexts, linkage, patterns, reports, text

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
NAMES = [*text.QUERIES, *linkage.QUERIES, *reports.QUERIES, *audit.QUERIES, *patterns.QUERIES, *contexts.QUERIES, *conditions.QUERIES]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(frame):
    cols = sorted(frame.columns)
    show = lambda v: repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return cols, sorted(map(tuple, frame[cols].map(show).to_numpy().tolist()))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in entry.oracle_sql():
        assert normal(got) == normal(duck.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
