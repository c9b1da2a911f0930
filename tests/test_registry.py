"""Every registered query runs at the smallest scale and equals its SQL, row by row."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

# Too slow as brute-force SQL to repeat in every test run; tools/check.py covers them.
SLOW = {"simhash", "simhash_paged", "near_duplicates", "near_duplicate_neighbours", "unit_scores", "classify_unit"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n not in SLOW])
def test_query_equals_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "page", "score"]


def test_headers_are_read_by_all_cores(spark, sf):
    from quire.plans import exams

    assert exams._papers(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
