"""The stages on a small table, each against a plain version of what it decides; the SQL of queries."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as pipeline  # noqa: E402
from quire.llm import classifier, common, packing, quality, simhash, suffixes  # noqa: E402
from quire.llm.queries import QUERIES  # noqa: E402
from tools.check import rows_of  # noqa: E402


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    decide = {
        "quality_rules": lambda d: {r["doc_id"] for r in quality.judged(d).where("kept").collect()},
        "quality_classifier": lambda d: {r["doc_id"] for r in classifier.classified(
            d, common.table(spark, sf, "labels")).where("predicted = 1").collect()},
        "simhash_dedup": lambda d: {r["component_id"] for r in simhash.near_duplicates(d).collect()},
        "suffix_dedup": lambda d: {r["doc_id"] for r in suffixes.digests(d).where("n_removed < n_bytes").collect()}}
    for name, stage in pipeline.STAGES[:-1]:
        after = common.durable(stage(spark, docs, sf))
        assert after.columns == columns
        got = {r["doc_id"] for r in after.collect()}
        assert got == decide[name](docs) and got
        docs = after
    packed = pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    judged = quality.judged(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    assert judged[judged["quality"] == 1]["kept"].mean() > 0.995
    assert judged[judged["quality"] == 0]["kept"].mean() < 0.1


def test_nulls_and_empty_tables(spark, sf):
    schema = common.table(spark, sf, "documents").schema
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 30, None, "a", 150)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in pipeline.STAGES:
            docs = common.durable(stage(spark, docs, sf))
        docs.collect()


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    run, sql = QUERIES[name]
    df = run(spark, sf)
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())
