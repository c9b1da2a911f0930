"""The corpus pipeline: quality rules, quality classifier, SimHash near-dedup, suffix dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; `run` writes each
result to the shared folder as Parquet and reads it back. All but the last return the columns of
documents. A row is known by its doc_id; what a stage decides on a doc_id holds for its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import classifier, packing, quality, simhash, suffixes
from quire.llm.common import durable, fresh, table


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id, null or not, is among the ids."""
    key = fresh(docs, "_kept")
    ids = ids.select(F.col("doc_id").alias(key)).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _only(docs, quality.judged(docs).where("kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold go; without labels every document stays."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    if not labels.where("quality in (0, 1)").take(1):
        return docs
    return _only(docs, classifier.classified(docs, labels).where("predicted = 1"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest doc_id stays; groups without any id stay."""
    found = simhash.near_duplicates(docs)
    return _only(docs, found.where("component_id is null or doc_id = component_id"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings go from the texts; texts of which nothing is left go."""
    left = suffixes.deduplicated(docs)
    return left.where("text is null or text <> ''").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]
# Robust estimates, kernel features, merges and packing have no SQL form; tests/llm compares each
# stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
