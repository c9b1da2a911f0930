"""The registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, chaining, classifier, embeddings, licences, packing, phrases, quality, recipes, repair, simhash, suffixes, urls
from quire.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classified(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(spark, table(spark, sf_dir, "pages", "page_id", "url"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.judged(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair.judged(talks, repair.damaged(talks))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents", "lang", "text"))


QUERIES = {
    "op1_substring_dedup": (op1_substring_dedup, None),
    "op2_bpe": (op2_bpe, None),
    "op3_quality_classifier": (op3_quality_classifier, None),
    "op4_licence_scan": (op4_licence_scan, licences.SQL),
    "op5_quality_rules": (op5_quality_rules, None),
    "op6_suffix_dedup": (op6_suffix_dedup, None),
    "op7_url_filter": (op7_url_filter, urls.SQL),
    "op8_simhash_dedup": (op8_simhash_dedup, None),
    "op9_embedding_dedup": (op9_embedding_dedup, None),
    "op10_packing": (op10_packing, None),
    "op11_exact_dedup": (op11_exact_dedup, recipes.SQL),
    "op12_conversation_repair": (op12_conversation_repair, None),
    "op13_phrase_mining": (op13_phrase_mining, phrases.SQL),
}
