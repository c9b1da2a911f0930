"""Look-ups by key, reference lists, extraction figures and fields that depend on others."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.operators import classify as C, library as L
from quire.plans.deposits import PAGE_META_SQL, page_meta
from quire.plans.shelves import _INDEX, index
from quire.session import table


def _named(df: DataFrame, what: str, id_: str = "id") -> DataFrame:
    return df.select(F.lit(what).alias("lookup"), F.col(id_).cast("string").alias("id"))


def lookups(spark, sf):
    """Single look-ups over the library: a document, an id by its prefix, the bin, the copies of the
    documents that have any, without and with removed ones."""
    idx = index(spark, sf)
    copied = idx.agg(F.min("duplicate_of")).scalar()
    parts = [_named(L.by_id(idx, 17), "by_id"), _named(L.by_prefix(idx, "99"), "by_prefix"), _named(L.removed(idx), "bin"),
             _named(L.removed(idx, "src3"), "bin_of_owner"), _named(L.copies_of(idx, copied), "copies"),
             _named(L.copies_of(idx, copied, True), "all_copies"), _named(L.unfiled(idx, "src3"), "unfiled_of_owner")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


LOOKUPS_SQL = f"""WITH {_INDEX}, alone AS (SELECT * FROM idx WHERE kind <> 'archive' AND duplicate_of IS NULL),
p AS (SELECT id FROM idx WHERE starts_with(id::VARCHAR, '99')), c AS (SELECT * FROM idx WHERE duplicate_of = (SELECT min(duplicate_of) FROM idx)),
r AS (SELECT 'by_id' AS lookup, id FROM idx WHERE id = 17
UNION ALL SELECT 'by_prefix', id FROM p WHERE (SELECT count(*) FROM p) = 1
UNION ALL SELECT 'bin', id FROM alone WHERE status = 'removed'
UNION ALL SELECT 'bin_of_owner', id FROM alone WHERE status = 'removed' AND owner = 'src3'
UNION ALL SELECT 'copies', id FROM c WHERE status <> 'removed' UNION ALL SELECT 'all_copies', id FROM c
UNION ALL SELECT 'unfiled_of_owner', id FROM alone WHERE status IN ({", ".join(f"'{s}'" for s in L.UNFILED)}) AND owner = 'src3')
SELECT lookup, id::VARCHAR AS id FROM r"""


def members_and_children(spark, sf):
    """Orders as bundles and archives: the members of one, its lead first, and the parts of another."""
    lines = table(spark, sf, "lineitem")
    lead = lines.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("bundle_lead"))
    docs = lines.join(lead, "l_orderkey").select(
        F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("bundle_id"), "bundle_lead", F.col("l_orderkey").alias("parent"),
        F.col("l_partkey").alias("source_path"), F.when(F.col("l_returnflag") == "R", "removed").otherwise("filed").alias("status"),
        F.lit(None).cast("int").alias("duplicate_of"))
    keys = table(spark, sf, "orders").filter("o_orderstatus = 'F'").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return (_named(L.bundle_members(docs, keys[0]), "members").unionByName(_named(L.children(docs, keys[1]), "children")))


MEMBERS_SQL = """WITH k AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders WHERE o_orderstatus = 'F')
SELECT 'members' AS lookup, l_linenumber::VARCHAR AS id FROM lineitem, k WHERE l_orderkey = a AND l_returnflag <> 'R'
UNION ALL SELECT 'children', l_linenumber::VARCHAR FROM lineitem, k WHERE l_orderkey = b AND l_returnflag <> 'R'"""


def reference_lists(spark, sf):
    """Regions, nations and customers as institutions, courses and units; types of parts as a vocabulary."""
    lists = [("institutions", table(spark, sf, "region").select(F.col("r_name").alias("name"))),
             ("courses", table(spark, sf, "nation").select(F.col("n_name").alias("name"))),
             ("units", table(spark, sf, "customer").select(F.col("c_name").alias("name")))]
    terms = table(spark, sf, "part").groupBy("p_type").agg(F.min("p_partkey").alias("sort")).select(
        F.when(F.startswith("p_type", F.lit("P")), "document_types").otherwise("topics").alias("kind"), F.col("p_type").alias("name"), "sort",
        F.when(F.col("sort") % 3 == 0, True).alias("is_assessment"))
    words = L.vocabulary(terms, "document_types").select(
        F.lit("vocabulary").alias("list"), F.concat_ws(" ", "name", F.col("is_assessment").cast("string")).alias("name"))
    for what, df in lists:
        words = words.unionByName(L.reference_list(df, what).select(F.lit(what).alias("list"), "name"))
    return words


REFERENCE_SQL = """WITH t AS (SELECT p_type AS name, min(p_partkey) AS sort FROM part GROUP BY 1)
SELECT 'vocabulary' AS list, name || ' ' || (sort % 3 = 0)::VARCHAR AS name FROM t WHERE starts_with(name, 'P')
UNION ALL SELECT 'institutions', r_name FROM region UNION ALL SELECT 'courses', n_name FROM nation UNION ALL SELECT 'units', c_name FROM customer"""


def extraction_figures(spark, sf):
    """Conversations as contents of several pages, documents with the same number as their owners."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")
    pages = turns.join(page_meta(spark, sf).select("doc_id", "page", "needs_transcription"), ["doc_id", "page"])
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("sha256"))
    return L.with_extraction(docs, pages.withColumnRenamed("doc_id", "sha256")).drop("sha256")


FIGURES_SQL = rf"""WITH m AS ({PAGE_META_SQL}), p AS (SELECT m.doc_id, count(*) AS pages,
  sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS words, count(*) FILTER (needs_transcription)
  AS pages_needing_transcription FROM m JOIN conversations c ON c.conv_id = m.doc_id AND c.turn + 1 = m.page GROUP BY m.doc_id)
SELECT d.doc_id AS id, coalesce(pages, 0) AS pages, coalesce(words, 0) AS words,
  coalesce(pages_needing_transcription, 0) AS pages_needing_transcription FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id"""


def assessment_fields(spark, sf):
    """Orders as documents, priorities as types; urgent and high ones are assessments."""
    docs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("document_type"), F.col("o_orderstatus").alias("exam_season"),
        (F.col("o_custkey") % 4).alias("assessment_number"), F.col("o_custkey").alias("unit"))
    kinds = docs.select(F.col("document_type").alias("slug")).distinct().withColumn("is_assessment", F.substring("slug", 1, 1).isin("1", "2"))
    return C.assessment_fields(docs, kinds)


ASSESSMENT_SQL = """SELECT o_orderkey AS doc_id, o_orderpriority AS document_type,
CASE WHEN o_orderpriority[1] IN ('1', '2') THEN o_orderstatus END AS exam_season,
CASE WHEN o_orderpriority[1] IN ('1', '2') THEN o_custkey % 4 END AS assessment_number, o_custkey AS unit FROM orders"""


def solution_origin(spark, sf):
    """Orders as documents, their lines as scores of origins; finished orders are solutions."""
    docs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "solution").otherwise("statement").alias("role"),
        (F.col("o_custkey") % 5).cast("double").alias("solution_score"))
    scores = table(spark, sf, "lineitem").filter("l_discount > 0.05").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("value"), F.col("l_discount").alias("confidence"))
    return C.solution_origin(docs, scores, "unknown")


ORIGIN_SQL = """WITH b AS (SELECT l_orderkey, max((l_discount, l_linestatus)) AS x FROM lineitem WHERE l_discount > 0.05 GROUP BY 1),
d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'solution' ELSE 'statement' END AS role,
  (o_custkey % 5)::DOUBLE AS solution_score, x[1] AS c, x[2] AS v FROM orders LEFT JOIN b ON l_orderkey = o_orderkey)
SELECT doc_id, role, solution_score, CASE WHEN role = 'solution' AND solution_score > 0 THEN coalesce(v, 'unknown') END AS origin,
  CASE WHEN role = 'solution' AND solution_score > 0 THEN coalesce(c, 0.3) END AS origin_confidence,
  CASE WHEN role = 'solution' AND solution_score > 0 AND v IS NULL THEN 'origin.unknown' END AS origin_reason FROM d"""


QUERIES = {
    "lookups": (lookups, LOOKUPS_SQL),
    "members_and_children": (members_and_children, MEMBERS_SQL),
    "reference_lists": (reference_lists, REFERENCE_SQL),
    "extraction_figures": (extraction_figures, FIGURES_SQL),
    "assessment_fields": (assessment_fields, ASSESSMENT_SQL),
    "solution_origin": (solution_origin, ORIGIN_SQL),
}
