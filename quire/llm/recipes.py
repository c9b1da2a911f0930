"""Exact deduplication by recipes of content-defined chunks.

A text without its white space is cut where its own content says so: into atoms, which end at a mark,
and after each atom whose hash falls into one of CUT classes. Equal
texts have equal chunks wherever they stand, and texts that share stretches share chunks. Each
distinct chunk gets an identifier, its hash and, where chunks of different content have one hash, its
rank among them: contents are compared, hashes only find them. A text is then known by its recipe,
the list of its identifiers in order, and texts are equal where their recipes are. The content
travels once, as chunks that combine before the shuffle; all later steps move identifiers.
Only DataFrame functions run here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quire.llm.common import durable, fresh

BLANK = r"[ \t-\r]+"
MARKS = ".,;:!?、。，！？"
CUT, LONGEST = 16, 4096  # classes, characters


def normal(text: str = "text") -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANK, "")


def chunked(norm: Column) -> Column:
    """The chunks of a normalised text, in order. It has no spaces, so one can stand for a cut. Chunks
    over LONGEST characters, where no atom cuts, are cut at that length."""
    atoms = F.split(F.regexp_replace(norm, f"[{MARKS}]", "$0 "), " ")
    cut = F.transform(atoms, lambda a: F.when(F.pmod(F.xxhash64(a), F.lit(CUT)) == 0, F.concat(a, F.lit(" "))).otherwise(a))
    chunks = F.filter(F.split(F.array_join(cut, ""), " "), lambda c: c != "")
    return F.flatten(F.transform(chunks, lambda c: F.when(
        F.length(c) > LONGEST, F.regexp_extract_all(c, F.lit(f"(?s).{{1,{LONGEST}}}"), F.lit(0))).otherwise(F.array(c))))


def store(docs: DataFrame, text: str = "text", code: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(hash, chunk): the distinct chunks of all texts. They combine map-side, so a chunk that all texts
    share travels once a task."""
    return (docs.select(F.explode(chunked(normal(text))).alias("chunk"))
            .select(code(F.col("chunk")).alias("hash"), "chunk").distinct())


def recipes(docs: DataFrame, text: str = "text", code: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The columns of docs but the text, with `row` (a number), `chars` (code points of the text), `digest`
    (SHA-256 of the normalised text) and `recipe`: array of (hash, variant). These are written.

    The variant of a chunk is 0, or its rank among the chunks of its hash where those differ. Where
    no hash has two contents, and that is all of 64 bits can be expected to give, recipes come from
    one narrow pass."""
    others = [c for c in docs.columns if c != text]
    clashing = durable(store(docs, text, code).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "clashes")
    cell = F.struct(F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars"), normal(text).alias("norm"))
    rows = (docs.select(F.monotonically_increasing_id().alias("row"), *others, F.explode(F.array(cell)).alias("cell"))
            .select("row", *others, "cell.chars", F.sha2("cell.norm", 256).alias("digest"), F.col("cell.norm").alias("norm")))
    if not clashing.take(1):
        return durable(rows.select("row", *others, "chars", "digest", F.transform(
            chunked(F.col("norm")), lambda c: F.struct(code(c).alias("hash"), F.lit(0).alias("variant"))).alias("recipe")), "recipes")
    ranked = Window.partitionBy("hash").orderBy("chunk")
    variants = durable(store(docs, text, code).join(clashing, "hash")
                       .select("hash", "chunk", F.row_number().over(ranked).alias("variant")), "variants")
    steps = (rows.select("row", *others, "chars", "digest", F.posexplode_outer(chunked(F.col("norm"))).alias("place", "chunk"))
             .withColumn("hash", code(F.col("chunk")))
             .join(variants.withColumnRenamed("hash", "_h").withColumnRenamed("chunk", "_c"),
                   (F.col("hash") == F.col("_h")) & (F.col("chunk") == F.col("_c")), "left"))
    step = F.when(F.col("place").isNotNull(), F.struct("place", F.col("hash"), F.coalesce("variant", F.lit(0)).alias("variant")))
    listed = (steps.groupBy("row", *others, "chars", "digest").agg(F.array_sort(F.collect_list(step)).alias("steps")))
    return durable(listed.select("row", *others, "chars", "digest", F.transform(
        "steps", lambda s: F.struct(s["hash"].alias("hash"), s["variant"].alias("variant"))).alias("recipe")), "recipes")


def judged(docs: DataFrame, code: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the one with the smallest doc_id (a
    null one last); of rows that are equal in both, one stays. Null and empty texts, and texts of
    white space alone, are equal to each other. Columns other than doc_id and text are not read."""
    found = recipes(docs.select("doc_id", "text"), code=code)
    # ~x falls where x rises and can't overflow; a null is less than all
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("id"), (-F.col("row")).alias("row"))).alias("best")
    groups = (found.groupBy("recipe").agg(best, F.count("*").alias("group_size")).where("group_size > 1")
              .select(F.col("recipe").alias("same"), "best", "group_size"))
    alone = F.col("group_size").isNull()
    return found.join(groups, F.col("recipe") == F.col("same"), "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.bitwise_not("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == -F.col("row"))).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns and whole texts. A doc_id is taken to be one
    document: rows that share the id of one that stays stay with it."""
    key = fresh(docs, "_kept")
    kept = judged(docs).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


SQL = r"""
WITH texts AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER same = 1 AS kept, sha256(norm) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)
"""
