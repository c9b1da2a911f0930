"""Exact, same-text and near-duplicate detection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.functions import text as X
from quire.functions.digests import md5_heads, xxh64_values
from quire.session import digest_words, durable, ship

MIN_WORDS = 40
MAX_DISTANCE = 6
BITS = 64
BUCKET_BITS = 5.5  # of the number of hashes that a band key is left to tell apart


def exact_copies(docs: DataFrame, owner: str = "owner", sha: str = "sha256",
                 key: str = "doc_id") -> DataFrame:
    """One row per owner and content: the first document and the number of copies."""
    return docs.groupBy(owner, sha).agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))


def page_digests(pages: DataFrame, doc: str = "doc_id", page: str = "page",
                 text: str = "text") -> DataFrame:
    """Content key of the normalised text of each document, and its words.

    The key adds up the digests of (page number, normalised page), so the pages of a document are
    never brought together and the order of the pages still counts.
    """
    norm = pages.select(F.col(doc), F.col(page), X.normalize(text).alias("norm"))
    digest = F.sha2(F.concat_ws("\f", F.col(page).cast("string"), "norm"), 256)
    hashed = norm.select(doc, X.word_count("norm").alias("w"), digest.alias("d"))
    sums = [F.sum(w).alias(f"s{i}") for i, w in enumerate(digest_words(F.col("d")))]
    return (hashed.groupBy(doc).agg(F.sum("w").alias("words"), F.count("*").alias("pages"), *sums)
            .select(doc, "words", F.sha2(F.concat_ws(
                "-", "pages", *[F.col(f"s{i}").cast("string") for i in range(8)]), 256)
                .alias("content_key")))


def same_text(keyed: DataFrame, dismissed: DataFrame | None = None, key: str = "doc_id",
              owner: str = "owner", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, duplicate_of: the first document of the owner with the same text. `keyed` has the
    content key and the words of each document; `dismissed(doc_id, other)` pairs are no copies."""
    docs = keyed.filter(F.col("words") >= min_words)
    first = (docs.groupBy(owner, "content_key").agg(F.min(key).alias("duplicate_of"))
             .withColumnRenamed(owner, "_owner").withColumnRenamed("content_key", "_key"))
    copies = (docs.join(first, (F.col(owner) == F.col("_owner"))
                        & (F.col("content_key") == F.col("_key")))
              .filter(F.col(key) != F.col("duplicate_of")).select(key, owner, "duplicate_of"))
    if dismissed is not None:
        both = dismissed.select(F.col(key).alias("_a"), F.col("other").alias("_b"))
        both = both.unionByName(both.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        copies = copies.join(both, (F.col(key) == F.col("_a"))
                             & (F.col("duplicate_of") == F.col("_b")), "left_anti")
    return copies


# --- simhash --------------------------------------------------------------------------------------


GRAM_HASHES = {"md5": md5_heads, "xxhash64": xxh64_values}  # 64 bits of a shingle; md5: the leading half


TOGETHER = 1 << 16  # words of pages whose shingles are hashed at a time


def _votes(words: list[bytes | None], lengths: list[int], counts: list[int], shingle: int, method: str) -> np.ndarray:
    """How many of the first shingles, `counts` of them, of each of some pages have each bit, the lowest first. `words` are those of
    all pages, so that short ones are hashed together. A shingle is a stretch of the joined words; None is a word that it leaves out."""
    sizes = np.fromiter((-1 if w is None else len(w) for w in words), "i8", len(words))
    ends = (sizes + 1).cumsum() - 1
    length, count = np.array(lengths, "i8"), np.array(counts, "i8")
    page = np.repeat(np.arange(len(count)), count)
    first = np.arange(count.sum()) + np.repeat((length.cumsum() - length) - (count.cumsum() - count), count)
    starts = (ends - sizes)[first]
    last = np.maximum(ends[np.minimum(first + shingle, length.cumsum()[page]) - 1], starts)
    text, out = b" ".join([w for w in words if w is not None]), np.zeros((len(count), BITS), "i8")
    for at in range(0, len(first), TOGETHER):
        some = slice(at, at + TOGETHER)
        bits, of = np.unpackbits(GRAM_HASHES[method](text, starts[some], last[some]), axis=1), page[some]
        # eight bits are summed as one number; none of them comes to more than 255 rows
        new = np.union1d(np.nonzero(np.append(True, of[1:] != of[:-1]))[0], np.arange(0, len(of), 255))
        np.add.at(out, of[new], np.add.reduceat(bits.view("u8"), new, axis=0).view("u1"))
    return out[:, ::-1]


def simhash(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text",
            shingle: int = 3, method: str = "md5", marks: bool = True,
            carry: tuple[str, ...] = (), last_page: str | None = None) -> DataFrame:
    """doc_id, words, simhash of the whole document text, one page after the other.

    With `marks` each page starts with its page mark, as in the assembled document. A shingle that
    runs over a page end only ever meets the two words of the next mark, so pages are cut into
    shingles apart from each other. `carry` are further columns, constant per document;
    `last_page` names a column with the number of the last page, if there is one. Texts are normalised and their shingles hashed
    in one pass over Arrow batches, a row of votes for each page; votes are counted for two bits at a time in one 64-bit sum.
    """
    ship(pages.sparkSession)
    number, last = F.lit(None).cast("int"), F.lit(None).cast("int")
    if marks and last_page is None:
        ends = pages.groupBy(F.col(doc).alias("_d")).agg(F.max(page).alias("_last"))
        pages = pages.join(ends, F.col(doc) == F.col("_d")).drop("_d")
    if marks:
        number, last = F.col(page), F.col(last_page or "_last")
    rows = pages.filter(F.col(text).isNotNull()).select(
        doc, *carry, F.col(text).cast("binary").alias("_text"), number.cast("int").cast("string").alias("_page"),
        (number + 1).cast("int").cast("string").alias("_next"), F.coalesce(number < last, F.lit(False)).alias("_more"))
    names = [doc, *carry]
    sums = ["_words", "_n", *[f"_v{b}" for b in range(32)]]
    kind = StructType([*[rows.schema[c] for c in names], *[StructField(c, LongType()) for c in sums]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, words, lengths, counts = [], [], [], [], []

            def voted() -> pa.RecordBatch:
                votes = _votes(words, lengths, counts, shingle, method)
                values = [np.array(sizes, "i8"), np.array(counts, "i8"), *(votes[:, :32] + (votes[:, 32:] << 32)).T]
                carried = [batch.column(c).take(pa.array(kept)) for c in names]
                for done in (kept, sizes, words, lengths, counts):
                    done.clear()
                return pa.RecordBatch.from_arrays([*carried, *map(pa.array, values)], [*names, *sums])

            for i, (content, here, onward, more) in enumerate(zip(*(batch.column(c) for c in ("_text", "_page", "_next", "_more")))):
                own = X.word_list(content.as_py().decode("utf-8", "replace"))
                tail = []
                if marks:
                    mark = lambda n: [b"pagina", n.as_py().encode() if n.is_valid else None]
                    own, tail = mark(here) + own, mark(onward) if more.as_py() else []
                if not own:
                    continue
                kept.append(i)
                sizes.append(len(own))
                # a page that is followed by another yields one shingle per own word, the last page stops early
                counts.append(len(own) if more.as_py() else max(len(own) - (shingle - 1), 1))
                lengths.append(len(own) + len(tail))
                words += own + tail
                if len(words) >= TOGETHER:
                    yield voted()
            if kept:
                yield voted()

    counted = rows.mapInArrow(run, kind).groupBy(*names).agg(
        F.sum("_words").alias("words"), *[F.sum(c).alias(c) for c in sums[1:]])
    packed = F.lit(0).cast("long")
    for b in range(32):
        low = F.col(f"_v{b}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("_n")
        high = F.shiftrightunsigned(F.col(f"_v{b}"), 32) * 2 > F.col("_n")
        packed = packed.bitwiseOR(F.when(low, F.lit(1 << b)).otherwise(F.lit(0).cast("long")))
        top = 1 << (b + 32)
        packed = packed.bitwiseOR(F.when(high, F.lit(top if top < 1 << 63 else top - (1 << 64))
                                         .cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*names, "words", packed.alias("simhash"))


def simhash_hex(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def plan_blocks(n: int, distance: int = MAX_DISTANCE) -> tuple[int, int]:
    """(blocks, agreeing blocks) for about `n` hashes. Two hashes at most `distance` bits apart
    agree in `blocks - distance` blocks at least; more blocks make keys longer and buckets smaller,
    at the price of more copies of each hash."""
    agree = 1
    while agree * BITS / (distance + agree) < log2(max(n, 1)) - BUCKET_BITS:
        agree += 1
    return distance + agree, agree


def _band_masks(blocks: int, agree: int) -> list[int]:
    """The bits of every choice of `agree` blocks of a hash, as signed numbers."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    chosen = [sum(some) for some in combinations(masks, agree)]
    return [mask if mask < 1 << 63 else mask - (1 << 64) for mask in chosen]


def band_keys(value: Column, blocks: int, agree: int) -> Column:
    """Every choice of `agree` blocks of the hash, as (choice, bits) keys."""
    return F.array(*[F.struct(F.lit(number).alias("band"), value.bitwiseAND(F.lit(mask).cast("long")).alias("bits"))
                     for number, mask in enumerate(_band_masks(blocks, agree))])


def first_band(xor: Column, blocks: int, agree: int) -> Column:
    """The first band key that two hashes share."""
    tests = [(xor.bitwiseAND(F.lit(mask).cast("long")) == 0, number) for number, mask in enumerate(_band_masks(blocks, agree))]
    return reduce(lambda shared, test: shared.when(*test), tests[1:], F.when(*tests[0]))


def close_hashes(hashes: DataFrame, distance: int = MAX_DISTANCE,
                 blocks: tuple[int, int] | None = None) -> DataFrame:
    """Pairs `hash_a < hash_b` of distinct hashes at most `distance` bits apart.

    Any two such hashes share a band key, so the pairs come from an equi-join whose skewed buckets
    are split at run time; the first shared band reports the pair, which saves a `distinct`. Which one that is
    is the last condition of the join, so that it is asked for close pairs only: a filter behind the join
    would go before its conditions, for all pairs of a bucket, whose number grows with the square of the hashes.
    """
    if blocks is None:
        blocks = plan_blocks(hashes.count(), distance)
    banded = hashes.select(F.col("simhash"), F.explode(band_keys(F.col("simhash"), *blocks))
                           .alias("k")).select("simhash", "k.band", "k.bits")
    # sizes are guessed before the keys are unfolded: without the hint the driver would gather them for a broadcast
    a, b = banded.alias("a"), banded.hint("merge").alias("b")
    xor = F.col("a.simhash").bitwiseXOR(F.col("b.simhash"))
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits"))
                   & (F.col("a.simhash") < F.col("b.simhash"))
                   & (F.bit_count(xor) <= distance) & (F.col("a.band") == first_band(xor, *blocks)))
    return pairs.select(F.col("a.simhash").alias("hash_a"), F.col("b.simhash").alias("hash_b"), F.bit_count(xor).alias("distance"))


def memberships(members: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, sha256, simhash of the documents that near duplicates are sought among: with the links of
    `near_duplicates`, which name hashes, all pairs of documents can be told."""
    return members.filter(F.col("words") >= min_words).select("doc_id", "sha256", "simhash")


def near_duplicates(members: DataFrame, distance: int = MAX_DISTANCE,
                    min_words: int = MIN_WORDS, dismissed: DataFrame | None = None,
                    apart: tuple[Column, Column] | None = None) -> DataFrame:
    """Near duplicates in factored form. `members(doc_id, sha256, words, simhash)` are the live
    documents. One row links two hashes, each standing for all its documents (hash_a, first_a, docs_a, contents_a):
    every document of one is near every document of the other, but for the pairs in `dismissed(doc_id, other)`; `pairs` counts
    them. A hash shared by different contents gives a row with itself at distance 0, whose pairs are those of
    different content. A third of all documents in one group stays one row; a link without pairs left is none.

    `apart` dismisses by rule instead of by list: two conditions that no document meets both; a pair with
    one document of either is none. Such pairs are counted from the sizes of the groups, never listed.
    """
    live = memberships(members, min_words)
    one_of, other_of = apart or (F.lit(False), F.lit(False))
    those = lambda c: F.count(F.when(c, 1))
    groups = (live.groupBy("simhash", "sha256")
              .agg(F.min("doc_id").alias("_first"), F.count("*").alias("_docs"), those(one_of).alias("_one"), those(other_of).alias("_other"))
              .groupBy("simhash").agg(F.min("_first").alias("first"), F.sum("_docs").alias("docs"),
                                      F.count("*").alias("contents"), F.sum(F.col("_docs") * F.col("_docs")).alias("squares"),
                                      F.sum("_one").alias("one"), F.sum("_other").alias("other"), F.sum(F.col("_one") * F.col("_other")).alias("mixed")))
    groups = durable(groups, "hashes")
    pairs = close_hashes(groups.select("simhash"), distance)
    side = lambda s: groups.select(*[F.col(c).alias(f"{c}_{s}") for c in
                                     ("simhash", "first", "docs", "contents", "one", "other")])
    linked = (pairs.join(side("a"), F.col("hash_a") == F.col("simhash_a"))
              .join(side("b"), F.col("hash_b") == F.col("simhash_b")))
    swap = F.col("first_a") > F.col("first_b")

    def ordered(name: str, x: str, y: str) -> Column:
        return F.when(swap, F.col(f"{name}_{y}")).otherwise(F.col(f"{name}_{x}")).alias(
            f"{name}_{x}")

    linked = linked.select("distance", *[ordered(c, x, y) for c in ("simhash", "first", "docs", "contents")
                                         for x, y in (("a", "b"), ("b", "a"))], (F.col("docs_a") * F.col("docs_b") - F.col("one_a") * F.col("other_b")
                                                           - F.col("other_a") * F.col("one_b")).alias("pairs"))
    equal = groups.filter(F.col("contents") > 1).select(
        F.lit(0).alias("distance"), *[F.col(c).alias(f"{c}_{s}") for c in ("simhash", "first", "docs", "contents") for s in ("a", "b")],
        F.expr("(docs * docs - squares) div 2 - (one * other - mixed)").alias("pairs"))
    links = linked.unionByName(equal).filter("pairs > 0").withColumnsRenamed({"simhash_a": "hash_a", "simhash_b": "hash_b"})
    if dismissed is not None:
        one = live.select(F.col("doc_id").alias("_a"), F.col("sha256").alias("_sha_a"), F.col("simhash").alias("_x"))
        two = live.select(F.col("doc_id").alias("_b"), F.col("sha256").alias("_sha_b"), F.col("simhash").alias("_y"))
        gone = (dismissed.select(F.least("doc_id", "other").alias("_a"), F.greatest("doc_id", "other").alias("_b")).distinct()
                .join(one, "_a").join(two, "_b").filter("_sha_a <> _sha_b")
                .groupBy(F.least("_x", "_y").alias("_low"), F.greatest("_x", "_y").alias("_high")).agg(F.count("*").alias("_gone")))
        links = (links.join(gone, (F.least("hash_a", "hash_b") == F.col("_low")) & (F.greatest("hash_a", "hash_b") == F.col("_high")), "left")
                 .withColumn("pairs", F.col("pairs") - F.coalesce("_gone", F.lit(0))).drop("_low", "_high", "_gone").filter("pairs > 0"))
    return links.withColumn("score", F.round(1 - F.col("distance") / 64, 3))


def neighbours(members: DataFrame, doc: DataFrame, dismissed: DataFrame | None = None,
               distance: int = MAX_DISTANCE, min_words: int = MIN_WORDS) -> DataFrame:
    """Near duplicates of each document in `doc(doc_id)`: other, distance, score. The hashes of the asked
    documents are joined with all hashes on band keys. `members` are read several times: pass stored ones."""
    live = memberships(members, min_words)
    asked = live.join(doc.select("doc_id"), "doc_id", "left_semi").select(
        *[F.col(c).alias(f"_{c}") for c in ("doc_id", "sha256", "simhash")])
    hashes = durable(live.select("simhash").distinct(), "hashes")
    blocks = plan_blocks(hashes.count(), distance)
    keys = lambda df, c: df.withColumn("k", F.explode(band_keys(F.col(c), *blocks)))
    xor = F.col("simhash").bitwiseXOR(F.col("_simhash"))
    # copies of one hash or content meet as one row, so that those of the same content are never paired
    near = (keys(hashes, "simhash").join(keys(asked.select("_simhash").distinct(), "_simhash").hint("merge"), "k")
            .filter((F.bit_count(xor) <= distance) & (F.col("k.band") == first_band(xor, *blocks)))
            .select("simhash", "_simhash", F.bit_count(xor).alias("distance")))
    found = (near.join(asked.select("_simhash", "_sha256").distinct(), "_simhash").join(live.select("simhash", "sha256").distinct(), "simhash")
             .filter(F.col("sha256") != F.col("_sha256"))
             .join(asked, ["_simhash", "_sha256"]).join(live, ["simhash", "sha256"])
             .select(F.col("_doc_id").alias("doc_id"), F.col("doc_id").alias("other"), "distance"))
    if dismissed is not None:
        pairs = dismissed.select(F.col("doc_id").alias("_a"), F.col("other").alias("_b"))
        pairs = pairs.unionByName(pairs.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        found = found.join(pairs, (F.col("doc_id") == F.col("_a"))
                           & (F.col("other") == F.col("_b")), "left_anti")
    return found.withColumn("score", F.round(1 - F.col("distance") / 64, 3))
