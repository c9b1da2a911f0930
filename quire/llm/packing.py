"""Bulk-synchronous best-fit packing of token sequences.

Pieces and gaps are kept range-sorted as runs: pieces of one length with consecutive ranks, and
sequences of one gap with consecutive numbers. A superstep sweeps both from large to small: every
piece takes the least gap not below it that no larger piece has taken, ties go by rank. Then the gaps
shrink and the next superstep starts, until no piece of the band is left. Pieces of one length are
interchangeable, so the runs depend on the capacity and not on the corpus; the ranks come from a
distributed range sort, and the rows meet their places in a join.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.bpe import SPLIT, coder
from quire.llm.common import arrow_map, durable, ship, tokenizer_path

CAPACITY = 2048
SHARE = 4  # a length with over so many pieces a gap is placed several at a time
STATE = "kind int, size long, first long, n long, times long, gap long, bin long"
GAP, PIECE, PLACED = 0, 1, 2


@functools.lru_cache(maxsize=2)
def _library(path: str):
    import tiktoken

    auto = coder(path).auto
    return tiktoken.Encoding("documents", pat_str=SPLIT, mergeable_ranks=dict(auto.arc), special_tokens=auto.added)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a whole text. Texts with letters that Unicode versions tell apart go by the automaton."""
    if not text:
        return np.empty(0, "<u4")
    if text.isascii() or max(text) < "ɐ":
        return _library(path).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
    return np.frombuffer(coder(path).encode(text), "<u4")


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = 0, tokenizer: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids if asked for. A document is
    its ids and the id `end`, so an empty or null text is one token; longer ones than `capacity` are
    cut so that only the first piece is shorter. Repeated rows are packed each."""
    path = tokenizer or tokenizer_path()

    def run(batch: pa.RecordBatch) -> dict:
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1)):
            tokens = np.append(token_ids(text.as_py(), path), np.uint32(end)).astype("<u4")
            raw, n = memoryview(tokens).cast("B"), len(tokens)
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                row.append(i)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(raw[4 * a:4 * b]))
                if with_ids:
                    ids.append(tokens[a:b].astype("int64"))
        out = {"doc_id": batch.column(0).take(pa.array(row)), "piece": piece, "start": start, "length": length,
               "ids_crc32": crc}
        return out | ({"ids": ids} if with_ids else {})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run,
                     f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                     + (", ids array<long>" if with_ids else ""))


def ranked(rows: DataFrame, order: list[str], key: str = "length", out: str = "rank") -> DataFrame:
    """`out` counts the rows of each key from 0 in the order given. The rows are range-sorted and
    counted by partition, so no key has to fit in one task."""
    sorted_rows = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                          .withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    counts = (sorted_rows.groupBy(F.col(key).alias("_k"), part.alias("_p"))
              .agg(F.count("*").alias("_n"), F.min("_at").alias("_first")))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_k", "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (sorted_rows.join(shift, (F.col(key) == F.col("_k")) & (part == F.col("_p")))
            .withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_k", "_p", "_shift"))


def _sweep(lowest: int):
    """A superstep for pieces longer than `lowest`, over the runs."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for f in frames for r in f[["kind", "size", "first", "n"]].itertuples(index=False)]
        rows.sort(key=lambda r: (-r[1], r[0], r[2]))
        gaps: list[list[int]] = []
        free = 0
        out = []
        for kind, size, first, n in rows:
            if kind == GAP:
                gaps.append([size, first, n])
                free += n
                continue
            several = max(1, n // (SHARE * max(1, free)))
            while n and gaps and size > lowest:
                gap, number, count = gaps[-1]
                times = min(gap // size, several, n)
                k = min(n // times, count)
                out.append((PLACED, size, first, k, times, gap, number))
                if gap > size * times:
                    out.append((GAP, gap - size * times, number, k, 0, 0, 0))
                first, n, free = first + k * times, n - k * times, free - k
                gaps[-1][1:] = number + k, count - k
                if k == count:
                    gaps.pop()
            if n:
                out.append((PIECE, size, first, n, 0, 0, 0))
        out += [(GAP, *g, 0, 0, 0) for g in gaps]
        yield pd.DataFrame(out, columns=["kind", "size", "first", "n", "times", "gap", "bin"]).astype("int64")
    return run


def pack(rows: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """`rows` with sequence_id and offset: rows of one sequence lie gapless from 0 and hold at most
    `capacity` tokens. Ties of length go by `order`. No rows, no sequences. Lengths above the
    capacity, below 1 or null are an error of the caller: `pieces` gives none."""
    spark = rows.sparkSession
    ship(spark)
    rows = durable(ranked(rows, ["length", *order]), "ranked")
    runs = rows.groupBy(F.col("length").alias("size")).agg(F.count("*").alias("n"))
    total, full = runs.select(
        F.coalesce(F.sum(F.when(F.col("size") < capacity, F.col("size") * F.col("n"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("size") == capacity, F.col("n"))), F.lit(0))).first()

    def gaps(first: int, n: int) -> DataFrame:
        return spark.createDataFrame([(GAP, capacity, first, n, 0, 0, 0)], STATE)

    opened = -(-total // capacity)
    state = runs.where(F.col("size") < capacity).select(
        F.lit(PIECE).alias("kind"), "size", F.lit(0).cast("long").alias("first"), "n",
        *[F.lit(0).cast("long").alias(c) for c in ("times", "gap", "bin")])
    if opened:
        state = state.union(gaps(0, opened))
    placed = []
    for lowest in (capacity // 2, capacity // 4, capacity // 8, 0):
        while opened:
            state = durable(state.coalesce(1).mapInPandas(_sweep(lowest), STATE), "superstep")
            left, moved = state.select(
                F.sum(F.when((F.col("kind") == PIECE) & (F.col("size") > lowest), F.col("size") * F.col("n"))),
                F.sum((F.col("kind") == PLACED).cast("int"))).first()
            placed.append(state.where(F.col("kind") == PLACED))
            state = state.where(F.col("kind") != PLACED)
            if not left:
                break
            if not moved:
                more = -(-left // capacity)
                state = state.union(gaps(opened, more))
                opened += more
    whole = spark.createDataFrame([(PLACED, capacity, 0, full, 1, capacity, opened)], STATE)
    plan = functools.reduce(DataFrame.union, placed, whole).select(
        F.col("size").alias("_size"), "first", "n", "times", "gap", "bin")
    nth = F.col("rank") - F.col("first")
    return (rows.join(plan, (F.col("length") == F.col("_size")) & (F.col("rank") >= F.col("first"))
                      & (nth < F.col("n") * F.col("times")))
            .withColumn("sequence_id", F.col("bin") + F.floor(nth / F.col("times")))
            .withColumn("offset", capacity - F.col("gap") + F.pmod(nth, F.col("times")) * F.col("length"))
            .drop("rank", "_size", "first", "n", "times", "gap", "bin"))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """All pieces of the documents with their places: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    return pack(durable(pieces(docs, capacity, tokenizer=tokenizer), "pieces"), ["doc_id", "piece"], capacity)
