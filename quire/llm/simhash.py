"""SimHash near-duplicates by shards of BK-trees.

Two 64-bit fingerprints that differ in at most r bits agree on one of r + 1 blocks, so fingerprints
are dealt to shards by (block, its value) and each shard has a BK-tree of its own: the children of a
node are keyed by their Hamming distance to it, and a probe follows only the edges whose distance is
within r of its own distance to the node. A shard with too many fingerprints is dealt again by blocks
of the bits that are still free; after a few levels a shard has fewer free bits than would fill it.
The trees grow with the data, so nothing is broadcast: trees and probes meet in the shard's task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import arrow_map, components, durable, ship

BITS = 64
SHARD = 2048  # fingerprints of a tree; larger shards are dealt again


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `words` words, A-Z lower-cased; fewer words are one run."""
    from xxhash import xxh64_intdigest

    got = text.encode().lower().split() if text else []
    if not got:
        return np.empty(0, "<u8")
    if len(got) <= words:
        return np.array([xxh64_intdigest(b" ".join(got), seed)], dtype="<u8")
    runs = zip(*[got[i:] for i in range(words)])
    return np.array([xxh64_intdigest(b" ".join(r), seed) for r in runs], dtype="<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero if there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, "int64")
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. A narrow pass over whole texts; null, empty
    and blank texts have 0. Repeated rows and null ids stay."""
    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(1)], dtype="uint64")
        return {"doc_id": batch.column(0), "fp": fps.view("int64")}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


class Tree:
    """A BK-tree of integers."""

    def __init__(self):
        self.code: list[int] = []
        self.child: list[dict[int, int]] = []

    def add(self, code: int) -> int:
        new = len(self.code)
        self.code.append(code)
        self.child.append({})
        at = 0
        while new:
            d = (code ^ self.code[at]).bit_count()
            down = self.child[at].get(d)
            if down is None:
                self.child[at][d] = new
                break
            at = down
        return new

    def near(self, code: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.code else []
        while todo:
            at = todo.pop()
            d = (code ^ self.code[at]).bit_count()
            if d <= radius:
                found.append(at)
            child = self.child[at]
            if len(child) <= 2 * radius + 1:
                todo += [x for e, x in child.items() if d - radius <= e <= d + radius]
            else:
                todo += [child[e] for e in range(d - radius, d + radius + 1) if e in child]
        return found


def _forest(codes: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join the codes of a shard as all its links within the radius would: a probe that
    finds several members of one group is linked to the group once."""
    tree, root, out = Tree(), [], []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for code in codes:
        found = tree.near(code, radius)
        new = tree.add(code)
        root.append(new)
        for other in found:
            if (t := top(other)) != top(new):
                root[t] = top(new)
                out.append((code, tree.code[other]))
    return out


def _blocks(free: list[int], n: int) -> list[list[int]]:
    size, rest = divmod(len(free), n)
    cuts = np.cumsum([0, *[size + (i < rest) for i in range(n)]])
    return [free[a:b] for a, b in zip(cuts, cuts[1:])]


def links(codes: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """(a, b): pairs of distinct codes (column `fp`) that differ in at most `radius` bits, enough of
    them that every such pair is connected; at most one row a code and shard. Null codes link with
    nothing."""
    ship(codes.sparkSession)

    def trees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a shard are together and in order of shards."""
        name, codes, out = None, [], []
        for f in frames:
            for s, fp in zip(f["shard"], f["fp"]):
                if s != name:
                    out += _forest(codes, radius)
                    name, codes = s, []
                codes.append(fp & (2 ** BITS - 1))
            if len(out) > 50_000:
                yield pd.DataFrame(np.array(out, dtype="uint64").view("int64"), columns=["a", "b"])
                out = []
        out += _forest(codes, radius)
        yield pd.DataFrame(np.array(out, dtype="uint64").view("int64").reshape(-1, 2), columns=["a", "b"])

    def deal(rows: DataFrame, free: list[int], prefix: str) -> list[tuple[list[int], DataFrame]]:
        """The rows in the shards of each block, and the bits that are free in them."""
        out = []
        for i, block in enumerate(_blocks(free, radius + 1)):
            mask = sum(1 << b for b in block)
            value = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
            out.append(([b for b in free if b not in block],
                        rows.select("fp", F.xxhash64(*([F.col("shard")] if prefix else []), F.lit(prefix + str(i)), value).alias("shard"))))
        return out

    todo = [(free, rows, str(i)) for i, (free, rows) in enumerate(
        deal(codes.where("fp is not null").select("fp").distinct(), list(range(BITS)), ""))]
    found = []
    while todo:
        level = durable(_union([r.withColumn("plan", F.lit(k)) for k, (_, r, _) in enumerate(todo)]), "shards")
        sizes = level.groupBy("plan", "shard").agg(F.count("*").alias("size"))
        sized = level.join(sizes.where("size > 1"), ["plan", "shard"])
        frees = F.create_map(*[F.lit(x) for k, (free, _, _) in enumerate(todo) for x in (k, len(free))])
        # as few free bits as fill a shard are enough: it can't be larger than that
        last = frees[F.col("plan")] <= int(np.log2(shard)) + 1
        found.append(durable(sized.where((F.col("size") <= shard) | last).repartition("shard").sortWithinPartitions("shard", "fp")
                             .select("shard", "fp").mapInPandas(trees, "a long, b long"), "links"))
        large = sized.where((F.col("size") > shard) & ~last)
        plans = [r["plan"] for r in large.select("plan").distinct().collect()]
        if plans:
            large = durable(large, "shards")
        todo = [(free, rows, f"{todo[k][2]}.{i}") for k in sorted(plans)
                for i, (free, rows) in enumerate(deal(large.where(F.col("plan") == k), todo[k][0], todo[k][2] + "."))]
    return _union(found).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): one row per document. Documents whose fingerprints are connected
    by steps of at most `radius` bits have the smallest doc_id among them as component_id.

    Equal fingerprints are one node whatever their number, so a group of copies is one row in all
    that follows. A null doc_id gets its group's component_id, null if no other id is in the group.
    An empty table gives no rows."""
    rows = durable(fingerprints(docs, words), "fingerprints")
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(links(nodes, radius))
    group = (nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = group.groupBy("component").agg(F.min("least").alias("component_id"))
    named = group.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
