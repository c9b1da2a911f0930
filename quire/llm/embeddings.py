"""Embedding near-duplicates by product quantisation.

A coarse quantiser deals unit vectors to inverted lists; what is left of a vector after its list's
centre is coded by the nearest centroids of its subspaces. A query vector visits the lists with the
nearest centres, reads its distances to the coded vectors from a table of
its distances to the subspace centroids, and the survivors are compared exactly in double precision.

Vectors of each length have quantisers of their own, fitted on a bounded sample; all rows are coded. The number of lists follows the
number of rows, so a list keeps its size; a list that is too long is met by its visitors in parts.
Equal vectors are one entry with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import components, durable, ship

COSINE = 0.95
SAMPLE = 20_000  # rows that the quantisers are fitted on, at most
LIST = 128  # vectors of a list, about
SUBSPACES, CENTROIDS, ROUNDS = 8, 64, 12
PROBES = 6  # lists that a vector visits
SLACK = 0.4  # how far a table distance may be above the distance sought
PART = 2048  # vectors of a list that a task holds at a time


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = x[rng.integers(len(x), size=int((n == 0).sum()))]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(p, centres).argmin(1) for p in np.array_split(x, len(x) // 4096 + 1)])


class Quantiser:
    """Coarse centres and subspace centroids, fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.centres = _kmeans(sample, lists, rng)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.spans = list(zip(cuts, cuts[1:]))
        self.books = [_kmeans(rest[:, a:b], CENTROIDS, rng) for a, b in self.spans]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _nearest(x, self.centres)
        rest = x - self.centres[at]
        return at, np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self.spans, self.books)], 1).astype("uint8")

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, k = _distances(x, self.centres), min(PROBES, len(self.centres))
        return np.repeat(np.arange(len(x)), k), np.argpartition(d, k - 1, axis=1)[:, :k].ravel()

    def table_distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of each x to each coded vector of list `at`, from tables."""
        rest = x - self.centres[at]
        out = np.zeros((len(x), len(codes)))
        for k, ((a, b), book) in enumerate(zip(self.spans, self.books)):
            out += _distances(rest[:, a:b], book)[:, codes[:, k]]
        return out


def _unit(raw: pd.Series, dim: int) -> np.ndarray:
    x = np.array(raw.tolist(), dtype="float64").reshape(-1, dim)
    x /= np.abs(x).max(1, keepdims=True)  # lengths that over- or underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(quantisers: dict[int, Quantiser], cosine: float):
    """Visitors against entries of a part of a list: how many vectors each visitor links with there, and
    links to the first of those that hang together, a row a vector at most."""
    reach = (np.sqrt(2 - 2 * cosine) + SLACK) ** 2

    def some(q: Quantiser, x: np.ndarray, who: np.ndarray, at: int, y: np.ndarray, entries: pd.DataFrame, codes: np.ndarray) -> pd.DataFrame:
        ids = entries["node"].to_numpy()
        i, j = np.nonzero(q.table_distances(x, at, codes) <= reach)
        keep = np.concatenate([np.einsum("ij,ij->i", x[a], y[b]) >= cosine for a, b in zip(
            np.array_split(i, len(i) // 65536 + 1), np.array_split(j, len(i) // 65536 + 1))])
        i, j = i[keep], j[keep]
        i, j = i[who[i] != ids[j]], j[who[i] != ids[j]]
        n = np.bincount(i, entries["n"].to_numpy()[j], len(who)).astype("int64")
        of, near = np.arange(len(ids)), np.full(len(who), len(ids))
        while True:
            np.minimum.at(near, i, of[j])
            before = of.copy()
            np.minimum.at(of, j, near[i])
            if (of == before).all():
                break
        found, moved = np.nonzero(n)[0], np.nonzero(of != np.arange(len(ids)))[0]
        return pd.DataFrame({"a": np.concatenate([who[found], ids[moved]]), "b": np.concatenate([ids[near[found]], ids[of[moved]]]),
                             "n": np.concatenate([n[found], np.zeros(len(moved), "int64")])})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        entries, visitors = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
        out = [pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")]
        if len(entries) and len(visitors):
            dim = int(rows["dim"].iloc[0])
            y, x = _unit(entries["embedding"], dim), _unit(visitors["embedding"], dim)
            codes = np.array([np.frombuffer(c, "uint8") for c in entries["code"]])
            for part in np.array_split(np.arange(len(visitors)), len(visitors) // 512 + 1):
                out.append(some(quantisers[dim], x[part], visitors["node"].to_numpy()[part], int(visitors["list"].iloc[0]), y, entries, codes))
        return pd.concat(out)
    return run


def linked(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: its key, n_links (other rows with a cosine of at least `cosine`), component_id
    (the smallest key reached by links) and kept (the key is that).

    Null and zero vectors and vectors with null or non-finite components link with nothing; vectors
    link with those of their own length. Rows that repeat link with each
    other. A null key counts as a link of others and is never a component_id; its own component_id is
    its group's, else null. An empty table gives no rows."""
    spark = vectors.sparkSession
    ship(spark)
    good = (F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists(vector, lambda v: v != 0))
    rows = durable(vectors.select(F.col(key).alias("key"), F.col(vector).alias("embedding"), F.coalesce(good, F.lit(False)).alias("good")), "vectors")
    nodes = (rows.where("good").groupBy("embedding").agg(F.min("key").alias("least"), F.count("*").alias("n"))
             .withColumn("dim", F.size("embedding")))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    dims = nodes.groupBy("dim").count().orderBy("dim").collect()
    pairs = None
    if dims:
        quantisers = {}
        for dim, n in dims:
            # a sample by hash, so that it is the same for the same rows
            sample = (nodes.where(F.col("dim") == dim).select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE)
                      .toPandas()["embedding"])
            quantisers[dim] = Quantiser(_unit(sample, dim), max(1, min(n // LIST, len(sample) // 4)))

        def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for dim, rows in f.groupby("dim"):
                    q = quantisers[int(dim)]
                    for some in np.array_split(np.arange(len(rows)), len(rows) // 1024 + 1):
                        g = rows.iloc[some]
                        if not len(g):
                            continue
                        x = _unit(g["embedding"], int(dim))
                        at, codes = q.code(x)
                        who, where = q.visits(x)
                        yield pd.DataFrame({"dim": dim, "list": at, "kind": 0, "node": g["node"], "n": g["n"], "embedding": g["embedding"],
                                            "code": [c.tobytes() for c in codes]})
                        yield pd.DataFrame({"dim": dim, "list": where, "kind": 1, "node": g["node"].to_numpy()[who], "n": 0,
                                            "embedding": g["embedding"].to_numpy()[who], "code": None})

        kind = nodes.schema["embedding"].dataType.simpleString()
        dealt = durable(nodes.select("dim", "node", "n", "embedding").repartition("node").mapInPandas(
            deal, f"dim int, list int, kind int, node long, n long, embedding {kind}, code binary"), "lists")
        sizes = dealt.groupBy("dim", "list").agg(F.sum((F.col("kind") == 0).cast("long")).alias("entries"), F.sum("kind").alias("visitors"))
        parts = lambda c: F.ceil(F.col(c) / PART)
        sized = dealt.join(sizes.where("entries > 0 and visitors > 0").withColumnsRenamed({"dim": "_dim", "list": "_list"}),
                           (F.col("dim") == F.col("_dim")) & (F.col("list") == F.col("_list")))
        # an entry is in one part of its list and meets all parts of the visitors, and the reverse
        spot = F.pmod(F.xxhash64("node"), F.when(F.col("kind") == 0, parts("entries")).otherwise(parts("visitors")))
        other = F.sequence(F.lit(0).cast("long"), F.when(F.col("kind") == 0, parts("visitors")).otherwise(parts("entries")) - 1)
        spread = (sized.withColumn("own", spot).withColumn("other", F.explode(other))
                  .withColumn("e", F.when(F.col("kind") == 0, F.col("own")).otherwise(F.col("other")))
                  .withColumn("v", F.when(F.col("kind") == 0, F.col("other")).otherwise(F.col("own"))))
        pairs = durable(spread.select("dim", "list", "kind", "node", "n", "embedding", "code", "e", "v").groupBy("dim", "list", "e", "v")
                        .applyInPandas(_compare(quantisers, cosine), "a long, b long, n long"), "links")
    if pairs is None:
        pairs = spark.createDataFrame([], "a long, b long, n long")
    # an entry is in one list, so a visitor meets it once
    counts = pairs.groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("others"))
    joined = components(pairs)
    group = (nodes.join(joined.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
             .select("node", "least", F.coalesce("component", "node").alias("component")))
    least = group.groupBy("component").agg(F.min("least").alias("component_id"))
    named = (nodes.select("node", "embedding", "n").join(group.select(F.col("node").alias("_n"), "component"), F.col("node") == F.col("_n"))
             .join(least, "component").join(counts, F.col("node") == F.col("_a"), "left")
             .select(F.col("embedding").alias("_e"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"))
    found = rows.where("good").join(named, F.col("embedding") == F.col("_e")).select("key", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("key", F.lit(0).cast("long"), F.col("key"))
    out = found.union(alone)
    return out.select(F.col("key").alias(key), "n_links", "component_id",
                      F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
