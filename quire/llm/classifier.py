"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic
calibration.

The cosine of random projections of the standardised statistics approximates a Gaussian kernel; a
ridge regression on them is a fixed number of sums. Every task sums the products of its rows, Spark
adds the sums by cell, and the driver solves a system whose size is the number of features. The
scores of rows that were not fitted are counted in a fixed number of bins and pooled until they rise
with the score. All labelled rows that may be used are used; nothing grows with them but the sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import arrow_map, durable, ship
from quire.llm.stats import COLUMNS, with_statistics

FEATURES = 128  # random cosines
BINS = 4096  # of the calibration
WIDTH = 2.5  # of the kernel, in standard deviations of a statistic
RIDGE = 1e-3  # of the number of rows
TIES = 0.002  # share of the raw score that keeps the order within a calibrated step
THRESHOLD = 0.7


def inputs(row: dict[str, np.ndarray]) -> np.ndarray:
    """Bounded transforms of the counts, a column each. Language, source and ids are no inputs."""
    c = {k: np.asarray(v, "float64") for k, v in row.items()}
    words, chars = c["n_words"] + 1, c["word_chars"] + 1
    share = lambda k, of: np.sqrt(c[k] / of)
    return np.stack([
        np.log(words), np.log(chars / words), np.log(c["longest"] + 1), np.log(words / (c["n_lines"] + 1)),
        share("n_symbols", chars), share("n_shouts", chars), share("n_marks", chars), share("n_digits", c["n_bytes"] + 1),
        share("n_stops", chars), share("n_upper", c["n_upper"] + c["n_lower"] + 1),
        share("n_dup_lines", c["n_lines"] + 1), share("n_repeat_words", words),
        np.log(c["n_distinct"] + 1) / np.log(words + 1),
        share("n_lower", c["n_bytes"] + 1)], axis=1)


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    at: np.ndarray | None = None  # raw scores and what they are calibrated to, both rising
    to: np.ndarray | None = None

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -5, 5)
        wave = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.projection + self.phase)
        return np.hstack([wave, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.cosines(x) @ self.weights, -1, 2) if self.weights is not None else np.full(len(x), 0.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if self.at is None:
            return np.clip(raw, 0, 1)
        return (1 - TIES) * np.interp(raw, self.at, self.to) + TIES * (raw + 1) / 3


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4))


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool neighbours until the share of ones rises: mean score and share of each block. A block is
    given one more row of either label, so no share is 0 or 1."""
    blocks: list[list[float]] = []
    for a, k, y in zip(at, n, ones):
        blocks.append([a * k, k, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    share = np.maximum.accumulate([(y + (y / k)) / (k + 1) for _, k, y in blocks])
    return np.array([s / k for s, k, _ in blocks]), np.asarray(share)


def _numpy(f: pd.DataFrame) -> np.ndarray:
    return inputs({c: f[c].to_numpy() for c in COLUMNS})


def fit(rows: DataFrame, seed: int = 5) -> Model:
    """`rows`: COLUMNS, y (0 or 1) and `calibrate`, true where a row is kept from the fit for the
    calibration. Without fitted rows every score is 0.5."""
    ship(rows.sparkSession)
    rng = np.random.default_rng(seed)
    p = inputs({c: np.zeros(1) for c in COLUMNS}).shape[1]
    model = Model(np.zeros(p), np.ones(p), rng.normal(size=(p, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES))

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, p))
        for f in frames:
            x = _numpy(f)
            total += np.stack([np.full(p, len(x)), x.sum(axis=0), np.square(x).sum(axis=0)])
        yield pd.DataFrame({"i": range(p), "n": total[0], "s": total[1], "q": total[2]})

    fitted = rows.where(~F.col("calibrate"))
    sums = fitted.mapInPandas(moments, "i int, n double, s double, q double").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").toPandas()
    if not len(sums) or not sums["n"].iloc[0]:
        return model
    n = sums["n"].to_numpy()
    model.centre = sums["s"].to_numpy() / n
    model.spread = np.sqrt(np.maximum(sums["q"].to_numpy() / n - np.square(model.centre), 1e-6))

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for f in frames:
            z = model.cosines(_numpy(f))
            total += z.T @ np.hstack([z, f["y"].to_numpy("float64")[:, None]])
        i, j = np.triu_indices(FEATURES + 1, m=FEATURES + 2)
        if total.any():
            yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    cells = fitted.mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    full = np.zeros((FEATURES + 1, FEATURES + 2))
    full[cells["i"], cells["j"]] = cells["v"]
    left, right = full[:, :-1], full[:, -1]
    left = np.triu(left) + np.triu(left, 1).T
    model.weights = np.linalg.solve(left + RIDGE * n[0] * np.diag([1.0] * FEATURES + [0.0]) + 1e-9 * np.eye(FEATURES + 1), right)

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = model.raw(_numpy(f))
            yield pd.DataFrame({"bin": ((raw + 1) / 3 * (BINS - 1)).round().astype("int64"), "y": f["y"].astype("int64"),
                                "raw": raw})

    bins = (rows.where("calibrate").mapInPandas(binned, "bin long, y long, raw double").groupBy("bin")
            .agg(F.count("*").alias("n"), F.sum("y").alias("ones"), F.avg("raw").alias("at")).orderBy("bin").toPandas())
    if len(bins):
        model.at, model.to = isotonic(*(bins[c].to_numpy("float64") for c in ("at", "n", "ones")))
    return model


def scored(statistics: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns to keep and the score of each row of statistics."""
    fields = {c: statistics.schema[c].dataType.simpleString() for c in keep}

    def run(batch: pa.RecordBatch) -> dict:
        x = inputs({c: batch.column(c).to_numpy() for c in COLUMNS})
        return {c: batch.column(c) for c in keep} | {"score": model.score(x)}

    schema = ", ".join(f"`{c}` {k}" for c, k in fields.items())
    return arrow_map(statistics.select(*keep, *COLUMNS), run, f"{schema}, score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document, null and empty texts too.

    Labels of rows whose crc32(doc_id) mod 4 is 2 are never read; 0 and 1 are fitted, 3 calibrates.
    Null labels and null ids teach nothing; a document labelled twice teaches twice. A null doc_id
    is not held out. Texts are scanned once and never shuffled."""
    rows = durable(with_statistics(docs.select("doc_id", "text"), "doc_id"), "statistics")
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").alias("y"))
    known = known.where(fold("_id") != 2)
    taught = durable(rows.join(known, F.col("doc_id") == F.col("_id"))
                     .select(*COLUMNS, F.col("y").cast("int").alias("y"), (fold() == 3).alias("calibrate")), "taught")
    return (scored(rows, fit(taught), "doc_id")
            .select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
