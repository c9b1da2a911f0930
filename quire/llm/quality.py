"""Quality rules: fixed limits, then robust outliers by language and source.

Texts that pass the limits become vectors of transformed statistics. Each language and source has a
minimum-covariance-determinant estimate: from coordinate-wise medians, concentration steps keep the
share of rows nearest to the estimate and fit it anew, until its determinant stops falling. A row
far from its group's estimate is rejected. Groups are aggregated with map-side combination and never
gathered, so a source that holds a third of all rows is one row of sums a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import durable, ship
from quire.llm.stats import with_statistics

MIN_WORDS, MAX_REPEAT = 20, 30
SHARE = 0.75  # of a group's rows that a concentration step keeps
FEWEST = 200  # rows for an estimate of one's own
LIMIT = 85.0  # squared Mahalanobis distance; beyond 1e-14 under normality, for tails are heavier
# Transformed statistics: expression, and the least standard deviation that a group is given.
VECTOR = {
    "word_length": (lambda: F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)), 0.08),
    "symbols": (lambda: F.sqrt(F.col("n_symbols") / F.col("word_chars")), 0.03),
    "upper": (lambda: F.sqrt(F.col("n_upper") / (F.col("n_upper") + F.col("n_lower") + 1)), 0.05),
    "shouts": (lambda: F.sqrt(F.col("n_shouts") / F.col("word_chars")), 0.04),
    "dup_lines": (lambda: F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), 0.12),
    "repeats": (lambda: F.sqrt(F.col("n_repeat_words") / F.col("n_words")), 0.12),
    "variety": (lambda: F.log(F.col("n_distinct")) / F.log(F.col("n_words") + 1), 0.02),
}
P = len(VECTOR)
FLOOR = [floor for _, floor in VECTOR.values()]
MEDIAN = P * (1 - 2 / (9 * P)) ** 3  # of the squared distance under normality


def _distance() -> Column:
    """Squared Mahalanobis distance of `x` from `mu` under `inverse`."""
    d = [F.col("x")[i] - F.col("mu")[i] for i in range(P)]
    return sum((F.col("inverse")[i * P + j] * d[i] * d[j] * (1 if i == j else 2)
                for i in range(P) for j in range(i, P)), F.lit(0.0))


def _fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean, inverse covariance and log determinant from the sums of a group's kept rows."""
    for f in frames:
        rows = []
        for key, n, sums, squares in zip(f["key"], f["n"], f["sums"], f["squares"]):
            mu = np.asarray(sums) / n
            cov = np.asarray(squares).reshape(P, P) / n - np.outer(mu, mu) + np.diag(np.square(FLOOR))
            rows.append((key, mu, np.linalg.inv(cov).ravel(), np.linalg.slogdet(cov)[1]))
        yield pd.DataFrame(rows, columns=["key", "mu", "inverse", "logdet"])


BROADCAST = 10_000  # estimates, of about 600 bytes each


FITTED = "key string, mu array<double>, inverse array<double>, logdet double"


def _beside(groups: DataFrame) -> DataFrame:
    """A written table of groups, sent to the rows while it is small: a join by group would gather those
    of a hot one. With more groups none is that large, or adaptive execution splits it."""
    return F.broadcast(groups) if groups.count() <= BROADCAST else groups


def estimates(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """(key, mu, inverse, scale): the estimate of each key of `rows` (key, x). `scale` brings the
    median of the squared distances to where it would be under normality. Concentration steps go on until
    no determinant falls; one that does not keeps the estimate before, so they come to an end."""
    ship(rows.sparkSession)
    start = rows.groupBy("key").agg(*[F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(P)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in range(P)]
    fit = durable(start.select(
        "key", F.array(*[F.col(f"q{i}")[1] for i in range(P)]).alias("mu"),
        F.array(*[1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)]).alias("inverse"),
        F.lit(float("inf")).alias("logdet")), "estimate")
    near = F.percentile_approx("d", F.lit(share), F.lit(1000))
    few = fit.count() <= BROADCAST
    beside = F.broadcast if few else lambda df: df
    while True:
        far = rows.join(beside(fit), "key").select("key", "x", "logdet", _distance().alias("d"))
        cut = far.groupBy("key").agg(near.alias("cut"))
        kept = far.join(beside(cut), "key").where(F.col("d") <= F.col("cut"))
        sums = kept.groupBy("key").agg(
            F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(P)]).alias("sums"),
            F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(P) for j in range(P)]).alias("squares"))
        after = durable(sums.mapInPandas(_fit, FITTED), "estimate")
        both = after.alias("a").join(fit.alias("b"), F.col("a.key") == F.col("b.key"))
        falls = F.col("a.logdet") < F.col("b.logdet") - 1e-6
        step = durable(both.select("a.key", *[F.when(falls, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("mu", "inverse", "logdet")],
                                   falls.alias("falls")), "estimate")
        fit = step.drop("falls")
        if not step.where("falls").take(1):
            break
    middle = (rows.join(beside(fit), "key").groupBy("key").agg(
        F.percentile_approx(_distance(), F.lit(0.5), F.lit(1000)).alias("middle")))
    return durable(fit.join(middle, "key").select("key", "mu", "inverse",
                                                  F.greatest(F.col("middle") / MEDIAN, F.lit(1.0)).alias("scale")), "estimate")


def judged(docs: DataFrame, limit: float = LIMIT, fewest: int = FEWEST) -> DataFrame:
    """One row per document: its doc_id, the counts of `stats.COLUMNS`, base_failed, distance and kept.

    Null and empty texts have no words and fail. Null languages and sources are groups like others.
    Rows of groups with under `fewest` passing texts are judged with their language's other small
    groups; are these too few, by the estimate of the whole language, then by that of all rows that pass;
    only where the whole table has too few all are kept. Repeated rows are judged alike. Only
    doc_id, lang, source and text are read."""
    rows = with_statistics(docs.select("doc_id", "lang", "source", "text"), "doc_id", "lang", "source")
    rows = durable(rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                                   | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))), "statistics")
    fine = rows.where(~F.col("base_failed"))
    n = fine.groupBy("lang", "source").agg(F.count("*").alias("n"))
    langs = n.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum(F.when(F.col("n") < fewest, F.col("n"))).alias("n_small"))
    label = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    whole = label(F.col("lang").alias("whole"))
    names = (n.join(langs.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
             .withColumn("key", F.when(F.col("n") >= fewest, label("lang", "source")).when(F.col("n_small") >= fewest, label("lang"))
                         .when(F.col("n_lang") >= fewest, whole).otherwise("{}"))
             .select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "key",
                     F.when((F.col("n_small") < fewest) & (F.col("n_lang") >= fewest), whole).alias("whole")))
    names = durable(names, "names")
    rest = F.when(F.lit(bool(names.where("key = '{}'").take(1))), "{}")
    # the estimates that a row of the group counts in: its own, its language's and that of all, where some group needs them
    names = _beside(names.select("_l", "_s", "key", F.array_distinct(F.array_compact(F.array("key", "whole", rest))).alias("counts_in")))
    keyed = fine.join(names, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    keyed = durable(keyed.select("doc_id", *[c for c in rows.columns if c not in ("doc_id", "lang", "source")], "key", "counts_in",
                                 F.array(*[f() for f, _ in VECTOR.values()]).alias("x")), "vectors")
    counted = keyed.select(F.explode("counts_in").alias("key"), "x")
    enough = _beside(durable(counted.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") >= fewest).select("key"), "enough"))
    fit = estimates(counted.join(enough, "key", "left_semi"))
    far = (keyed.join(_beside(fit), "key", "left").withColumn("distance", _distance() / F.col("scale"))
           .withColumn("kept", F.coalesce(F.col("distance") <= limit, F.lit(True))))
    failed = rows.where("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    columns = [c for c in rows.columns if c not in ("lang", "source")] + ["distance", "kept"]
    return far.select(*columns).union(failed.select(*columns))
