"""Session defaults and the few helpers that every operator shares."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "quire", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A table of the library; `heavy` spreads a small one over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if heavy else df


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer partitions than cores (a few large row groups) one per core, for the
    heavy text work after it. A large table has enough partitions and passes unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pinned(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Compute columns once per row. A lambda that mentions an expensive column would otherwise
    get its whole expression inlined and run it for every element; a one-row generator ends that."""
    cells = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return (df.select(*keep, F.explode(cells).alias("_pinned"))
            .select(*keep, *[F.col(f"_pinned.{n}").alias(n) for n in columns]))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's checkpoint folder. Where none is set, a local session takes a
    local folder; executors of a cluster could not share one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return os.path.join(base, f"{purpose}-{os.urandom(6).hex()}")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"spark-{purpose}-")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context: its functions run there."""
    context = spark.sparkContext
    if getattr(context, "_shipped_quire", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    to = tempfile.mkdtemp(prefix="spark-package-")
    shutil.copytree(package, os.path.join(to, "quire"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(to, "quire-package"), "zip", to, "quire"))
    context._shipped_quire = True


def durable(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Cut the lineage by writing the rows to the shared folder and reading them back: computed
    once, columnar, and still there when executors are lost."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_within(df: DataFrame, keys: list[str], order: str, out: str = "rn") -> DataFrame:
    """`row_number()` per key group, ordered by the column `order` of any type that sorts, without ever
    sorting a whole group in one task.

    The rows are range-sorted by key and order, a hot key over several partitions; the rows of a key
    are counted by partition and each row's place is shifted by the counts before its partition.
    """
    spot = F.monotonically_increasing_id()
    staged = durable(df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).withColumn("_at", spot), "sorted")
    part = F.shiftright("_at", 33)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (staged.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
             .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1))
    # null-safe on the keys, so that a group with a null key is numbered too
    left, right = staged.withColumn("_part", part).alias("l"), sizes.alias("r")
    cond = F.col("l._part") == F.col("r._part")
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, cond).select(*[F.col(f"l.{c}") for c in df.columns],
                                         (F.col("_at") + F.col("_shift")).cast("long").alias(out))


def running_totals(df: DataFrame, keys: list[str], order: str, **values: Column) -> DataFrame:
    """`df` with running totals of the values per key group, each row included, in the order of the column
    `order`; rows equal in it come in any order. No group meets in one task: the rows are range-sorted, summed
    within their partitions, and shifted by the totals of the partitions before."""
    staged = durable(df.withColumns({f"_v_{n}": v for n, v in values.items()}).repartitionByRange(*keys, order)
                     .sortWithinPartitions(*keys, order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    staged = staged.withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = staged.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in values]).select(
        *keys, "_part", *[F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in values])
    inner = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = staged.select(*df.columns, "_part", *[F.sum(f"_v_{n}").over(inner).alias(f"_v_{n}") for n in values]).alias("l")
    right, cond = shifts.alias("r"), F.col("l._part") == F.col("r._part")
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return summed.join(right, cond).select(*[F.col(f"l.{c}") for c in df.columns],
                                           *[(F.col(f"l._v_{n}") + F.col(f"r._s_{n}")).alias(n) for n in values])


def row_digest(*cols: Column) -> Column:
    """SHA-256 of a row, nulls kept apart from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.array_join(F.array(*parts), "\u001f"), 256)


def digest_words(digest: Column) -> list[Column]:
    """The eight 32-bit words of a SHA-256 hex digest."""
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
            for i in range(8)]


def set_digest(digest: Column) -> Column:
    """Aggregate: an order-free digest of a multiset of row digests. It combines map-side, so no
    group is ever collected."""
    sums = [F.coalesce(F.sum(w), F.lit(0)).cast("string") for w in digest_words(digest)]
    return F.sha2(F.concat_ws("-", F.count(digest).cast("string"), *sums), 256)
