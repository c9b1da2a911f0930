"""A table of records kept up to date by key: the newest record of each key, whatever order they come in.

Keys are hashed to BUCKETS buckets, each a folder of files. An upsert reads the buckets that its rows touch,
merges them, writes those that change to new folders and then adds a version: the folder of
every bucket. Readers take the latest version, so they see all of an upsert or nothing; one that is repeated
changes nothing, and one that fails before its version leaves files that nobody reads."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quire.session import durable, row_digest

BUCKETS = 64
SALTS = 8  # tasks that write a bucket
_VERSIONS = "version long, bucket int, folder string"


def newest(records: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    """The record of each key that was written last."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, order)).alias("r")).select(*keys, "r.*")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def folders(spark: SparkSession, store: str) -> tuple[int, dict[int, str]]:
    """The latest version and the folder of each of its buckets, BUCKETS at most."""
    path = os.path.join(store, "versions")
    if not _there(spark, path):
        return 0, {}
    listed = spark.read.schema(_VERSIONS).parquet(path)
    last = listed.agg(F.max("version")).first()[0]
    return last or 0, {r["bucket"]: r["folder"] for r in listed.filter(F.col("version") == last).collect()}


def read(spark: SparkSession, store: str, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
    now = folders(spark, store)[1]
    paths = [f for b, f in sorted(now.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def upsert(store: str, records: DataFrame, keys: list[str], at: str, order: str) -> int:
    """Bring the records in; returns how many buckets were replaced. Of two records of a key the one with
    the larger (at, order) stays; null keys are keys."""
    spark = records.sparkSession
    new = durable(newest(records, keys, at, order).select(*records.columns), "upsert")
    touched = [r[0] for r in new.select(_bucket(keys)).distinct().collect()]  # BUCKETS at most
    version, now = folders(spark, store)
    stored = read(spark, store, records.schema, touched)
    tag = row_digest(*[F.col(c) for c in records.columns if c not in keys])
    merged = durable(newest(stored.union(new), keys, at, order).select(*records.columns).withColumn("key_bucket", _bucket(keys)), "merged")
    # buckets whose rows are no longer those that are stored, by a digest that combines in any order
    figure = lambda df: df.groupBy("key_bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*keys, tag)).alias("x"))
    was = {r[0]: (r[1], r[2]) for r in figure(stored.withColumn("key_bucket", _bucket(keys))).collect()}
    changed = [r[0] for r in figure(merged).collect() if was.get(r[0]) != (r[1], r[2])]
    if not changed:
        return 0
    path = os.path.join(store, "data", f"{version + 1}-{time.time_ns()}-{os.urandom(4).hex()}")
    rows = merged.filter(F.col("key_bucket").isin(changed))
    (rows.repartition(max(1, len(changed)) * SALTS, "key_bucket", F.pmod(F.hash(*keys), F.lit(SALTS)))
     .write.partitionBy("key_bucket").parquet(path))
    now = now | {b: f"{path}/key_bucket={b}" for b in changed}
    spark.createDataFrame([(version + 1, b, f) for b, f in sorted(now.items())], _VERSIONS).coalesce(1).write.mode("append").parquet(
        os.path.join(store, "versions"))
    return len(changed)
