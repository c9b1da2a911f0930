"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.session import durable, ship

__all__ = ["arrow_map", "components", "discard", "durable", "fresh", "release", "ship", "table", "tokenizer_path"]


def fresh(df: DataFrame, name: str) -> str:
    """The name, longer where the table has it already."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done, once their result is written."""
    spark.sparkContext._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffle files of
    plans that are done."""
    for df in frames:
        context = df.sparkSession.sparkContext
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        release(df.sparkSession)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns named of a table; others never leave the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(batch: pa.RecordBatch, columns: tuple[str, ...], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in order, in pieces that hold `most` values or bytes of these columns, or one row."""
    size = np.zeros(batch.num_rows, "i8")
    for c in columns:
        cells = batch.column(c)
        n = pc.list_value_length(cells) if pa.types.is_list(cells.type) else pc.binary_length(cells)
        size += pc.fill_null(n, 0).to_numpy(zero_copy_only=False)
    total, at = size.cumsum(), 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(total, most + (total[at - 1] if at else 0), "right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, by: tuple[str, ...] = (), most: int = 0) -> DataFrame:
    """`mapInArrow` for a function that turns one batch into a dict of columns. Batches are bounded
    in bytes by `spark.sql.execution.arrow.maxBytesPerBatch`, so long texts come a few at a time; `by` and `most`
    cut them further, for functions that need many times the memory of their rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, by, most) if by else [whole] if whole.num_rows else []:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray))
                     else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of `edges` reaches.

    Alternating large-star and small-star rounds: every node hooks its larger neighbours, then its
    smaller ones, to the least node it sees, until the edges are stars. Each round is a grouping
    with map-side combination and a join; its edges are written to the shared folder, so no plan
    grows with the rounds and a lost executor repeats one round only. No edges, no rows."""
    pairs = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where("u <> v").distinct())
    pairs = durable(pairs, "edges")
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # large star: the larger neighbours of each node move to its least neighbour
        large = (both.join(least, F.col("u") == F.col("k")).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: a node and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = (large.join(low, F.col("u") == F.col("k"))
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        after = durable(small, "edges")
        same = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        prior = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        pairs = after
        if tuple(same) == tuple(prior):
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
