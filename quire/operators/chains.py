"""Greedy cuts of long sequences: the next cut from each place, and the cuts that a start leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quire.session import durable


def first_from(points: DataFrame, probes: DataFrame, keys: list[str], width: int) -> DataFrame:
    """`probes(keys, y, ...)` with `found`: the point of its group that comes first at or after y, null where there is
    none. `points(keys, x, ...)`; `found` has x and the other columns of a point, and of points with one x the least.

    Points and probes meet in stretches of `width` of their group; a probe whose stretch has no later point
    takes the first one of the next stretch that has any."""
    rest = [c for c in points.columns if c not in keys]
    point = F.struct("x", *[c for c in rest if c != "x"]).alias("point")
    mine = [c for c in probes.columns if c not in keys]
    probe = F.struct(*mine).alias("probe")
    stretch = lambda c: F.floor(F.col(c) / width).cast("long").alias("stretch")
    a = points.select(*keys, stretch("x"), F.col("x").alias("at"), point)
    b = probes.select(*keys, stretch("y"), F.col("y").alias("at"), probe)
    void = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = a.select(*keys, "stretch", "at", "point", void(b, "probe")).union(b.select(*keys, "stretch", "at", void(a, "point"), "probe"))
    # from the last one back: a frame that grows is summed up once, one that shrinks is gone through again for each row
    later = Window.partitionBy(*keys, "stretch").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("near", F.min("point").over(later)).filter("probe is not null")
    onward = Window.partitionBy(*keys).orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = (both.groupBy(*keys, "stretch").agg(F.min("point").alias("least"))
              .withColumn("next", F.last("least", ignorenulls=True).over(onward)).select(*keys, "stretch", "next"))
    left, cond = near.alias("l"), F.col("l.stretch") == F.col("r.stretch")
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(firsts.alias("r"), cond).select(*[F.col(f"l.{k}") for k in keys], *[F.col(f"l.probe.{c}").alias(c) for c in mine],
                                                     F.coalesce("l.near", "r.next").alias("found"))


def reached(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """The nodes that the starts lead to, themselves included. `pointers(node, next)` lead onward, one from a node
    at most. Pointers double their reach each round, so a chain of n nodes takes log2(n) rounds."""
    marks = durable(starts.select("node").distinct(), "marks")
    hops = durable(pointers.select("node", "next").filter("next is not null"), "hops")
    while True:
        new = durable(marks.join(hops, "node").select(F.col("next").alias("node")).distinct(), "marks")
        if not new.take(1):
            return marks
        marks = marks.union(new)
        onward = hops.select(F.col("node").alias("next"), F.col("next").alias("_after"))
        hops = durable(hops.join(onward, "next").select("node", F.col("_after").alias("next")), "hops")
