"""Structured Streaming forms of the deposit, the reconciliation and the attempt limits."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions import names as N
from quire.operators.chains import first_from, reached
from quire.session import durable, pinned, row_digest, running_totals
from quire.sources.deposit import file_digests
from quire.streaming import store
from quire.streaming.store import newest

BATCH_ITEMS = 10
QUIET_SECONDS, MAX_WAIT_SECONDS = 20, 180


# --- sources --------------------------------------------------------------------------------------


def watch_folder(spark: SparkSession, path: str, per_batch: int = BATCH_ITEMS) -> DataFrame:
    """New files of a folder, ten per micro-batch; the checkpoint keeps sent files from being resent
    and junk names stay out."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch)
             .option("recursiveFileLookup", "true").load(path))
    name = F.substring_index("path", "/", -1)
    return file_digests(files.filter(~N.is_junk(name) & ~name.rlike("^\\.")), path)


def stream_table(spark: SparkSession, folder: str, name: str, per_batch: int = BATCH_ITEMS) -> DataFrame:
    """A table of the library, one file or a folder of part files, as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
            .parquet(f"{folder}/{name}.parque[t]"))  # a pattern may also name one file


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there and read back what it wrote."""
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


# --- attempts -------------------------------------------------------------------------------------


def attempts_in_window(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Attempts of the key in the window before each event (itself counted): the upper bound that the
    exact limit works on.

    A busy key is cut into time buckets of the window's length: a window covers its own bucket and
    the one before, so every event goes to two buckets and no key meets in one task.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    span = seconds * 1_000_000
    bucket = F.floor(t / span)
    rows = events.withColumn("_t", t).select("*", F.explode(F.array(
        F.struct(bucket.alias("b"), F.lit(True).alias("own")),
        F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")))).alias("_x"))
    w = Window.partitionBy(key, "_x.b").orderBy("_t").rangeBetween(-span, 0)
    return (rows.withColumn("attempts", F.count("*").over(w)).filter("_x.own").drop("_x", "_t"))


def idle_sessions(events: DataFrame, key: str, at: str, seconds: int, inclusive: bool = False) -> DataFrame:
    """`events` with a session number per key: a session ends when the key rests for longer than the
    window (`inclusive`: as long as it), and nothing before a rest can matter after it.

    Rests show in the first and last event of the time buckets: a bucket goes on with a session if the one right before
    it ends near enough. The numbers are running totals, so no key is ordered in one task.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    span = seconds * 1_000_000
    rows = events.withColumn("_t", t).withColumn("_b", F.floor(F.col("_t") / span))
    edges = rows.groupBy(key, "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    prior = edges.select(F.col(key).alias("_key"), (F.col("_b") + 1).alias("_next"), F.col("_last").alias("_prior"))
    gap = F.col("_first") - F.col("_prior")
    rest = F.coalesce(gap >= span if inclusive else gap > span, F.lit(True))
    flagged = edges.join(prior, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_next")), "left").select(key, "_b", rest.alias("_rest"))
    numbered = running_totals(flagged, [key], "_b", session=F.when(F.col("_rest"), 1).otherwise(0)).select(
        F.col(key).alias("_key"), F.col("_b").alias("_at"), "session")
    return rows.join(numbered, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_at"))).drop("_b", "_t", "_key", "_at")


BLOCK_WINDOWS = 8  # windows of time in a block of a busy session


def _allowed(moments: list[int], kept: list[int], span: int, maximum: int) -> tuple[list[int], list[int]]:
    """Places of the moments that are allowed after the allowed ones in `kept`, and those that count on."""
    out, i = [], 0
    while i < len(moments):
        kept = [k for k in kept if k >= moments[i] - span]
        if len(kept) < maximum:
            kept.append(moments[i])
            out.append(i)
            i += 1
        else:  # none until the first of them is out of the window
            i = bisect_right(moments, kept[0] + span, i)
    return out, kept


def rate_limit(events: DataFrame, key: str, at: str, order: str, seconds: int, maximum: int) -> DataFrame:
    """`allowed` per event: refused when `maximum` allowed attempts lie in the window before it; refused
    attempts are not counted. Sessions of a key do not touch each other. One in which no window holds over
    `maximum` attempts is allowed as a whole. The others are cut into blocks of time that are settled side by side,
    each from the allowed moments that the block before it leaves, at first none. Blocks that turn out to
    begin with others are settled anew, round by round, until every block begins as the one before it ends."""
    counted = durable(attempts_in_window(idle_sessions(events.select(key, at, order), key, at, seconds), key, at, seconds), "attempts")
    busy = counted.filter(F.col("attempts") > maximum).select(F.col(key).alias("_key"), F.col("session").alias("_session")).distinct()
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("session") == F.col("_session"))
    calm = counted.join(busy, same, "left_anti").select(key, order, F.lit(True).alias("allowed"))
    span = seconds * 1_000_000
    t = F.unix_micros(F.col(at).cast("timestamp"))
    rows = counted.join(busy, same, "left_semi").select(key, "session", F.floor(t / (span * BLOCK_WINDOWS)).alias("block"), F.struct(t.alias("t"), order).alias("e"))
    blocks = durable(rows.groupBy(key, "session", "block").agg(F.array_sort(F.collect_list("e")).alias("events")), "blocks")
    at_start = F.col("events")[0]["t"]

    def left(moments: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([_allowed(list(m), list(k), span, maximum)[1] for m, k in zip(moments, before)])

    def places(moments: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([_allowed(list(m), list(k), span, maximum)[0] for m, k in zip(moments, before)])

    after = F.pandas_udf(left, "array<bigint>")(F.col("events.t"), F.col("before"))
    none = F.array().cast("array<bigint>")
    first = durable(blocks.withColumn("before", none).select(key, "session", "block", at_start.alias("starts"), "before", after.alias("after")), "ends")
    ends, in_order = first, Window.partitionBy(key, "session").orderBy("block")
    while True:
        # what still counts at the first event of a block
        handed = F.filter(F.coalesce(F.lag("after").over(in_order), none), lambda k: k >= F.col("starts") - span)
        linked = durable(ends.withColumn("_handed", handed).withColumn("_new", F.col("_handed") != F.col("before")), "ends")
        if not linked.filter("_new").take(1):
            break
        again = linked.filter("_new").select(F.col(key).alias("_key"), F.col("session").alias("_session"), F.col("block").alias("_block"),
                                             F.col("_handed").alias("before"))
        settled = blocks.join(again, same & (F.col("block") == F.col("_block"))).select(
            key, "session", "block", at_start.alias("starts"), "before", after.alias("after"))
        ends = durable(linked.filter("not _new").select(*first.columns).unionByName(settled), "ends")
    known = ends.select(F.col(key).alias("_key"), F.col("session").alias("_session"), F.col("block").alias("_block"), "before")
    taken = F.pandas_udf(places, "array<int>")(F.col("events.t"), F.col("before"))
    exact = (pinned(blocks.join(known, same & (F.col("block") == F.col("_block"))), [key, "events"], taken=taken)
             .select(key, "taken", F.posexplode("events").alias("i", "e"))
             .select(key, F.col(f"e.{order}").alias(order), F.array_contains("taken", F.col("i")).alias("allowed")))
    return calm.unionByName(exact)


def rate_limit_stream(events: DataFrame, key: str, at: str, order: str, seconds: int, maximum: int) -> DataFrame:
    """The exact limit on a stream: the allowed moments of the window are the state of a key."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    span = pd.Timedelta(seconds=seconds)

    def step(keys, batches, state: GroupState):
        kept = [pd.Timestamp(v, unit="us") for v in (state.get[0] if state.exists else [])]
        rows = pd.concat(list(batches)).sort_values([at, order])
        flags = []
        for moment in rows[at]:
            kept = [k for k in kept if k >= moment - span]
            ok = len(kept) < maximum
            if ok:
                kept.append(moment)
            flags.append(ok)
        state.update(([int(k.value // 1000) for k in kept],))
        yield rows[[key, order]].assign(allowed=flags)

    return events.select(key, at, order).groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean", "kept array<bigint>", "append",
        GroupStateTimeout.NoTimeout)


# --- waiting parts and quiet periods --------------------------------------------------------------


def waiting_parts(parts: DataFrame, at: str | None = None, wait: int | None = None) -> DataFrame:
    """target, have, bytes as soon as the last part is there. `parts(target, part, expected, size)`; parts
    that still wait are the state, and a repeated part counts once.

    With `at`, the watermarked time of a part, and `wait`, a target whose parts are not all there so many seconds after
    its first one gives a row with `expired`; then, as for complete targets, nothing of it is kept. A
    complete target is remembered until that time, so that parts that come again do not count anew."""
    kind = {f.name: f.dataType.simpleString() for f in parts.schema}["target"]
    timed = wait is not None

    def row(keys, have, sizes, expired):
        out = {"target": [keys[0]], "have": [len(have)], "bytes": [sum(sizes)]}
        return pd.DataFrame(out | ({"expired": [expired]} if timed else {}))

    def step(keys, batches, state: GroupState):
        have, sizes, done, until = state.get if state.exists else ([], [], False, None)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield row(keys, have, sizes, True)
            return
        seen, expected = dict(zip(have, sizes)), None
        for pdf in batches:
            for part in pdf.itertuples():
                seen.setdefault(int(part.part), int(part.size))
                expected = int(part.expected)
                if timed:
                    moment = int(getattr(part, at).timestamp() * 1000) + wait * 1000
                    until = moment if until is None else min(until, moment)
        if done:
            seen = {}
        ready = not done and expected is not None and len(seen) >= expected > 0
        done = bool(done or ready)
        state.update(([], [], done, until) if done else (list(seen), list(seen.values()), done, until))
        if timed:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if ready:
            yield row(keys, seen, seen.values(), False)

    return parts.groupBy("target").applyInPandasWithState(
        step, f"target {kind}, have bigint, bytes bigint" + (", expired boolean" if timed else ""),
        "have array<bigint>, sizes array<bigint>, done boolean, until bigint", "append",
        GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)


def complete_parts(parts: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """`waiting_parts` without a time over everything that is there, for many targets: the parts of each micro-batch are
    added to a log below `folder`, and the targets that they came for are counted over the log by joins, no target by
    itself. Each target is given out once, by the batch that completes it. A batch writes folders of its own, so a
    replayed one changes nothing."""
    kind = {f.name: f.dataType.simpleString() for f in parts.schema}["target"]
    log, out = f"{folder}/parts", f"{folder}/complete"
    rows_of = f"target {kind}, part bigint, size bigint, expected bigint, batch bigint"
    found = f"target {kind}, have bigint, bytes bigint"

    def step(batch: DataFrame, number: int) -> None:
        spark, same = batch.sparkSession, F.col("target").eqNullSafe(F.col("_target"))
        (batch.groupBy("target", F.col("part").cast("long").alias("part"))
         .agg(F.first("size").cast("long").alias("size"), F.max("expected").cast("long").alias("expected"))
         .write.mode("overwrite").parquet(f"{log}/batch={number}"))
        known = spark.read.schema(rows_of).parquet(log).filter(F.col("batch") <= number)
        if number:
            came = known.filter(F.col("batch") == number).select(F.col("target").alias("_target")).distinct()
            done = spark.read.schema(f"{found}, batch bigint").parquet(out).filter(F.col("batch") < number).select(F.col("target").alias("_target"))
            known = known.join(came, same, "left_semi").join(done, same, "left_anti")
        # a repeated part counts as it came first
        (known.groupBy("target", "part").agg(F.min_by("size", "batch").alias("size"), F.max("expected").alias("expected"))
         .groupBy("target").agg(F.count("*").alias("have"), F.sum("size").alias("bytes"), F.max("expected").alias("_expected"))
         .filter("have >= _expected and _expected > 0").drop("_expected").write.mode("overwrite").parquet(f"{out}/batch={number}"))

    (parts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    return parts.sparkSession.read.schema(f"{found}, batch bigint").parquet(out).drop("batch")


def quiet_batches(changes: DataFrame, key: str, at: str, quiet: int = QUIET_SECONDS,
                  max_wait: int = MAX_WAIT_SECONDS) -> DataFrame:
    """Runs of changes of a key, first, last, changes and when each would be processed: after a rest of `quiet` seconds, or
    `max_wait` seconds after its first change; what comes from then on is the next run.

    The first change of the next run is found for every moment of a long session, and the runs are the moments that
    these pointers lead to from the session's first one."""
    t, wait = F.unix_micros(F.col(at).cast("timestamp")), max_wait * 1_000_000
    times = durable(idle_sessions(changes.select(key, at), key, at, quiet, inclusive=True).groupBy(key, "session", t.alias("t")).agg(
        F.count("*").alias("n"), F.min(at).alias("moment")), "moments")
    whole = times.groupBy(key, "session").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    node = lambda c: F.struct(F.col(key).alias("k"), c.alias("t"))
    long = whole.filter(F.col("_last") - F.col("_first") >= wait).select(F.col(key).alias("_key"), F.col("session").alias("_session"))
    rows = durable(times.join(long, F.col(key).eqNullSafe(F.col("_key")) & (F.col("session") == F.col("_session")), "left_semi")
                   .select(key, "session", "t"), "long")
    onward = first_from(rows.withColumnRenamed("t", "x"), rows.withColumn("y", F.col("t") + wait), [key, "session"], wait)
    starts = rows.groupBy(key, "session").agg(F.min("t").alias("t"))
    cuts = reached(onward.select(node(F.col("t")).alias("node"), F.when(F.col("found").isNotNull(), node(F.col("found.x"))).alias("next"))
                   .filter("next is not null"), starts.select(node(F.col("t")).alias("node")))
    begins = whole.select(node(F.col("_first")).alias("node")).union(cuts).distinct().select(
        F.col("node.k").alias("_key"), F.col("node.t").alias("_begin"))
    marked = times.join(begins, F.col(key).eqNullSafe(F.col("_key")) & (F.col("t") == F.col("_begin")), "left").select(
        key, "t", "n", "moment", F.when(F.col("_begin").isNotNull(), 1).otherwise(0).alias("_starts"))
    runs = running_totals(marked, [key], "t", run=F.col("_starts")).groupBy(key, "run").agg(
        F.min("moment").alias("first"), F.max("moment").alias("last"), F.sum("n").alias("changes"))
    settled = F.least(F.col("last") + F.expr(f"interval {quiet} seconds"), F.col("first") + F.expr(f"interval {max_wait} seconds"))
    return runs.select(key, "first", "last", "changes", settled.alias("process_at"))


def quiet_batches_stream(changes: DataFrame, key: str, at: str, quiet: int = QUIET_SECONDS, max_wait: int = MAX_WAIT_SECONDS) -> DataFrame:
    """`quiet_batches` of a watermarked stream: a run is given out once the watermark has passed its time. The
    state of a key is the changes behind its last run."""
    kind = {f.name: f.dataType.simpleString() for f in changes.schema}[key]

    def step(keys, batches, state: GroupState):
        held = list(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            for pdf in batches:
                held += [int(m.value // 1000) for m in pdf[at]]
        held.sort()
        mark, out, run = state.getCurrentWatermarkMs() * 1000, [], []
        due = lambda: min(run[-1] + quiet * 1_000_000, run[0] + max_wait * 1_000_000)
        for moment in held:
            if run and moment >= due():
                out.append((run[0], run[-1], len(run), due()))
                run = []
            run.append(moment)
        if run and due() <= mark:
            out.append((run[0], run[-1], len(run), due()))
            run = []
        # only a run behind the watermark can't grow any more
        ready = [r for r in out if r[3] <= mark]
        kept = [m for m in held if not ready or m > ready[-1][1]]
        if kept:
            state.update((kept,))
            state.setTimeoutTimestamp(max(kept[0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if ready:
            a, b, n, due_at = zip(*ready)
            yield pd.DataFrame({key: [keys[0]] * len(ready), "first": pd.to_datetime(a, unit="us"), "last": pd.to_datetime(b, unit="us"),
                                "changes": n, "process_at": pd.to_datetime(due_at, unit="us")})

    return changes.select(key, at).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, first timestamp, last timestamp, changes bigint, process_at timestamp", "held array<bigint>", "append",
        GroupStateTimeout.EventTimeTimeout)


# --- reconciliation and publishing ----------------------------------------------------------------


def settle(pending: DataFrame, outcomes: DataFrame, waiting: DataFrame) -> DataFrame:
    """batch, file, state: batches still in the deposit wait; the files of the others were sent or failed.
    `pending(batch, file)`, `outcomes(batch, name)` lists failures, `waiting(batch)`."""
    still = waiting.select("batch", F.lit(True).alias("_w")).distinct()
    failed = outcomes.select("batch", F.col("name").alias("_n"), F.lit(True).alias("_f")).distinct()
    rows = pending.withColumn("_top", F.substring_index("file", "/", 1)).join(still, "batch", "left")
    rows = rows.select("*", F.explode(F.array_distinct(F.array("_top", "file"))).alias("_n")).join(
        failed, ["batch", "_n"], "left")
    state = F.when(F.bool_or(F.coalesce("_w", F.lit(False))), "pending").when(F.bool_or(F.coalesce(
        "_f", F.lit(False))), "failed").otherwise("sent")
    return rows.groupBy("batch", "file").agg(state.alias("state"))


latest = newest


def changed_only(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    columns = sorted(c for c in new.columns if c not in keys)
    tag = lambda df: row_digest(*[F.col(c) for c in columns])
    old = stored.select(*keys, tag(stored).alias("_old"))
    return new.withColumn("_new", tag(new)).join(old, keys, "left").filter(
        F.col("_old").isNull() | (F.col("_old") != F.col("_new"))).drop("_old", "_new")


def reconcile_stream(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], at: str, order: str) -> None:
    """Upsert a stream into a keyed store (`quire.streaming.store`); a replayed batch or a second run changes nothing."""
    (stream.writeStream.foreachBatch(lambda batch, _: store.upsert(folder, batch, keys, at, order) and None)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def publish_due(now: Column, key: Column, published_key: Column, last_try: Column, failed: Column,
                every: int = 300, retry: int = 1800) -> Column:
    """Publish when the inputs changed and the pause is over: five minutes, half an hour after a failure."""
    pause = F.when(F.coalesce(failed, F.lit(False)), retry).otherwise(every)
    over = last_try.isNull() | (F.unix_timestamp(now) >= F.unix_timestamp(last_try) + pause)
    return ~key.eqNullSafe(published_key) & over
