"""Queries over events: limits, quiet periods, reconciliation, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.session import shared_dir, table
from quire.streaming import flows as R, store

WINDOW, MAXIMUM = 6 * 3600, 3


def _named(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


def rate_window(spark, sf):
    return R.attempts_in_window(_named(spark, sf), "user_id", "ts", WINDOW).select("event_id", "attempts")


RATE_WINDOW_SQL = """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR
PRECEDING AND CURRENT ROW) AS attempts FROM events"""


def rate_limit(spark, sf):
    return R.rate_limit(_named(spark, sf), "user_id", "ts", "event_id", WINDOW, MAXIMUM)


RATE_LIMIT_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
 AS rn FROM events),
r AS (SELECT user_id, event_id, rn, true AS allowed, [ts] AS kept FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_id, e.rn, len(list_filter(kept, lambda k: k >= e.ts - INTERVAL 6 HOUR)) < 3,
    CASE WHEN len(list_filter(kept, lambda k: k >= e.ts - INTERVAL 6 HOUR)) < 3
      THEN list_append(list_filter(kept, lambda k: k >= e.ts - INTERVAL 6 HOUR), e.ts)
      ELSE list_filter(kept, lambda k: k >= e.ts - INTERVAL 6 HOUR) END
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, allowed FROM r"""


def rate_limit_stream(spark, sf):
    base = shared_dir(spark, "limit")
    stream = R.stream_table(spark, sf, "events").select("event_id", "ts", "user_id")
    flags = R.rate_limit_stream(stream, "user_id", "ts", "event_id", WINDOW, MAXIMUM)
    return R.drain(flags, f"{base}/out", f"{base}/state")


def quiet_sessions(spark, sf):
    return R.quiet_batches(_named(spark, sf), "event_type", "ts", 300, 1800)


QUIET_SQL = """WITH RECURSIVE e AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events),
r AS (SELECT event_type, rn, ts, ts AS start, 1 AS run FROM e WHERE rn = 1
  UNION ALL SELECT e.event_type, e.rn, e.ts, CASE WHEN e.ts >= least(r.ts + INTERVAL 300 SECOND, start + INTERVAL 1800 SECOND) THEN e.ts ELSE start END,
    CASE WHEN e.ts >= least(r.ts + INTERVAL 300 SECOND, start + INTERVAL 1800 SECOND) THEN run + 1 ELSE run END
  FROM r JOIN e ON e.event_type = r.event_type AND e.rn = r.rn + 1)
SELECT event_type, min(ts) AS first, max(ts) AS last, count(*) AS changes, least(max(ts) + INTERVAL 300 SECOND, min(ts) + INTERVAL 1800 SECOND) AS process_at
FROM r GROUP BY event_type, run"""


def latest_mark(spark, sf):
    return R.latest(_named(spark, sf), ["user_id", "event_type"], "ts", "event_id")


LATEST_SQL = """SELECT user_id, event_type, event_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""


def reconcile_stream(spark, sf):
    """The events as a stream of records, run twice over one store."""
    base = shared_dir(spark, "reconcile")
    for run in ("first", "second"):
        stream = R.stream_table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
        R.reconcile_stream(stream, f"{base}/store", f"{base}/{run}", ["user_id", "event_type"], "ts", "event_id")
    return store.read(spark, f"{base}/store", _named(spark, sf).schema).select("user_id", "event_type", "event_id", "ts", "value")


def waiting_parts(spark, sf):
    """Order lines as parts that arrive in a stream; an order is complete when as many lines are there as
    its customer number asks for."""
    base = shared_dir(spark, "parts")
    stream = R.stream_table(spark, sf, "lineitem")
    parts = stream.select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("part"),
                          (F.col("l_orderkey") % 4 + 1).cast("int").alias("expected"),
                          F.lit(10).alias("size"))
    return R.complete_parts(parts, base, f"{base}/state")


PARTS_SQL = """SELECT l_orderkey AS target, count(DISTINCT l_linenumber) AS have, count(DISTINCT l_linenumber) * 10 AS bytes
FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= l_orderkey % 4 + 1"""


def deposit_stream(spark, sf):
    """The library folder watched as a deposit: each table file is an item."""
    base = shared_dir(spark, "watch")
    seen = R.watch_folder(spark, sf)
    name = F.substring_index("path", "/", -1)
    return R.drain(seen.select(name.alias("name"), "size", "sha256"), f"{base}/out", f"{base}/state")


def settle_batches(spark, sf):
    """Orders as batches, lines as their files."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")  # noqa: E741
    file = F.concat(F.lit("d"), "l_suppkey", F.lit("/"), "l_partkey")
    pending = l.select(F.col("l_orderkey").alias("batch"), file.alias("file")).distinct()
    waiting = o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("batch"))
    failed = l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("batch"), F.concat(
        F.lit("d"), "l_suppkey").alias("name"))
    return R.settle(pending, failed, waiting)


SETTLE_SQL = """WITH p AS (SELECT DISTINCT l_orderkey AS batch, 'd' || l_suppkey::VARCHAR || '/' || l_partkey::VARCHAR AS file,
  l_suppkey FROM lineitem)
SELECT batch, file, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN (batch, l_suppkey) IN (SELECT (l_orderkey, l_suppkey)
  FROM lineitem WHERE l_returnflag = 'R') THEN 'failed' ELSE 'sent' END AS state FROM p LEFT JOIN orders ON o_orderkey = batch"""


def publish_due(spark, sf):
    o = table(spark, sf, "orders")
    now = F.col("o_orderdate") + F.expr("interval 20 minutes")
    due = R.publish_due(now, F.col("o_orderpriority"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")),
                        F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderdate")), F.col("o_orderstatus") == "F")
    return o.select("o_orderkey", due.alias("due"))


PUBLISH_SQL = """SELECT o_orderkey, o_custkey % 3 <> 0 AND (o_custkey % 5 = 0 OR o_orderstatus <> 'F') AS due FROM orders"""


QUERIES = {
    "rate_window": (rate_window, RATE_WINDOW_SQL),
    "rate_limit": (rate_limit, RATE_LIMIT_SQL),
    "rate_limit_stream": (rate_limit_stream, RATE_LIMIT_SQL),
    "quiet_sessions": (quiet_sessions, QUIET_SQL),
    "latest_mark": (latest_mark, LATEST_SQL),
    "reconcile_stream": (reconcile_stream, LATEST_SQL),
    "waiting_parts_stream": (waiting_parts, PARTS_SQL),
    "deposit_stream": (deposit_stream, None),
    "settle_batches": (settle_batches, SETTLE_SQL),
    "publish_due": (publish_due, PUBLISH_SQL),
}
