"""Greedy cuts, limits, running totals, the keyed store and timed streams against sequential rules."""

import os
import random
import sys
from datetime import datetime


import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.operators import bundles as B  # noqa: E402
from quire.operators.chains import first_from, reached  # noqa: E402
from quire.session import running_totals  # noqa: E402
from quire.sources import deposit as D  # noqa: E402
from quire.streaming import flows as R, store  # noqa: E402


def test_running_totals_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 4}", rng.randint(0, 400), rng.randint(-5, 9), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, o long, v long, i long").withColumn("x", F.struct("o", "i"))
    got = {r.i: (r.n, r.total) for r in running_totals(df, ["k"], "x", n=F.lit(1), total=F.col("v")).collect()}
    sums = {}
    for k, _, v, i in sorted(rows, key=lambda r: (r[1], r[3])):
        n, total = sums.get(k, (0, 0))
        sums[k] = n + 1, total + v
        assert got[i] == sums[k]


def test_first_points_and_chains(spark):
    rng = random.Random(2)
    points = [(g, rng.randint(-300, 300), i) for i, g in enumerate(rng.choices(["a", None, "b"], k=150))]
    probes = [(g, rng.randint(-400, 400), i) for i, g in enumerate(rng.choices(["a", None, "c"], k=150))]
    got = first_from(spark.createDataFrame(points, "g string, x long, p long"), spark.createDataFrame(probes, "g string, y long, q long"), ["g"], 10)
    for r in got.collect():
        want = min([(x, p) for g, x, p in points if g == r.g and x >= r.y], default=None)
        assert (tuple(r.found) if r.found else None) == want
    assert got.count() == 150
    to = {i: i + rng.randint(1, 3) for i in range(200)}
    hops = spark.createDataFrame([(i, j if j < 200 else None) for i, j in to.items()], "node int, next int")
    want, at = set(), 3
    while at < 200:
        want.add(at)
        at = to[at]
    assert {r.node for r in reached(hops, spark.createDataFrame([(3,)], "node int")).collect()} == want


def plain_lots(sizes, cap):
    lots, lot, used = [], 1, 0
    for size in sizes:
        if used > 0 and used + size > cap:
            lot, used = lot + 1, 0
        used += size
        lots.append(lot)
    return lots


def test_lots_equal_the_sequential_fill(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(12):
        sizes = [rng.choice([0, 0, 1, 5, 30, 99, 100, 101, 250]) for _ in range(rng.choice([5, 19, 20, 60, 300]))]
        lots = plain_lots(sizes, 100) if len(sizes) >= 20 else [None] * len(sizes)
        for i, (size, lot) in enumerate(zip(sizes, lots)):
            rows.append((g, i, size))
            want[g, i] = lot
    rng.shuffle(rows)
    got = D.pack_lots(spark.createDataFrame(rows, "g int, i int, size long"), "g", "i", 100)
    assert {(r.g, r.i): r.lot for r in got.collect()} == want


def test_a_quota_is_cut_in_order(spark):
    rng = random.Random(4)
    rows = [(i, f"s{rng.randint(0, 90)}", rng.random() < 0.2, rng.randint(0, 50)) for i in range(400)]
    originals = spark.createDataFrame([(i, s, "other" if bad else s, n) for i, s, bad, n in rows], "pos long, name_sha string, sha256 string, size long")
    held = spark.createDataFrame([(f"s{i}",) for i in range(0, 90, 4)], "sha256 string")
    total, want = 7, {}
    for i, s, bad, n in rows:
        early = "there" if int(s[1:]) % 4 == 0 and int(s[1:]) < 90 else "mismatch" if bad else None
        total += 0 if early else n
        want[i] = ("stopped" if total > 2000 else early or "uploaded", total)
    assert {r.pos: (r.state, r.total) for r in D.migrate(originals, held, 2000, used=7).collect()} == want


def plain_runs(moments, quiet, wait):
    runs = []
    for m in sorted(moments):
        if runs and m < min(runs[-1][1] + quiet, runs[-1][0] + wait):
            runs[-1] = (runs[-1][0], m, runs[-1][2] + 1)
        else:
            runs.append((m, m, 1))
    return runs


def test_quiet_runs_are_cut_at_the_maximum_wait(spark):
    rng = random.Random(5)
    moments = {"steady": [10 * i for i in range(30)], "hot": [rng.randint(0, 20_000) for _ in range(3000)], "rare": [0, 20, 39, 500], None: [5, 5, 6]}
    rows = [(k, datetime.fromtimestamp(m)) for k, ms in moments.items() for m in ms]
    rng.shuffle(rows)
    got = R.quiet_batches(spark.createDataFrame(rows, "k string, at timestamp"), "k", "at", 20, 180).collect()
    seconds = lambda t: int(t.timestamp())
    for k, ms in moments.items():
        mine = sorted((seconds(r["first"]), seconds(r["last"]), r["changes"]) for r in got if r["k"] == k)
        assert mine == plain_runs(ms, 20, 180)
        assert all(seconds(r["process_at"]) == min(seconds(r["last"]) + 20, seconds(r["first"]) + 180) for r in got if r["k"] == k)
    assert len([r for r in got if r["k"] == "steady"]) == 2


def test_the_next_cut_is_found_by_frames_that_grow(spark):
    """A frame that shrinks is gone through again for each row, quadratic in the points of a stretch."""
    rng = random.Random(15)
    points = [("a", rng.randint(0, 30_000)) for _ in range(2000)] + [("b", 7), ("b", 900_000)]
    probes = [(k, rng.randint(-500, 31_000)) for k in "ab" for _ in range(500)]
    out = first_from(spark.createDataFrame(points, "k string, x long"), spark.createDataFrame(probes, "k string, y long"), ["k"], 4000)
    want = {(k, y): min((x for g, x in points if g == k and x >= y), default=None) for k, y in probes}
    assert {(r.k, r.y): r.found and r.found.x for r in out.collect()} == want
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_busy_session_is_settled_in_blocks(spark):
    """One key never rests, over many blocks; also events at one moment and null keys."""
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "k1", None]), rng.randint(0, 60_000), i) for i in range(4000)]
    df = spark.createDataFrame([(k, datetime.fromtimestamp(t), i) for k, t, i in rows], "k string, at timestamp, n long")
    kept, want = {}, {}
    for k, t, i in sorted(rows, key=lambda r: r[1:]):
        live = [x for x in kept.get(k, []) if x >= t - 300]
        want[i] = len(live) < 5
        kept[k] = live + [t] if want[i] else live
    assert {r.n: r.allowed for r in R.rate_limit(df, "k", "at", "n", 300, 5).collect()} == want and not all(want.values())


def test_the_keyed_store(spark, tmp_path):
    folder, rng = str(tmp_path / "store"), random.Random(7)
    schema = "k long, v string, at long, n long"
    best, n = {}, 0
    for batch in range(12):
        rows = []
        for _ in range(40):
            k, at = rng.choice([None, *range(60)]), rng.randint(0, 100)
            rows.append((k, rng.choice(["x", None, "y"]), at, n := n + 1))
            if k not in best or (at, n) > best[k][1:]:
                best[k] = (rows[-1][1], at, n)
        df = spark.createDataFrame(rows, schema)
        assert store.upsert(folder, df, ["k"], "at", "n") > 0 and store.upsert(folder, df, ["k"], "at", "n") == 0
    got = store.read(spark, folder, df.schema)
    assert sorted(((r.k, r.v, r.at, r.n) for r in got.collect()), key=str) == sorted(((k, *v) for k, v in best.items()), key=str)
    version, before = store.folders(spark, folder)
    one = spark.createDataFrame([(3, "new", 1000, n + 1)], schema)
    assert version == 12 and store.upsert(folder, one, ["k"], "at", "n") == 1
    after = store.folders(spark, folder)[1]
    assert sum(after[b] != before.get(b) for b in after) == 1
    assert store.read(spark, str(tmp_path / "none"), df.schema).count() == 0


def _feed(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_streams_give_out_what_is_over(spark, tmp_path):
    at = lambda s: datetime.fromtimestamp(100_000 + s)
    changes = [[("a", at(10 * i)) for i in range(15)], [("a", at(10 * i)) for i in range(15, 30)], [("z", at(9000))], [("z", at(9900))]]
    stream = _feed(spark, tmp_path / "q", changes, "k string, at timestamp").withWatermark("at", "1 second")
    out = R.drain(R.quiet_batches_stream(stream, "k", "at"), str(tmp_path / "qo"), str(tmp_path / "qs")).collect()
    assert sorted(r.changes for r in out if r.k == "a") == [12, 18]
    parts = [[("t", 1, 2, 5, at(0)), ("u", 1, 2, 5, at(0)), ("u", 1, 2, 5, at(1))], [("t", 2, 2, 6, at(50))], [("t", 1, 2, 5, at(60))],
             [("v", 1, 3, 1, at(5000))], [("w", 1, 1, 2, at(9000))]]
    schema = "target string, part int, expected int, size long, at timestamp"
    stream = _feed(spark, tmp_path / "p", parts, schema).withWatermark("at", "1 second")
    out = R.drain(R.waiting_parts(stream, "at", 100), str(tmp_path / "po"), str(tmp_path / "ps")).collect()
    assert sorted((r.target, r.have, r.bytes, r.expired) for r in out) == [("t", 2, 11, False), ("u", 1, 5, True), ("v", 1, 1, True), ("w", 1, 2, False)]


def test_names_of_mixed_families_equal_the_sequential_rule(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for group in ("g", "h", None):
        taken = set()
        for i in range(220):
            base = "-".join(["x", *(str(rng.choice([1, 2, 2, 3, 4, 5, 12])) for _ in range(rng.choice([0, 0, 1, 1, 2, 3])))])
            base = rng.choice([base, base, "y", "y-2", "y-02"])
            i = len(rows)
            rows.append((i, group, base + ".pdf"))
            chosen, n = base, 2
            while chosen in taken:
                chosen, n = f"{base}-{n}", n + 1
            taken.add(chosen)
            want[i] = chosen + ".pdf"
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "id long, g string, name string")
    assert {r.id: r.filed_name for r in B.unique_names(df, ["g"]).collect()} == want


def test_parts_are_completed_over_batches_by_joins(spark, tmp_path):
    parts = [[("t", 1, 2, 5), ("u", 1, 2, 5), ("u", 1, 2, 5), (None, 1, 1, 4)], [("t", 2, 2, 6), ("t", 1, 2, 99), ("v", 1, 3, 1)], [("t", 3, 2, 5), ("v", 2, 3, 1)],
             [("v", 3, 3, 1), ("w", 1, 0, 1)]]
    stream = _feed(spark, tmp_path, parts, "target string, part int, expected int, size long")
    for _ in ("first", "again"):  # nothing new comes, nothing changes
        out = R.complete_parts(stream, str(tmp_path / "o"), str(tmp_path / "s"))
        assert sorted(map(str, out.collect())) == sorted(["Row(target='t', have=2, bytes=11)", "Row(target='v', have=3, bytes=3)", "Row(target=None, have=1, bytes=4)"])
