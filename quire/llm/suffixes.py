"""Removal of long repeated byte strings with run-length indexes.

Every window of LENGTH bytes has a mark: the least hash of the K-byte strings in it. Equal windows
have equal marks, so only windows whose mark occurs again can repeat; the home of a mark is the
smallest doc_id that has it. A home's windows are indexed in run-length form, and the windows of the
other documents with the same marks are streamed through the index: where the longest match reaches
LENGTH bytes, the home has the string earlier. Windows that the home does not have are compared with
each other by an exact check. Windows of one mark meet at its home only, so a match is never later.

A home that very many documents share is dealt over several tasks: each has the home's index and a
part of the streams, and the windows left over meet in a grouping by hash over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import arrow_map, discard, durable, fresh, release, ship
from quire.llm.rindex import RunIndex
from quire.session import number_within

LENGTH = 100
K = 32  # bytes of a hashed string; a window has LENGTH - K + 1
CHUNK = 1 << 20  # bytes hashed at a time
INDEXED = 1 << 21  # bytes of an index
STREAMED = 1 << 22  # bytes streamed at a time, and a hot home's share for a task
TASK = 6 << 20  # bytes for a task, about
STRIDE = 1024  # windows of a pattern

_ODD = np.random.default_rng(11).integers(1 << 62, size=(2, 16), dtype="uint64") * np.uint64(2) + np.uint64(1)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    return np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _hashes(data: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of the `size` bytes from each place on."""
    words, n = _words(data), len(data) - size + 1
    out = np.zeros(n, "uint64")
    for j, at in enumerate([*range(0, size - 8, 8), size - 8]):
        out += _mixed(words[at:at + n] * _ODD[which, j])
    return _mixed(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo("uint64").max, "uint64")
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def marks_of(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """(mark, first, last, times): runs of window starts with one mark, chunk by chunk, and at how many
    places the string of the mark is the first of the least ones in a window of the run."""
    whole = np.frombuffer(data, "uint8")
    place = np.uint64((CHUNK << 1) - 1)
    for at in range(0, len(whole) - length + 1, CHUNK):
        hashes = _hashes(whole[at:at + CHUNK + length - 1], K)
        least = _least(hashes & ~place | np.arange(len(hashes), dtype="uint64"), length - K + 1) & place
        mark = hashes[least.astype("int64")]
        moves = np.append(True, least[1:] != least[:-1])
        first = np.nonzero(np.append(True, mark[1:] != mark[:-1]))[0]
        yield mark[first], at + first, at + np.append(first[1:], len(mark)) - 1, np.add.reduceat(moves.astype("int64"), first)


def marks(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(mark, doc_id, first, last, times) of all texts of at least `length` bytes; a narrow pass."""
    def run(batch: pa.RecordBatch) -> dict:
        found, rows = [], []
        for i, text in enumerate(batch.column(1)):
            data = (text.as_py() or "").encode()
            if len(data) >= length:
                for part in marks_of(data, length):
                    found.append(part)
                    rows.append(np.full(len(part[0]), i))
        if not found:
            return {"mark": [], "doc_id": [], "first": [], "last": [], "times": []}
        mark, first, last, times = (np.concatenate(x) for x in zip(*found))
        return {"mark": mark.view("int64"), "doc_id": batch.column(0).take(pa.array(np.concatenate(rows))),
                "first": first, "last": last, "times": times}

    return arrow_map(docs.where("doc_id is not null").select("doc_id", "text"), run,
                     "mark long, doc_id long, first int, last int, times int")


def segments(docs: DataFrame, cuts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(home, doc_id, first, data): the bytes that the windows of `cuts` (doc_id, cuts: array of first,
    last, home) cover, neighbours of one home as one segment."""
    def run(batch: pa.RecordBatch) -> dict:
        out = {"home": [], "doc_id": [], "first": [], "data": []}
        for doc, text, cuts in zip(*(batch.column(c).to_pylist() for c in range(3))):
            data = (text or "").encode()
            at = None
            for first, last, home in [*sorted({(c["first"], c["last"], c["home"]) for c in cuts}), (None, None, None)]:
                if at and (home != at[2] or first != at[1] + 1):
                    out["home"].append(at[2])
                    out["doc_id"].append(doc)
                    out["first"].append(at[0])
                    out["data"].append(data[at[0]:at[1] + length])
                    at = None
                at = (at[0] if at else first, last, home) if home is not None else None
        return out

    joined = docs.where("doc_id is not null").join(cuts.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"))
    return arrow_map(joined.select("doc_id", "text", "cuts"), run, "home long, doc_id long, first long, data binary")


def _windows(data: list[bytes], length: int, which: int = 0) -> np.ndarray:
    """Hashes of the windows of each segment, one segment after the other."""
    return np.concatenate([_hashes(np.frombuffer(d, "uint8"), length, which) for d in data] or [np.empty(0, "uint64")])


def matched(references: list[bytes], streams: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Whether each window of the streams occurs in the references: a run-length index of these gives
    the place of a longest match for each byte of the streams, and the bytes there are compared."""
    parts = [r[a:a + INDEXED + length - 1] for r in references for a in range(0, len(r) - length + 1, INDEXED)]
    starts = [np.arange(0, len(d) - length + 1, STRIDE) for d in streams]
    base = np.cumsum([0, *[len(d) for d in streams]])
    begin = np.concatenate([s + b for s, b in zip(starts, base)])
    end = np.minimum(begin + STRIDE + length - 1, np.repeat(base[1:], [len(s) for s in starts]))
    # patterns overlap by a window less a byte, so each has bytes of its own
    size = end - begin
    own = np.cumsum(size)
    raw = np.frombuffer(b"".join(streams), "uint8")
    text = raw[np.repeat(begin - (own - size), size) + np.arange(own[-1])]
    inside = np.arange(own[-1]) < np.repeat(own - length + 1, size)  # a window begins here
    hashes = np.zeros(len(text), "uint64")
    hashes[:len(text) - length + 1] = _hashes(text, length)
    found = np.zeros(len(text), bool)
    while parts:
        some = [parts.pop()]
        while parts and sum(map(len, some)) + len(parts[-1]) <= INDEXED:
            some.append(parts.pop())
        index = RunIndex(some)
        place = index.stream(text, own, size)
        there = np.zeros(index.begins[-1] + len(some[-1]) + 1, "uint64")
        valid = np.zeros(len(there), bool)
        for b, t in zip(index.begins, some):
            there[b:b + len(t) - length + 1] = _hashes(np.frombuffer(t, "uint8"), length)
            valid[b:b + len(t) - length + 1] = True
        at = np.nonzero(inside & (place >= 0))[0]
        found[at] |= valid[place[at]] & (there[place[at]] == hashes[at])
    return found[inside]


def _repeats(key: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows with the key of an earlier one; rows are in the order of doc and first."""
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    least = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.zeros(len(key), bool)
    out[order] = (doc[order] != doc[least]) | (first[order] != first[least])
    return out


def _runs(doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring window starts as doc, first, last."""
    order = np.lexsort((first, doc))
    doc, first = doc[order], first[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (first[1:] > first[:-1] + 1))[:len(doc)]
    at = np.nonzero(new)[0]
    return doc[at], first[at], first[np.append(at[1:], len(doc)) - 1] if len(at) else first[:0]


FOUND = "doc_id long, first long, last long, h1 long, h2 long"


def _settle(length: int):
    """Rows (home, part, parts, doc_id, first, data) of whole homes, in this order, to removed runs of
    window starts; for homes in several parts also the windows left over, with two hashes."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "first", "last", "h1", "h2")])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: (r[3], r[4]))
        rows = [r for r in rows if len(r[5]) >= length]
        own = [r for r in rows if r[0] == r[3]]
        others = [r for r in rows if r[0] != r[3]]
        seen = {r[0] for r in own}
        size = lambda some: np.array([len(r[5]) - length + 1 for r in some], "int64")
        hit = {}
        streams = [r for r in others if r[0] in seen]
        if streams:
            homes = {r[0] for r in streams}
            flags = matched([r[5] for r in own if r[0] in homes], [r[5] for r in streams], length)
            hit = dict(zip(map(id, streams), np.split(flags, np.cumsum(size(streams))[:-1])))
        n = size(rows)
        doc = np.repeat(np.array([r[3] for r in rows], "int64"), n)
        first = np.concatenate([r[4] + np.arange(k) for r, k in zip(rows, n)] or [np.empty(0, "int64")])
        gone = np.concatenate([hit.get(id(r), np.zeros(k, bool)) for r, k in zip(rows, n)] or [np.empty(0, bool)])
        shared = np.repeat(np.array([r[2] > 1 for r in rows], bool), n)
        # a hot home's own windows are left over in its first part only
        again = np.repeat(np.array([r[0] == r[3] and r[1] > 0 for r in rows], bool), n)
        data = [r[5] for r in rows]
        h1 = _windows(data, length)
        near = np.nonzero(~gone & ~shared)[0]
        gone[near] = _repeats(h1[near], doc[near], first[near])
        left = np.nonzero(shared & ~gone & ~again)[0]
        a, b, c = _runs(doc[gone & ~again], first[gone & ~again])
        h2 = _windows(data, length, 1) if len(left) else h1
        none = np.zeros(len(a), bool)
        cols = [np.concatenate([a, doc[left]]), np.concatenate([b, first[left]]), np.concatenate([c, first[left]])]
        mask = np.concatenate([~none, np.zeros(len(left), bool)])
        h = [np.concatenate([np.zeros(len(a), "int64"), x[left].view("int64")]) for x in (h1, h2)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols] + [pa.array(x, mask=mask) for x in h], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, home = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (row[0], row[1]) != home and held > STREAMED:
                    yield batch_of(rows)
                    rows, held = [], 0
                home = (row[0], row[1])
                rows.append(row)
                held += len(row[5])
        if rows:
            yield batch_of(rows)
    return run


def sums_of(docs: DataFrame) -> DataFrame:
    """(doc_id, size, sum) of each row with an id and a text."""
    return durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("sum"))
                   .where("doc_id is not null and size is not null"), "sums")


def removed(docs: DataFrame, length: int = LENGTH, sums: DataFrame | None = None) -> DataFrame:
    """(doc_id, runs): the byte ranges [start, end) of each document that are covered by strings of
    `length` bytes which also start earlier, as a sorted array without overlaps. Copies of a whole
    text are one text to the index: the later ones are removed without it. A doc_id has one text."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sums = (sums_of(docs) if sums is None else sums).where(F.col("size") >= length)
    groups = sums.groupBy("sum").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = durable(sums.join(groups, "sum").where("doc_id > least").select("doc_id", "size").distinct(), "copies")
    found = durable(marks(docs, length), "marks")
    again = (found.groupBy("mark").agg(F.sum("times").alias("n"), F.min("doc_id").alias("home")).where("n > 1")
             .select(F.col("mark").alias("_mark"), "home"))
    again = durable(again, "again")  # a table, so that adaptive execution can split a hot mark in the join
    release(spark)
    cuts = (found.join(again, F.col("mark") == F.col("_mark"))
            .groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "home")).alias("cuts"))
            .join(copies.select("doc_id"), "doc_id", "left_anti"))
    cuts = durable(cuts, "cuts")
    discard(found, again)
    parts = durable(segments(docs, cuts, length), "segments")
    discard(cuts)
    sizes = parts.groupBy("home").agg(
        F.sum(F.when(F.col("doc_id") != F.col("home"), F.octet_length("data")).otherwise(0)).alias("streamed"))
    hot = sizes.where(F.col("streamed") > STREAMED).select(F.col("home").alias("_home"), F.ceil(F.col("streamed") / STREAMED).alias("parts"))
    total = parts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    dealt = parts.join(hot, F.col("home") == F.col("_home"), "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    own = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("doc_id") == F.col("home"), own).otherwise(
        F.array(F.pmod(F.xxhash64("doc_id", "first"), F.col("parts"))))))
    settled = durable(dealt.select("home", "part", "parts", "doc_id", "first", "data")
                      .repartition(max(1, -(-total // TASK)), "home", "part").sortWithinPartitions("home", "part", "doc_id", "first")
                      .mapInArrow(_settle(length), FOUND), "settled")
    discard(parts)
    left = settled.where("h1 is not null")
    least = (left.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "first")).alias("least"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "least"))
    late = (left.join(least, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
            .where(F.struct("doc_id", "first") != F.col("least")).select("doc_id", "first", "last"))
    spans = (settled.where("h1 is null").select("doc_id", "first", "last").union(late)
             .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
             .select("doc_id", F.aggregate(
                 "runs", F.array().cast("array<struct<start:bigint,end:bigint>>"),
                 lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["first"]), F.concat(
                     F.slice(done, 1, F.size(done) - 1),
                     F.array(F.struct(F.element_at(done, -1)["start"].alias("start"),
                                      F.greatest(F.element_at(done, -1)["end"], x["last"] + length).alias("end")))))
                 .otherwise(F.concat(done, F.array(F.struct(x["first"].alias("start"), (x["last"] + length).alias("end")))))).alias("runs")))
    whole = copies.select("doc_id", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))).alias("runs"))
    return durable(spans.union(whole), "removed")


def _kept(data: bytes, runs: list[dict]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the maximal runs."""
    out, at, gone, n = [], 0, 0, 0
    for run in runs:
        a, b = max(at, min(run["start"], len(data))), min(run["end"], len(data))
        if b > a:
            out.append(data[at:a])
            gone, n, at = gone + b - a, n + 1, b
    return b"".join([*out, data[at:]]), gone, n


def _with_runs(docs: DataFrame, length: int) -> DataFrame:
    """The documents and, as last column, the runs to remove from each.

    Different texts with one doc_id are documents of their own, the one with the lesser SHA-256 the earlier: then all
    are numbered in that order, and the numbers stand for the ids."""
    key, runs, digest = fresh(docs, "_id"), fresh(docs, "runs"), fresh(docs, "_sum")
    sums = sums_of(docs)
    texts = sums.distinct()
    if not texts.groupBy("doc_id").count().where("count > 1").take(1):
        found = removed(docs, length, sums).toDF(key, runs)
        return docs.join(found, F.col("doc_id") == F.col(key), "left").drop(key)
    numbers = durable(number_within(texts.select(F.struct("doc_id", "sum").alias("order")), [], "order", "number"), "numbers").select(
        F.col("order.doc_id").alias(key), F.col("order.sum").alias(digest), F.col("number").alias(fresh(docs, "_number")))
    number = numbers.columns[-1]
    told = docs.withColumn(fresh(docs, "_digest"), F.unhex(F.sha2("text", 256)))
    mine = told.columns[-1]
    numbered = told.join(numbers, (F.col("doc_id") == F.col(key)) & (F.col(mine) == F.col(digest)), "left").drop(key, digest, mine)
    found = removed(numbered.select(F.col(number).alias("doc_id"), "text"), length).toDF(key, runs)
    return numbered.join(found, F.col(number) == F.col(key), "left").drop(key, number)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, other columns as they are, with the repeated bytes gone from their texts. A
    character of which bytes went is dropped. Null texts stay null. Different texts with one doc_id are
    documents of their own, as in `digests`."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t if t is None or not runs else _kept(t.encode(), runs)[0].decode(errors="ignore")
                 for t, runs in zip(batch.column("text").to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
        return {c: batch.column(c) for c in kinds} | {"text": texts}

    return arrow_map(_with_runs(docs, length), run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Null and empty texts are
    no bytes. A null doc_id is earlier and later than nothing, so its text stays. Rows that repeat,
    doc_id and text, are one document with equal results; different texts with one doc_id are documents of
    their own, the one with the lesser SHA-256 the earlier."""
    def run(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, runs in zip(batch.column(1), batch.column(2)):
            data = (text.as_py() or "").encode()
            kept, gone, n = _kept(data, runs.as_py() or [])
            for c, v in (("n_bytes", len(data)), ("n_removed", gone), ("n_spans", n), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                out[c].append(v)
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(_with_runs(docs.select("doc_id", "text"), length), run,
                     f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
