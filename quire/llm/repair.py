"""Repair of the structure of conversations by generalised LR parsing with edits.

The rows of a conversation, in order, are symbols: the initial of the role and the row's fault. The parser
of `glr` finds the cheapest edits after which the initials are a sentence of GRAMMAR. It reads codes of
one letter a row, in blocks of BLOCK rows that are parsed apart and put together FAN at a time, so a
conversation of any length is spread over tasks; texts come in only when the edits are carried out, sorted
by conversation and read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quire.llm.common import arrow_map, durable, ship
from quire.llm.glr import Edits, Parser
from quire.session import number_within

GRAMMAR = {"talk": [[], ["s", "turns"], ["turns"]], "turns": [["turns", "u", "a"], ["u", "a"]]}
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
BLOCK, FAN = 512, 64
FULL = 10_000  # rows of a batch
FAULTS = ("", "truncated", "blank", "duplicate")
CODES = "suaxSUAX01234567"  # initial (x: any other) within fault
BLANK, UNFINISHED = r"^[ \t-\r]*\z", r"[^.!? \t-\r][ \t-\r]*\z"
_ORDER = ("turn", "role", "sum")


@lru_cache(None)
def _edits() -> Edits:
    return Edits(Parser(GRAMMAR), "ua", DELETE, REROLE, INSERT)


def rows_of(talks: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, sum: nulls of role and text are one space. Rows of a conversation are in
    the order of turn (nulls first), role and the digest of the text, so it is the same on every run."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return (talks.select("conv_id", "turn", space("role"), space("text"))
            .withColumn("sum", F.unhex(F.sha2("text", 256))))


def damaged(talks: DataFrame) -> DataFrame:
    """The conversations with faults put in, by crc32("conv_id:turn") % 20: 0 drops the row, 1 empties
    its text, 2 removes its [.!?], 3 repeats it, 4 sets role user. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = (F.when(fate == 1, "").when(fate == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text")))
    return talks.where(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def codes(rows: DataFrame) -> DataFrame:
    """conv_id, block, codes: a letter a row, of at most BLOCK rows."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    marks = rows.select("conv_id", "turn", "role", "sum", kind.alias("kind"), F.rlike("text", F.lit(BLANK)).alias("blank"),
                        F.rlike("text", F.lit(UNFINISHED)).alias("unfinished"))
    order = F.struct(*_ORDER).alias("order")
    placed = durable(number_within(marks.select("conv_id", "kind", "blank", "unfinished", order), ["conv_id"], "order", "at"), "placed")
    placed = placed.withColumns({"role": F.col("order.role"), "sum": F.col("order.sum")})
    again = (placed.groupBy("conv_id", "role", "sum").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
             .select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("sum").alias("_sum"), "first"))
    seen = placed.join(again, _same("conv_id", "_conv") & (F.col("role") == F.col("_role")) & (F.col("sum") == F.col("_sum")), "left")
    fault = F.when(F.col("blank"), 2).when(F.col("at") > F.col("first"), 3).when(F.col("unfinished"), 1).otherwise(0)
    code = F.substr(F.lit(CODES), fault * 4 + F.col("kind") + 1, F.lit(1)).alias("code")
    block = F.floor((F.col("at") - 1) / BLOCK).cast("long").alias("block")
    return (seen.select("conv_id", block, "at", code).groupBy("conv_id", "block")
            .agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("list"))
            .select("conv_id", "block", F.array_join("list.code", "").alias("codes")))


COUNTS = ("blank", "duplicate", "truncated", "illegal")
_MOVES = "moves array<struct<start:int,to:int,cost:bigint,audit:string>>"
_SUMMARY = f"ends string, {', '.join(f'{c} bigint' for c in COUNTS)}, {_MOVES}"


def _illegal(a: str, b: str) -> int:
    return int(a + b not in LEGAL)


@lru_cache(1 << 14)
def _parsed(code: str, first: bool) -> tuple:
    """(ends, counts, moves) of a block: its first and last initial, its faults, its parses."""
    edits, at = _edits(), [CODES.index(c) for c in code]
    initials = "".join(CODES[i % 4] for i in at)
    n = [sum(i // 4 == FAULTS.index(f) for i in at) for f in COUNTS[:3]]
    n.append(sum(_illegal(a, b) for a, b in zip(initials, initials[1:])))
    steps = [(x, TRUNCATED if i // 4 == 1 else 0, i // 4 > 1) for x, i in zip(initials, at)]
    return initials[0] + initials[-1], n, edits.moves(steps, [0] if first else list(range(len(edits.parser.stacks))))


def _put(out: dict, ends: str, n: list[int], moves: dict) -> None:
    out["ends"].append(ends)
    for c, v in zip(COUNTS, n):
        out[c].append(v)
    out["moves"].append([{"start": i, "to": j, "cost": cost, "audit": audit} for (i, j), (cost, audit) in moves.items()])


def _parse(batch: pa.RecordBatch) -> dict:
    out = {"conv_id": batch.column(0), "block": batch.column(1), "ends": [], **{c: [] for c in COUNTS}, "moves": []}
    for block, code in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        _put(out, *_parsed(code, block == 0))
    return out


def _join(batch: pa.RecordBatch) -> dict:
    out = {"conv_id": batch.column(0), "block": batch.column(1), "ends": [], **{c: [] for c in COUNTS}, "moves": []}
    for cells in batch.column(2):
        ends, total, all_moves = "", [0] * len(COUNTS), None
        for cell in cells.as_py():
            n = [cell[c] for c in COUNTS]
            moves = {(m["start"], m["to"]): (m["cost"], m["audit"]) for m in cell["moves"]}
            n[3] += _illegal(ends[-1], cell["ends"][0]) if ends else 0
            total = [a + b for a, b in zip(total, n)]
            ends = (ends or cell["ends"])[0] + cell["ends"][-1]
            all_moves = moves if all_moves is None else Edits.product(all_moves, moves)
        _put(out, ends, total, all_moves)
    return out


def reports(rows: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit of each conversation with rows."""
    found = codes(rows)
    kind = found.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, block bigint, {_SUMMARY}"
    parsed = durable(arrow_map(found, _parse, schema), "parsed")
    while parsed.where("block > 0").take(1):
        lists = parsed.groupBy("conv_id", F.floor(F.col("block") / FAN).cast("long").alias("block")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "ends", *COUNTS, "moves"))).alias("list"))
        parsed = durable(arrow_map(lists, _join, schema), "parsed")

    def end(batch: pa.RecordBatch) -> dict:
        best = [_edits().best({(m["start"], m["to"]): (m["cost"], m["audit"]) for m in moves.as_py()})
                for moves in batch.column(batch.num_columns - 1)]
        return {**{c: batch.column(i) for i, c in enumerate(("conv_id", *COUNTS))},
                "cost": [c for c, _ in best], "audit": [a for _, a in best]}

    return arrow_map(parsed.select("conv_id", *COUNTS, "moves"), end,
                     f"conv_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, cost bigint, audit string")


def _carried_out(rows: DataFrame, heads: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows of each conversation in order behind its head, (conv_id, audit, ...), in one partition."""
    kept = [c for c in heads.columns if c != "conv_id"]
    head = F.struct(*kept).alias("head")
    void = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    texts = rows.select("conv_id", F.lit(1).alias("late"), *_ORDER, "text", F.lit(None).cast(heads.select(head).schema["head"].dataType).alias("head"))
    both = texts.union(heads.select("conv_id", F.lit(0), *[void(c, rows) for c in _ORDER], void("text", rows), head))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "late", *_ORDER).select("conv_id", "role", "text", "head"), kept


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("head", conv_id, head) for each conversation, then ("row", edit, role, text) for its repaired rows."""
    edits, audit, at, size, place = iter(()), "", 0, 0, 0

    def given(edit: str, role: str | None, text: str) -> tuple:
        nonlocal place
        if edit != "K":
            role = ROLES["ua"[(place - size % 2) % 2]]
        place += 1
        return "row", edit, role, text

    for batch in batches:
        roles, texts, heads = (batch.column(i) for i in (1, 2, 3))
        for i, conv in enumerate(batch.column(0).to_pylist()):
            head = heads[i].as_py()
            if head is not None:
                while at < len(audit):  # what is inserted at the end
                    yield given("I", None, "")
                    at += 1
                audit, at, place = head["audit"], 0, 0
                size = len(audit) - audit.count("D")
                yield "head", conv, head
                continue
            while audit[at] == "I":
                yield given("I", None, "")
                at += 1
            if audit[at] != "D":
                yield given(audit[at], roles[i].as_py(), texts[i].as_py())
            at += 1
    while at < len(audit):
        yield given("I", None, "")
        at += 1


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def repaired(talks: DataFrame) -> DataFrame:
    """The repaired conversations, row by row: conv_id, place (from 0), edit (K, R or I), role, text.
    Nulls of role and text are one space, a null conv_id is a conversation; other columns are not read."""
    ship(talks.sparkSession)
    rows = rows_of(talks)
    ordered, _ = _carried_out(rows, reports(rows).select("conv_id", "audit"))
    kind = talks.schema["conv_id"].dataType.simpleString()

    arrow = to_arrow_schema(_parse_datatype_string(schema := f"conv_id {kind}, place bigint, edit string, role string, text string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, size, out = None, 0, 0, []
        for event in _walk(batches):
            if event[0] == "head":
                conv, place = event[1], 0
                continue
            out.append((conv, place, *event[1:]))
            place, size = place + 1, size + len(event[3])
            if len(out) >= FULL or size > 8 << 20:
                yield _batch(out, arrow)
                size, out = 0, []
        if out:
            yield _batch(out, arrow)

    return ordered.mapInArrow(run, schema)


def judged(talks: DataFrame, broken: DataFrame) -> DataFrame:
    """One row per conv_id of talks, from its rows in `broken`: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. Conversations without rows there have zeros, an
    empty audit and the digest of nothing; a null conv_id is a conversation; null turns come first
    and make no gaps. Gaps beyond 64 bits are null. Rows that repeat are rows; other columns are not read."""
    ship(talks.sparkSession)
    rows = rows_of(broken)
    wide = lambda c: c.cast("decimal(20,0)")
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(
        (wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn")).alias("gaps"), F.count("turn").alias("n"))
    turns = turns.select(F.col("conv_id").alias("_c1"), F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.col("gaps").try_cast("long")).alias("gaps"))
    found = reports(rows).withColumnRenamed("conv_id", "_c2")
    none = F.col("audit").isNull()
    heads = (talks.select("conv_id").distinct().join(turns, _same("conv_id", "_c1"), "left").join(found, _same("conv_id", "_c2"), "left")
             .select("conv_id", F.when(none, F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps"),
                     *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*COUNTS, "cost")], F.coalesce("audit", F.lit("")).alias("audit")))
    ordered, names = _carried_out(rows, heads)
    kind = talks.schema["conv_id"].dataType.simpleString()
    longs = [c for c in names if c != "audit"]

    arrow = to_arrow_schema(_parse_datatype_string(
        schema := f"conv_id {kind}, {', '.join(f'{c} bigint' for c in longs)}, audit string, repaired_sha256 string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, head, digest, mark = [], None, None, hashlib.sha256(), ""
        done = lambda: (conv, *[head[c] for c in longs], head["audit"], digest.hexdigest())
        for event in _walk(batches):
            if event[0] == "row":
                digest.update(f"{mark}{event[2]}:{event[3]}".encode())
                mark = "\n"
                continue
            if head is not None:
                out.append(done())
            if len(out) >= FULL:
                yield _batch(out, arrow)
                out = []
            conv, head, digest, mark = *event[1:], hashlib.sha256(), ""
        if head is not None:
            out.append(done())
            yield _batch(out, arrow)

    return ordered.mapInArrow(run, schema)
