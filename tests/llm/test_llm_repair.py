"""Conversation repair against all possible edits, and the parser against the grammar as a pattern."""

import hashlib
import itertools
import os
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from quire.llm import repair  # noqa: E402

SENTENCE = re.compile("(s?(ua)+)?")
TALKS = "conv_id long, turn long, role string, text string"


def test_parser_takes_the_sentences_of_the_grammar():
    parser = repair._edits().parser
    for n in range(7):
        for word in map("".join, itertools.product("sua", repeat=n)):
            stacks = [parser.first]
            for x in word:
                stacks = [s for at in stacks for s in parser.shifted(at, x)]
            assert any(map(parser.accepts, stacks)) == bool(SENTENCE.fullmatch(word)), word


def roles_for(length):
    return "s" * (length % 2) + "ua" * (length // 2)


@lru_cache(None)
def cheapest(rows):
    """By trying all edits: rows of (initial, truncated, must go), up to two inserts at each gap."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product(*["D" if gone else "DKR" for _, _, gone in rows]):
            cost, audit, out = 3 * sum(inserts), "I" * inserts[0], "." * inserts[0]
            for (initial, cut, _), edit, more in zip(rows, edits, inserts[1:]):
                cost += {"D": 4, "K": 3 * cut, "R": 3 + 3 * cut}[edit]
                out += {"D": "", "K": initial, "R": "."}[edit] + "." * more
                audit += edit + "I" * more
            want = roles_for(len(out))
            if len(out) == 1 or any(o not in (w, ".") for o, w in zip(out, want)) or (out[:1] == "." and want[:1] == "s"):
                continue
            if best is None or (cost, audit) < best:
                best = cost, audit
    return best


def plain(talks, spoil=True):
    convs = defaultdict(list)
    for conv, turn, role, text in talks:
        rows = convs[conv]
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if spoil else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        rows += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            solid = re.sub("[ \t-\r]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        initials = [r[:1] for _, r, _ in rows]
        cost, audit = cheapest(tuple((i if i in ("s", "u", "a") else "x", f == "truncated", f in ("blank", "duplicate")) for i, f in zip(initials, faults)))
        lines, at, want = [], 0, roles_for(len(audit) - audit.count("D"))
        for edit in audit:
            role, text = ("", "") if edit == "I" else rows[at][1:]
            at += edit != "I"
            if edit != "D":
                lines.append((role if edit == "K" else {"u": "user", "a": "assistant"}[want[len(lines)]]) + ":" + text)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in repair.COUNTS[:3]],
                    sum(a + b not in repair.LEGAL for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(12)
    text = lambda: rng.choice(["Yes.", "No!", "Well", "Why?", "", " \n", None, "So. ", "…", "A ", "日本。", " "])
    rows = []
    for conv in range(400):
        turn = rng.randint(0, 3)
        for _ in range(rng.randint(0, 4)):
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "super"]),
                         text() if rng.random() < 0.6 else f"{rng.random()}."))
            turn += rng.choice([0, 1, 1, 1, 2])
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None)] + rows[:3]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark, talks):
    return spark.createDataFrame(talks, TALKS).withColumns({c: F.lit(7) for c in ("at", "block", "head", "sum", "code", "late", "_conv", "n")})


def test_reports_equal_the_plain_version(frame, talks):
    want = plain(talks)
    assert max(len(w[7]) for w in want) > 3 and len({w[7] for w in want}) > 50
    got = repair.judged(frame, repair.damaged(frame))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == [w[:9] for w in want]


def test_blocks_put_together_equal_whole_parses(spark, talks, monkeypatch):
    """Blocks of two rows, two at a time, so that every conversation goes through several rounds."""
    df = spark.createDataFrame(talks, TALKS)
    monkeypatch.setattr(repair, "BLOCK", 2)
    monkeypatch.setattr(repair, "FAN", 2)
    assert sorted((tuple(r) for r in repair.judged(df, df).collect()), key=str) == [w[:9] for w in plain(talks, spoil=False)]


def test_long_blocks_equal_one_parse():
    rng, edits = random.Random(4), repair._edits()
    for _ in range(40):
        steps = [(rng.choice("suax"), rng.choice([0, 0, 3]), rng.random() < 0.1) for _ in range(rng.randint(1, 60))]
        cut = rng.randint(0, len(steps))
        every = list(range(len(edits.parser.stacks)))
        parts = edits.product(edits.moves(steps[:cut], [0]), edits.moves(steps[cut:], every))
        assert edits.best(parts) == edits.best(edits.moves(steps, [0]))


def test_repaired_rows(frame, talks):
    rows = defaultdict(list)
    for r in repair.repaired(frame).collect():
        rows[r["conv_id"]].append((r["place"], r["role"] + ":" + r["text"], r["edit"]))
    for conv, *_, audit, _, lines in plain(talks, spoil=False):
        assert [x[1] for x in sorted(rows[conv])] == lines
        assert "".join(x[2] for x in sorted(rows[conv])) == audit.replace("D", "")


def test_a_long_conversation_and_long_texts(spark):
    """One conversation with most rows, over several blocks, and a text of a million letters."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(3000) if i % 700 != 5]
    rows += [(2, 0, "user", "x" * 1_000_000 + "."), (2, 1, "assistant", "y.")]
    df = spark.createDataFrame(rows, TALKS)
    got = {r["conv_id"]: r for r in repair.judged(df, df).collect()}
    assert got[1]["gaps"] == 5 and got[1]["illegal"] == 5 and got[1]["cost"] == 15
    lines = [":".join(r[2:]) for r in rows[:2995]]
    for at in (5, 705, 1405, 2105, 2805):
        lines.insert(at, "assistant:")
    if got[1]["audit"] == "".join("I" if i % 700 == 5 else "K" for i in range(3000)):
        assert got[1]["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    else:  # an insert right before an equal role is worth the same; the least audit takes the first place
        assert got[1]["audit"] < "".join("I" if i % 700 == 5 else "K" for i in range(3000)) and got[1]["audit"].count("I") == 5
    assert (got[2]["cost"], got[2]["audit"]) == (0, "KK")


def test_nothing(spark):
    none = spark.createDataFrame([], TALKS)
    assert repair.judged(none, none).collect() == [] and repair.repaired(none).collect() == []
    far = spark.createDataFrame([(1, -2**63, "user", "a."), (1, 2**63 - 1, "assistant", "b.")], TALKS)
    assert repair.judged(far, far).first()["gaps"] is None
