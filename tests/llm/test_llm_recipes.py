"""Exact deduplication by chunk recipes against a plain version."""

import hashlib
import os
import random
import re
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from quire.llm import recipes  # noqa: E402


def plain(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub("[ \t-\r]", "", t or "")].append((-len(t or ""), i is None, i, t))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:2] + (m[2] or 0,))
        for k, (_, _, i, _) in enumerate(members):
            out.append((i, members[0][2], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 7))) + rng.choice(["", "", ",", ".", "。"])
    made = [" ".join(word() for _ in range(rng.randint(1, 400))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(made)]
    docs += [(100 + i, made[i].replace(" ", rng.choice(["  ", "\n", "\t"]), rng.randint(0, 9))) for i in range(30)]
    docs += [(200 + i, made[i][:-1]) for i in range(20)] + [(300, made[0])] * 3  # rows that repeat
    docs += [(400 + i, made[1] + " tail") for i in range(40)]
    docs += [(500, None), (501, ""), (502, " \n\x0b\t"), (None, made[2]), (None, None), (503, " "), (503, made[3]), (503, made[4] + " ")]
    docs += [(600, "a" * 50_000), (601, "a" * 25_000 + " " + "a" * 25_000), (602, "a" * 49_999), (603, "x. " * 40_000), (2**63 - 1, "x."), (-2**63, "x. ")]
    rng.shuffle(docs)
    return docs


@pytest.fixture(scope="module")
def docs(spark, texts):
    # columns that the operator might use itself
    return spark.createDataFrame(texts, "doc_id long, text string").withColumns(
        {c: F.lit(7) for c in ("row", "chars", "recipe", "hash", "chunk", "digest", "best", "same", "_kept")}).repartition(5)


def test_groups_equal_the_plain_version(docs, texts):
    assert sorted((tuple(r) for r in recipes.judged(docs).collect()), key=str) == plain(texts)


@pytest.mark.parametrize("classes", [1, 3])
def test_chunks_of_one_hash_are_told_apart(docs, texts, classes):
    """With a poor hash nearly all chunks clash, and the contents decide."""
    got = recipes.judged(docs, code=lambda c: F.pmod(F.xxhash64(c), F.lit(classes)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(texts)


def test_chunks_are_the_text_and_shared(spark, texts):
    rng = random.Random(2)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + rng.choice(["", "", "."]) for _ in range(4000))
    rows = [(i, t) for i, t in enumerate(t for _, t in texts if t)] + [(-1, base), (-2, "before, " + base), (-3, base[:9000] + "!new!" + base[9000:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", recipes.normal().alias("norm"))
    got = {r[0]: (r[1], r[2]) for r in df.select("doc_id", "norm", recipes.chunked(F.col("norm"))).collect()}
    assert all("".join(chunks) == norm and all(0 < len(c) <= recipes.LONGEST for c in chunks) for norm, chunks in got.values())
    whole = set(got[-1][1])
    assert len(whole) > 10 and all(len(whole - set(got[i][1])) <= 3 for i in (-2, -3))


def test_documents_that_stay(docs, texts):
    kept = recipes.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = {i for i, _, _, k, _ in plain(texts) if k}
    assert sorted(kept.select("doc_id", "text").collect(), key=str) == sorted(((i, t) for i, t in texts if i in ids), key=str)


def test_no_rows(spark):
    assert recipes.judged(spark.createDataFrame([], "doc_id long, text string")).collect() == []
