"""Phrase mining against counting everything."""

import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from quire.llm import phrases  # noqa: E402


def plain(docs, support, longest=5, top=2000, cover=100):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    many = {p: f for p, f in counts.items() if f >= support}
    out = []
    for (lang, *w), a in many.items():
        if len(w) < 2 or any(len(q) > len(w) + 1 and q[0] == lang and 100 * f >= cover * a
                             and any(list(q[i:i + len(w)]) == w for i in range(1, len(q) - len(w) + 1)) for q, f in many.items()):
            continue
        score, _, left, right = min((1000 * a * totals[lang] // (many[lang, *w[:k]] * many[lang, *w[k:]]), k, many[lang, *w[:k]], many[lang, *w[k:]])
                                    for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), left, right, totals[lang]))
    ranks, rows = Counter(), []
    for lang, score, a, phrase, left, right, n in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase.decode(), -a, left, right, n, -score))
    return rows


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(13)
    word = lambda: rng.choice("the of Über 日本 a b c d e f g  x É q\x1c".split(" "))
    set_phrase = ["in the end", "New York city", "a b a b a", "one two three four five six"]
    docs = []
    for i in range(300):
        parts = [rng.choice(set_phrase) if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 60))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for p in parts)
        docs.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return docs + [("en", None), (None, ""), ("fr", " . "), ("en", docs[0][1]), ("en", docs[0][1])]


@pytest.mark.parametrize("support, pieces", [(1, 1), (2, 400), (7, 400), (20, 1), (100, 400)])
def test_phrases_equal_the_plain_version(spark, texts, support, pieces):
    """Also with pieces of a text each, slices of a few bytes and many shards."""
    sizes = phrases.Sizes(1, 5) if pieces == 1 else phrases.Sizes(pieces)
    docs = texts[:25] if support < 3 else texts
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({c: F.lit(7) for c in ("phrase", "size", "f", "n", "hash", "shard")}).repartition(9)
    got = sorted(tuple(r) for r in phrases.collocations(df, support=support, top=40, sizes=sizes).collect())
    assert got == sorted(plain(docs, support, top=40)) and (got or support == 100)


def test_clashing_hashes_let_nothing_through_or_away(spark, texts):
    df = spark.createDataFrame(texts, "lang string, text string").repartition(6)
    assert sorted(map(tuple, phrases.collocations(df, support=15, sizes=phrases.Sizes(slots=64)).collect())) == sorted(plain(texts, 15))


def test_local_supports_lose_nothing():
    rng = random.Random(1)
    for _ in range(300):
        support = rng.randint(1, 200)
        share = {s: rng.choice([1, 5, rng.randint(1, 10**14)]) for s in range(max(1, min(25, (support - 1) // 2)))}
        local = phrases.local_supports(support, share)
        assert sum(v - 1 for v in local.values()) < support and all(v >= 1 for v in local.values())


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("x", "a", 1, big), ("x", "b", 1, big), ("x", "a b", 2, big - 1)], "lang string, phrase string, size int, f long")
    row = phrases.scored(counts, spark.createDataFrame([("x", 7 * big)], "lang string, n long")).first()
    assert row["score"] == 1000 * (big - 1) * 7 * big // (big * big)


def test_long_and_no_texts(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).collect() == []
    blank = spark.createDataFrame([("en", None), ("en", " .")], none.schema)
    assert phrases.collocations(blank).collect() == []
    rng = np.random.default_rng(3)
    long = " ".join(f"w{x}" for x in rng.zipf(1.3, 400_000) % 5000)
    docs = [("en", long), ("en", "z" * 9_000_000)]
    got = sorted(map(tuple, phrases.collocations(spark.createDataFrame(docs, none.schema), longest=2, top=50).collect()))
    assert got == sorted(plain(docs, 100, longest=2, top=50, cover=101))
