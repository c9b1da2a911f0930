"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows,
empty tables and clashing extra columns."""

import hashlib
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from quire.llm import (bpe, chaining, classifier, common, embeddings, licences, packing, quality,  # noqa: E402
                       rindex, simhash, stats, suffixes, urls)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(docs, extra=()):
    return [(i, t, "en", "src0", len(t or "")) for i, t in docs] + list(extra)


@pytest.fixture(scope="module")
def made():
    """Texts with shared, edited and repeated passages, some null, empty, blank or in all languages."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    shared = [" ".join(word() for _ in range(80)) for _ in range(5)]
    docs = []
    for i in range(120):
        parts = [rng.choice(shared)[rng.randint(0, 40):] if rng.random() < 0.5 else " ".join(word() for _ in range(30))
                 for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.3:
            parts = [p.replace("a", "é", 1) for p in parts]
        if rng.random() < 0.1:
            parts.append("ab " * 120)
        docs.append((i, "\n".join(parts)))
    docs += [(200, None), (201, ""), (202, " \n\t"), (203, shared[0]), (204, shared[0]), (204, shared[0]), (205, "日本 🙂<|endoftext|>x")]
    docs += [(300 + i, docs[3 * i][1]) for i in range(10)] + [(None, shared[1])]
    return docs


@pytest.fixture(scope="module")
def docs(spark, made):
    # columns that an operator might use itself
    return spark.createDataFrame(rows_of(made), DOCS).withColumns(
        {c: F.lit(7) for c in ("fp", "runs", "key", "x", "n", "component", "size", "rank", "shard", "score")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.tokenizer_path())


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# 1


def test_chains_have_the_best_score():
    rng = random.Random(1)
    for _ in range(200):
        pairs = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(3, 40))})
        score = []
        for j, (x, y) in enumerate(pairs):
            score.append(chaining.WEIGHT + max([0.0] + [score[i] - chaining.GAP * (x + y - sum(pairs[i])) / 2
                                                        for i in range(j) if pairs[i][0] < x and pairs[i][1] < y]))
        found = chaining.chains(pairs)
        if max(score) >= chaining.MIN_SEEDS * chaining.WEIGHT:
            chain = found[0]
            got = len(chain) * chaining.WEIGHT - chaining.GAP * (sum(chain[-1]) - sum(chain[0])) / 2
            assert got == pytest.approx(max(score))
            assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:]))


def test_edited_passages_are_found_and_others_not(spark, none):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, planted, made = words(90), set(), []
    for i in range(40):
        if i % 4 == 0:
            p = list(passage)
            for at in rng.sample(range(90), 3):
                p[at] = "new"
            made.append((i, " ".join(words(rng.randint(0, 150)) + p + words(60))))
            planted.add(i)
        else:
            made.append((i, " ".join(words(200))))
    made += [(50, made[1][1]), (51, None), (52, ""), (None, made[0][1]), (1, made[1][1])]
    got = chaining.passages(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} | {r["match_id"] for r in got} == planted | {1, 50}
    assert [(r["doc_id"], r["match_id"], r["identity"]) for r in got if r["copy"]] == [(50, 1, 1.0)]
    assert all(r["identity"] >= 0.8 and r["match_id"] < r["doc_id"] for r in got)
    assert chaining.passages(none).collect() == []


@pytest.mark.parametrize("crowd", [0, 20])
def test_passages_behind_other_first_places(spark, crowd):
    """Earlier documents hold the halves of passages that two later ones share, one or a crowd of them."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    made, want, i = [], set(), 0
    for n in (60, 70, 80, 98):
        for _ in range(6):
            passage = words(n)
            held = [passage[:n // 2], passage[n // 2:], passage[n // 4:n // 4 + 45]] + [passage[a:a + 45] for a in range(0, n - 45, 15)] * crowd
            made += [(i + k, " ".join(words(80) + h + words(80))) for k, h in enumerate(held)]
            i += len(held) + 2
            made += [(i - k, " ".join(words(50) + passage + words(50))) for k in (2, 1)]
            want.add((i - 1, i - 2))
    got = {(r["doc_id"], r["match_id"]) for r in chaining.passages(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert len(want & got) >= 0.95 * len(want)
    assert got <= want


@pytest.mark.parametrize("dealt", [None, 5])
def test_passages_of_nothing_but_frequent_seeds(spark, monkeypatch, dealt):
    """Each stretch that two documents have in common is in a crowd of earlier ones too, none is longer than six words."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    if dealt:  # many blocks of places, few links at a time
        monkeypatch.setattr(chaining, "DEALT", dealt)
        monkeypatch.setattr(chaining, "UNFOLDED", 7)
    made, want = [], set()
    for n in range(4):
        pieces = [words(6) for _ in range(11)]
        for k in range(20):
            rng.shuffle(shuffled := list(pieces))
            made.append((100 * n + k, " ".join(w for p in shuffled for w in p + words(9))))
        made += [(100 * n + 50 + k, " ".join(words(40) + [w for p in pieces for w in p + words(1)] + words(40))) for k in range(2)]
        want.add((100 * n + 51, 100 * n + 50))
    got = {(r["doc_id"], r["match_id"]) for r in chaining.passages(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == want


def test_repeated_words_of_any_length_have_few_rows(spark):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    made = [(i, " ".join(words(60) + ["the"] * n + words(60))) for i, n in enumerate([300, 60, 90, 200])]
    got = chaining.passages(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3} and {r["match_id"] for r in got if r["doc_id"] == 1} == {0}
    assert len(got) <= 30


@pytest.mark.parametrize("even", [False, True])
@pytest.mark.parametrize("n", [55, 150])
def test_recall_near_the_identity_sought(spark, n, even):
    """Against an alignment of the planted passages, with 15 to 18% of words replaced."""
    rng = random.Random(n)
    words = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    made, want = [], set()
    for i in range(0, 300, 2):
        passage, share = words(n), rng.choice([0.15, 0.18])
        edits = int(share * n)
        at = [int((j + 0.5) / share) for j in range(edits)] if even else rng.sample(range(n), edits)
        near = [words(1)[0] if j in at else w for j, w in enumerate(passage)]
        like = [a == b for a, b in zip(passage, near)]
        if any(sum(like[a:b]) >= 0.8 * (b - a) for a in range(n) if like[a] for b in range(a + 50, n + 1) if like[b - 1]):
            made += [(i, " ".join(words(60) + passage + words(60))), (i + 1, " ".join(words(70) + near + words(50)))]
            want.add((i + 1, i))
    got = {(r["doc_id"], r["match_id"]) for r in chaining.passages(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    print("recall", n, even, len(want & got), len(want))
    assert len(want & got) >= 0.95 * len(want)


def test_batches_are_handed_over_in_pieces(spark):
    """However many rows a batch has, a function sees no more values at a time than it is given memory for."""
    rows = [(i, [i] * n) for i, n in enumerate([3, 0, 40, 200, 1, 1, 99, 0])] + [(8, None)]
    df = spark.createDataFrame(rows, "i long, v array<long>").coalesce(1)

    def seen(batch):
        many = sum(len(v or []) for v in batch.column(1).to_pylist())
        return {"i": batch.column(0), "many": [many] * batch.num_rows, "n": [batch.num_rows] * batch.num_rows}

    out = common.arrow_map(df, seen, "i long, many long, n long", ("v",), 100).collect()
    assert sorted(r.i for r in out) == list(range(9))
    assert all(r.many <= 100 or r.n == 1 for r in out) and max(r.n for r in out) > 1


def test_rows_of_near_copies_and_repeated_words_do_not_grow_with_the_square(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    base, made = words(300), []
    for i in range(15):  # few enough that all places are linked
        near = list(base)
        for at in rng.sample(range(300), 6):
            near[at] = words(1)[0]
        made.append((i, " ".join(near)))
    made += [(100 + i, " ".join(words(60) + ["on", "off"] * 110 + words(60))) for i in range(3)]
    got = chaining.passages(spark.createDataFrame(made, "doc_id long, text string")).collect()
    near, repeated = [r for r in got if r["doc_id"] < 100], [r for r in got if r["doc_id"] >= 100]
    assert len(near) <= 3 * 15 and len(repeated) <= 10 * 3
    root = {i: i for i, _ in made}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["match_id"])):
        a, b = root[r["doc_id"]], root[r["match_id"]]
        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert set(root.values()) == {0, 100}


# 2


def test_encoding_equals_the_library(library):
    code = bpe.coder(common.tokenizer_path())
    rng = random.Random(2)
    for i in range(3000):
        text = "".join(rng.choice("abc  \n\t'éßАя日🙂 0१²'ll 're theing\x1c\x85") for _ in range(rng.randint(0, 30)))
        if i % 5 == 0:
            text = "".join(chr(rng.choice([rng.randint(0, 0x24F), rng.randint(0, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(12))
        if i % 7 == 0:
            text = rng.choice("aeht -=") * rng.randint(1, 300)
        if i % 11 == 0:
            text += "<|endoftext|> and"
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(code.encode(text), "<u4").tolist() == want
        assert code.decode(want).decode() == library.decode(want, skip_special_tokens=False)


def test_round_trip(docs, none, made, library):
    got = Counter(tuple(r) for r in bpe.round_trip(docs).collect())
    ids = [(d, library.encode(t or "", add_special_tokens=False).ids, t or "") for d, t in made]
    assert got == Counter((d, len(x), sha(",".join(map(str, x))), sha(t)) for d, x, t in ids)
    back = bpe.decode(bpe.encode(docs)).collect()
    assert Counter((r[0], r[1]) for r in back) == Counter((d, t or "") for d, t in made)
    assert bpe.round_trip(none).collect() == []


# 3


def test_isotonic_rises_and_keeps_means():
    at, n, ones = np.arange(6.0), np.full(6, 10.0), np.array([1.0, 4, 2, 7, 6, 9])
    x, y = classifier.isotonic(at, n, ones)
    assert len(x) == 4 and (np.diff(y) >= 0).all() and y[1] == pytest.approx((6 + 0.3) / 21)


def test_normal_equations_equal_one_matrix(spark):
    rng = np.random.default_rng(1)
    names = list(stats.COLUMNS)
    rows = [tuple(int(v) for v in rng.integers(1, 500, len(names))) + (int(rng.integers(0, 2)), i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names) + ", y int, calibrate boolean").repartition(5)
    model = classifier.fit(df)
    table = np.array([r[:-2] for r in rows if not r[-1]]).T
    x, y = classifier.inputs(dict(zip(names, table))), np.array([r[-2] for r in rows if not r[-1]])
    assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.spread, x.std(axis=0), atol=1e-6)
    z = model.cosines(x)
    left = z.T @ z + classifier.RIDGE * len(x) * np.diag([1.0] * classifier.FEATURES + [0]) + 1e-9 * np.eye(z.shape[1])
    assert np.allclose(model.weights, np.linalg.solve(left, z.T @ y), atol=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = common.table(spark, sf, "labels")
    got = classifier.classified(common.table(spark, sf, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.93
    assert got["score"].between(0, 1).all()


def test_labels_held_out_are_not_read(spark, docs, made, none):
    ids = [d for d, t in made if d is not None and t]
    held = [d for d in ids if zlib.crc32(str(d).encode()) % 4 == 2]
    labels = [(d, d % 2) for d in ids]
    frame = lambda rows: spark.createDataFrame([*rows, (None, 1), (5, None)], "doc_id long, quality int")
    one = {r["doc_id"]: r["score"] for r in classifier.classified(docs, frame(labels)).collect()}
    other = {r["doc_id"]: r["score"] for r in classifier.classified(docs, frame([(d, 1 - q if d in held else q) for d, q in labels])).collect()}
    assert one == pytest.approx(other) and len(one) == len({d for d, _ in made})
    assert classifier.classified(none, frame(labels)).collect() == []
    assert {r["score"] for r in classifier.classified(docs, frame([])).collect()} == {0.5}


# 4


def test_licences(spark, none):
    apache = ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance "
              "with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
              "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on "
              "an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.")
    texts = ["Released under the MIT License. Released under the MIT License.", None, "", "said\nReleased under the  MIT license", apache,
             "no licence here", "x " * 50_000 + "\nLicensed under CC BY-NC 4.0."]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, place int, row int")
    got = sorted((r["doc_id"], r["licence"], r["n_sentences"], r["n_found"]) for r in licences.scanned(df).collect())
    assert got == [(0, "MIT", 1, 2), (3, "MIT", 1, 1), (4, "Apache-2.0", 5, 1), (6, "CC-BY-NC-4.0", 1, 1)]
    assert licences.scanned(none).collect() == []


# 5


def plain_statistics(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    cover = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(cover))


def test_statistics(made):
    rng = random.Random(4)
    texts = [t for _, t in made] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert stats.statistics(t)[:5] == plain_statistics(t)


def test_quality_rules(spark, docs, made, none):
    got = quality.judged(docs, fewest=30).collect()
    assert len(got) == len(made)
    for r in got:
        t = next(t for d, t in made if d == r["doc_id"])
        n, *_, repeats = plain_statistics(t)
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    assert quality.judged(none).collect() == []


def test_leftovers_of_large_sources_are_judged(spark):
    """Junk in a small source of a language with a large one, and in a language of its own."""
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice(["alpha", "gamma", "stone", "river", "house", "quiet", "green", "seven"]) + rng.choice("abcdefgh") for _ in range(60))
    junk = lambda: " ".join("$$##%%@@!!" + rng.choice("ABCDEFGH") for _ in range(60))
    made = [(i, clean(), "en", "large") for i in range(600)] + [(1000 + i, junk(), "en", "small") for i in range(30)]
    made += [(2000 + i, junk(), None, "large") for i in range(5)] + [(3000 + i, clean(), "de", "other") for i in range(40)]
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect()}
    assert all(not r["base_failed"] and r["distance"] is not None for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == {i for i, *_ in made if 1000 <= i < 3000}


def test_minimum_covariance_determinant_finds_the_outliers(spark):
    rng = np.random.default_rng(2)
    p = quality.P
    good = rng.normal(size=(900, p)) @ rng.normal(size=(p, p)) * 0.3 + 2
    bad = rng.normal(size=(150, p)) * 0.1 + 9
    rows = [("a", r.tolist()) for r in np.vstack([good, bad])] + [("b", r.tolist()) for r in good[:300] - 5]
    df = spark.createDataFrame(rows, "key string, x array<double>")
    far = df.join(quality.estimates(df), "key").withColumn("d", quality._distance() / F.col("scale"))
    got = far.select("key", "x", "d").toPandas()
    out = got["x"].map(lambda x: min(abs(v - 9) for v in x) < 2 and np.mean(x) > 8)
    assert (got["d"][out] > quality.LIMIT).all() and (got["d"][~out] < quality.LIMIT).all()


def plain_estimate(x, share=quality.SHARE):
    """Concentration steps of one group with exact ranks."""
    n, p = x.shape
    at = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    mu = np.array([at(x[:, i], 0.5) for i in range(p)])
    spread = np.array([max((at(x[:, i], 0.75) - at(x[:, i], 0.25)) / 1.349, quality.FLOOR[i]) for i in range(p)])
    inverse, det = np.diag(1 / spread**2), np.inf
    far = lambda: np.einsum("ni,ij,nj->n", x - mu, inverse, x - mu)
    while True:
        d = far()
        kept = x[d <= at(d, share)]
        m = kept.mean(0)
        cov = kept.T @ kept / len(kept) - np.outer(m, m) + np.diag(np.square(quality.FLOOR))
        now = np.linalg.slogdet(cov)[1]
        if not now < det - 1e-6:
            return mu, inverse, max(at(far(), 0.5) / quality.MEDIAN, 1.0)
        mu, inverse, det = m, np.linalg.inv(cov), now


def test_estimates_equal_a_plain_version(spark):
    rng = np.random.default_rng(9)
    groups = {k: np.vstack([rng.normal(size=(n, quality.P)) * rng.uniform(0.1, 2, quality.P), rng.normal(3, 1, (n // 6, quality.P))]) for k, n in (("a", 250), ("b", 400))}
    rows = [(k, [float(v) for v in r]) for k, x in groups.items() for r in x]
    got = {r["key"]: r for r in quality.estimates(spark.createDataFrame(rows, "key string, x array<double>").repartition(5)).collect()}
    for k, x in groups.items():
        mu, inverse, scale = plain_estimate(x)
        assert np.allclose(got[k]["mu"], mu) and np.allclose(np.reshape(got[k]["inverse"], inverse.shape), inverse) and np.isclose(got[k]["scale"], scale)


# 6


def plain_removed(rows, length=100):
    seen, out = {}, {}
    for d, t in sorted((d, t or "") for d, t in rows if d is not None):
        b = t.encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen.setdefault(b[i:i + length], (d, i)) != (d, i):
                cover[i:i + length] = b"\1" * length
        out[d] = (len(b), sum(cover), sum(c and not p for p, c in zip(b"\0" + cover, cover)), sha(bytes(x for x, c in zip(b, cover) if not c)))
    return out


def test_matching_statistics():
    rng = random.Random(3)
    for k in range(150):
        letters = rng.choice([b"ab", b"abc", b"abcdefgh", bytes([0, 255, 7])])
        some = lambda n: bytes(rng.choice(letters) for _ in range(n))
        texts = [some(rng.randint(1, 60)) for _ in range(rng.randint(1, 4))]
        texts += [texts[0] * 5] if k % 3 == 0 else []
        pattern = some(rng.randint(1, 30)) + rng.choice(texts)[:40] + some(10)
        place = rindex.RunIndex(texts).stream(np.frombuffer(pattern, "uint8"), np.array([len(pattern)]), np.array([len(pattern)]))
        whole = [c for t in texts for c in [*t, None]]
        for i in range(len(pattern)):
            best = max(n for n in range(len(pattern) - i + 1) if n == 0 or any(pattern[i:i + n] in t for t in texts))
            n = 0
            while place[i] >= 0 and i + n < len(pattern) and whole[place[i] + n] == pattern[i + n]:
                n += 1
            assert n == best


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(21)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    s, t, u = text(), text(), text()
    rows = [(1, s), (2, s), (2, t), (2, t), (3, u[:300] + t[:200]), (4, u), (None, s), (5, None), (5, u)]
    got = suffixes.digests(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_id", "runs", "_sum", "_number")})).collect()
    found = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got}
    n = len(s)
    assert len(got) == len(rows) and found == {(1, n, 0), (2, n, n), (2, n, 0), (3, 500, 200), (4, n, 300), (None, n, 0), (5, 0, 0), (5, n, n)}
    left = suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in left if r["doc_id"] == 2) == sorted(["", t, t])


@pytest.mark.parametrize("hot", [False, True])
def test_suffix_dedup(spark, docs, made, none, hot, monkeypatch):
    if hot:  # homes over several tasks, indexes in several parts
        monkeypatch.setattr(suffixes, "STREAMED", 3000)
        monkeypatch.setattr(suffixes, "INDEXED", 500)
    got = suffixes.digests(docs).collect()
    want = plain_removed(made)
    assert len(got) == len(made)
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0]
    if not hot:
        kept = suffixes.deduplicated(docs)
        assert kept.columns == docs.columns
        assert all((r["text"] is None) == (r["doc_id"] == 200) for r in kept.collect())
        assert suffixes.digests(none).collect() == [] and suffixes.deduplicated(none).collect() == []


# 7


def test_urls(spark):
    given = [(1, None), (2, "x"), (None, "http://A.NET/"), (3, "https://net"), (4, "ftp://x.example.NET/en/a?b#c"), (5, "a://b.org/fr/x"),
             (6, "http://example.com/de/?q"), (6, "http://example.com/de/?q"), (7, "http://notexample.com/de/")]
    got = urls.judged(spark, spark.createDataFrame([(*r, 1) for r in given], "page_id long, url string, tokens int")).collect()
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(given)
    assert by[None] == ("a.net", "/", "net/", "block") and by[3] == ("net", "", None, "allow")
    assert by[4] == ("x.example.net", "/en/a", "example.net/en/", "allow") and by[1] == by[2] == ("", "", None, "allow")
    assert by[5][2:] == ("org/fr/", "allow") and by[6][2:] == ("example.com/de/", "block") and by[7][2] is None
    assert urls.judged(spark, spark.createDataFrame([], "page_id long, url string")).collect() == []


# 8


def plain_components(codes, radius):
    codes = sorted(codes)
    bits, seen, out = np.array(codes, dtype="uint64"), set(), []
    for c in codes:
        if c not in seen:
            group, todo = {c}, [c]
            while todo:
                near = bits[np.bitwise_count(bits ^ np.uint64(todo.pop())) <= radius]
                todo += [x for x in near.tolist() if x not in group]
                group.update(near.tolist())
            seen |= group
            out.append(sorted(group))
    return out


def test_tree_shards_lose_no_link(spark):
    rng = random.Random(2)
    base, codes = rng.getrandbits(64), set()
    for _ in range(600):
        code = base
        for _ in range(rng.randint(0, 8)):
            code ^= 1 << rng.randrange(64)
        codes.add(code)
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    df = spark.createDataFrame([(signed(c),) for c in codes] + [(None,)], "fp long")
    found = {r["node"]: r["component"] for r in common.components(simhash.links(df, 2, shard=64)).collect()}
    groups = {}
    for c in codes:
        groups.setdefault(found.get(signed(c), signed(c)), []).append(c)
    assert sorted(map(sorted, groups.values())) == sorted(plain_components(codes, 2))


def test_simhash(docs, made, none):
    import xxhash

    def code(text):
        w = (text or "").encode().lower().split()
        g = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in g]
        return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(g))

    codes = {t: code(t) for _, t in made}
    group = {c: tuple(g) for g in plain_components(set(codes.values()), 2) for c in g}
    least = {}
    for d, t in made:
        if d is not None:
            least[group[codes[t]]] = min(d, least.get(group[codes[t]], d))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal(), "component_id").collect()
    assert Counter(map(tuple, got)) == Counter((d, f"{codes[t]:016x}", least.get(group[codes[t]])) for d, t in made)
    assert simhash.near_duplicates(none).collect() == []


# 9


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x = np.vstack([x, x[:80] + rng.normal(size=(80, 16)) * 0.12, x[:30] * 3, np.repeat(x[5:6], 50, axis=0)]).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, node string")
    got = {r["vec_id"]: r for r in embeddings.linked(df).collect()}
    unit = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    want = near.sum(axis=1) - 1
    have = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.99 * want.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i, _ in odd)
    assert got[430]["component_id"] <= 30
    assert embeddings.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for dim, n in ((24, 60), (16, 40), (3, 1)):
        for _ in range(n):
            v, i = rng.normal(size=dim), len(rows)
            rows += [(i, v.tolist()), (i + 1, (v * 3 + rng.normal(size=dim) * 0.01).tolist())]
            want |= {i: i, i + 1: i}
    got = embeddings.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r["vec_id"]: r["component_id"] for r in got.collect()} == want


# 10


def test_packing(spark, docs, made, none, library):
    long = [(500, " ".join(f"word{i}" for i in range(3000)))]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(long, "doc_id long, text string"))
    got = packing.packed_documents(both).toPandas()
    want = Counter()
    for d, t in [*made, *long]:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter((None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in got[columns].itertuples(index=False)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert (got["offset"] == got.groupby("sequence_id")["length"].cumsum() - got["length"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert packing.packed_documents(none).collect() == []


@pytest.mark.parametrize("lengths", [[700] * 50, [1] * 300 + [9] * 40, list(range(1, 200)) * 2, [100] * 3])
def test_packing_is_tight(spark, lengths):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long")
    got = packing.pack(df, ["id"], capacity=1024).toPandas()
    gaps = []  # best-fit decreasing, one after the other
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        gaps.append((1024 if fit is None else fit) - n)
        if fit is not None:
            gaps.remove(fit)
    assert got["sequence_id"].nunique() <= len(gaps) * 1.02 + 1
    assert len(got) == len(lengths) and got.groupby("sequence_id")["length"].sum().max() <= 1024
