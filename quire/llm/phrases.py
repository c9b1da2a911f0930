"""Phrases that occur more often than their parts foretell, mined by SON partitioning.

The partitions of the corpus are dealt into SHARDS shards. Each shard is mined completely at a local support
lowered in proportion to its share of the bytes; as a phrase that is frequent at all is locally frequent
somewhere, the union of what the shards find has all of them. That union is then counted over the
whole corpus, by the words themselves. A shard may be larger than a task's memory: tasks count pieces of
some megabytes of it and the counts of its pieces are summed by a shuffle, pairs of words first, and
longer phrases only where all their pairs are in the union. Phrases are hashed (64 bits, language included)
while they are sought; hashes that clash and filters that are full let more through, never less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import durable, ship
from quire.session import number_within

SUPPORT, LONGEST, TOP, SCALE, COVER = 100, 5, 2000, 1000, 100
SHARDS = 8  # so few that the local support stays over a tenth of the support
ROWS = 1 << 16  # of a batch


class Sizes(NamedTuple):
    piece: int = 2 << 20  # bytes of text that are counted at once; a longer text is one piece
    slice: int = 1 << 20  # bytes of a long text that are words at once
    slots: int = 1 << 26  # of the filter
    bucket: int = 8 << 20  # bytes of text whose counts are summed in one task


_ODD = np.uint64(0x9E3779B97F4A7C15)
_EDGE = b"."  # stands for the end of a piece of text; no word has one
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


class _Ids(dict):
    """Numbers of the words of one language within a piece."""

    def __init__(self, piece: "Piece", lang: str):
        super().__init__({_EDGE: -1})
        self.piece, self.lang = piece, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.piece.words)
        self.piece.words.append(word)
        self.piece.langs.append(self.lang)
        return n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


class Piece:
    """Words of some texts as numbers, -1 between stretches that no phrase crosses."""

    def __init__(self, sizes: Sizes) -> None:
        self.sizes = sizes
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.by_lang: dict[str, _Ids] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        ids = self.by_lang.get(lang)
        if ids is None:
            ids = self.by_lang[lang] = _Ids(self, lang)
        text = text.translate(_TABLE)
        at = 0
        while at < len(text):
            end = at + self.sizes.slice
            if end < len(text):  # a slice ends behind a space or a mark
                ends = [e for e in (text.find(b" ", end), text.find(b"\n", end)) if e >= 0]
                end = min(ends) + 1 if ends else len(text)
            some = text[at:end].replace(b"\n", b" . ").split()
            self.parts.append(np.fromiter(map(ids.__getitem__, some), "int32", len(some)))
            at = end
        self.parts.append(np.array([-1], "int32"))
        self.size += len(text)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, hash of the word at each place)."""
        from xxhash import xxh64_intdigest

        seeds = {lang: xxh64_intdigest(lang.encode()) & 0x7FFFFFFF for lang in self.by_lang}
        of = np.fromiter((xxh64_intdigest(w, seeds[g]) for w, g in zip(self.words, self.langs)), "uint64", len(self.words))
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, "int32")
        return ids, np.append(of, np.uint64(0))[ids]  # -1 takes the last


def _longer(hashes: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words from those of k - 1 and those of words."""
    return _mix(hashes[:len(words) - k + 1]) + words[k - 1:]


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = _mix(hashes) % np.uint64(64 * len(bits))
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _by_piece(docs: DataFrame, lang: str, text: str, sizes: Sizes, schema: str, fn: Callable[[Piece], dict]) -> DataFrame:
    """One pass over whole texts; fn gives the columns for a piece."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = Piece(sizes)

        def pack() -> Iterator[pa.RecordBatch]:
            rows = pa.RecordBatch.from_pydict({f.name: v if isinstance(v, pa.Array) else pa.array(v, f.type)
                                               for f, v in zip(arrow, fn(piece).values())}, schema=arrow)
            for at in range(0, rows.num_rows, ROWS):  # both sides of the pipe hold a batch at a time
                yield rows.slice(at, ROWS)

        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = t.as_buffer() if hasattr(t, "as_buffer") else None
                piece.add(g, bytes(raw) if raw is not None else b"")
                if piece.size >= sizes.piece:
                    yield from pack()
                    piece = Piece(sizes)
        if piece.parts:
            yield from pack()

    cell = F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")
    return docs.select(cell, F.col(text).alias("text")).mapInArrow(run, kind)


def _local(docs: DataFrame, lang: str, text: str, sizes: Sizes, shards: int, per_shard: int, lengths: tuple[int, ...],
           bits: np.ndarray | None) -> DataFrame:
    """(bucket, hash, n): counts of the phrases of a shard's pieces, packed by bucket of the hash; the bucket -1 - shard has a
    piece's bytes. With `bits`, phrases whose pairs of words are all in it."""
    shared = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def count(piece: Piece) -> dict:
        shard = TaskContext.get().partitionId() % shards
        ids, words = piece.hashes()
        fit, hashes, pairs = ids >= 0, words, None
        out: dict = {"bucket": [-1 - shard], "hash": [b""], "n": [np.array([piece.size], "<i8").tobytes()]}
        for k in range(1, max(lengths) + 1):
            if k > 1:
                hashes, fit = _longer(hashes, words, k), fit[:-1] & (ids[k - 1:] >= 0)
                if k == 2 and shared is not None:
                    pairs = fit & _has(shared.value, hashes)
                if pairs is not None:
                    fit = fit & pairs[k - 2:]
            if not fit.any():
                break
            if k not in lengths:
                continue
            u, n = np.unique(hashes[fit], return_counts=True)
            bucket = (u % np.uint64(per_shard)).astype("int64")
            order = np.argsort(bucket, kind="stable")
            u, n, bucket = u[order], n[order].astype("<u4"), bucket[order]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
            for i, j in zip(starts, [*starts[1:], len(u)]):
                for column, v in zip(out, (shard * per_shard + int(bucket[i]), u[i:j].tobytes(), n[i:j].tobytes())):
                    out[column].append(v)
        return out

    return _by_piece(docs, lang, text, sizes, "bucket long, hash binary, n binary", count)


def _summed(packed: DataFrame, per_shard: int, least: int) -> DataFrame:
    """(shard, hash, n): counts of a shard of at least `least`; a row without hash gives the shard's bytes."""
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        if bucket < 0:
            return pa.table({"shard": pa.array([-1 - bucket], pa.int32()), "hash": pa.nulls(1, pa.int64()), "n": [int(joined("n", "<i8").sum())]})
        hashes, n = joined("hash", "<u8"), joined("n", "<u4")
        order = np.argsort(hashes)
        hashes = hashes[order]
        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        n = np.add.reduceat(n[order].astype("int64"), starts)
        kept = n >= least
        return pa.table({"shard": np.full(kept.sum(), bucket // per_shard, "int32"), "hash": hashes[starts][kept].view("int64"), "n": n[kept]})

    return packed.groupBy("bucket").applyInArrow(run, "shard int, hash long, n long")


def local_supports(support: int, bytes_of: dict[int, int]) -> dict[int, int]:
    """At least 2 (or the support itself), in proportion to each shard's bytes, and so low that a
    phrase below it in every shard is below `support` in all: the sum of (local - 1) is under support."""
    total, spare = sum(bytes_of.values()), support - 1 - len(bytes_of)
    if spare < 0 or not total:
        return {s: 1 for s in bytes_of}
    return {s: 2 + spare * n // total for s, n in bytes_of.items()}


def _frequent(docs: DataFrame, lang: str, text: str, sizes: Sizes, support: int, lengths: tuple[int, ...], bits: np.ndarray | None) -> DataFrame:
    """(hash): the union of what the shards find locally frequent."""
    shards = max(1, min(SHARDS, (support - 1) // 2))
    least = min(2, support) if support - 1 >= shards else 1
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    per_shard = max(1, -(-size // (shards * sizes.bucket)))
    sums = durable(_summed(_local(docs, lang, text, sizes, shards, per_shard, lengths, bits), per_shard, least), "counts")
    share = {r["shard"]: r["n"] for r in sums.where("hash is null").collect()}  # a row a shard
    if not share:
        return sums.select("hash").limit(0)
    local = F.create_map(*[F.lit(x) for pair in local_supports(support, share).items() for x in pair])
    return sums.where(F.col("hash").isNotNull() & (F.col("n") >= local[F.col("shard")])).select("hash")


def _bits(hashes: DataFrame, slots: int, into: np.ndarray | None = None) -> np.ndarray:
    """A filter of so many bits, whatever the number of hashes."""
    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _mix(batch.column(0).to_numpy(zero_copy_only=False).view("uint64")) % np.uint64(slots)
            yield pa.RecordBatch.from_pydict({"slot": np.unique(slot.view("int64"))})

    words = (hashes.mapInArrow(slot, "slot long").groupBy(F.shiftright("slot", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toPandas())
    out = np.zeros(slots // 64, "int64")
    out[words["word"].to_numpy("int64")] = words["bits"].to_numpy("int64")
    return out.view("uint64") if into is None else out.view("uint64") | into


def frequent(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, lang: str = "lang", text: str = "text",
             sizes: Sizes = Sizes()) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to `longest` words that occur at least `support` times, and
    (lang, n), the words of each language. Phrases are counted by their words, exactly."""
    pairs = bits = _bits(_frequent(docs, lang, text, sizes, support, (1, 2), None), sizes.slots)
    if longest > 2:
        bits = _bits(_frequent(docs, lang, text, sizes, support, tuple(range(3, longest + 1)), pairs), sizes.slots, pairs)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def count(piece: Piece) -> dict:
        ids, words = piece.hashes()
        out: dict = {"lang": [], "phrase": [], "size": [], "n": []}
        per = np.bincount(ids[ids >= 0], minlength=len(piece.words))
        totals: dict[str, int] = {}
        for g, n in zip(piece.langs, per.tolist()):
            totals[g] = totals.get(g, 0) + n
        for g, n in totals.items():
            for c, v in zip(out, (g, None, 0, n)):
                out[c].append(v)
        # `rank` numbers the phrases from each place, so a phrase is (rank of all but its last word, last word)
        hashes, rank, many = words, ids, len(piece.words)
        fit = (ids >= 0) & _has(shared.value, words)
        for k in range(1, longest + 1):
            if k > 1:
                hashes = _longer(hashes, words, k)
                fit = fit[:-1] & fit[1:] & (ids[k - 1:] >= 0) & _has(shared.value, hashes)
            at = np.nonzero(fit)[0]
            if not len(at):
                break
            key = rank[at] if k == 1 else rank[at].astype("int64") * many + ids[at + k - 1]
            _, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            rank = np.zeros(len(fit), "int32")
            rank[at] = back
            for place, times in zip(at[first].tolist(), n.tolist()):
                some = ids[place:place + k].tolist()
                out["lang"].append(piece.langs[some[0]])
                out["phrase"].append(b" ".join([piece.words[i] for i in some]))
                out["size"].append(k)
                out["n"].append(times)
        out["phrase"] = pa.array(out["phrase"], pa.binary()).cast(pa.string())
        return out

    counted = durable(_by_piece(docs, lang, text, sizes, "lang string, phrase string, size int, n long", count)
                      .groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f"))
                      .where(F.col("phrase").isNull() | (F.col("f") >= support)), "phrases")
    totals = durable(counted.where("phrase is null").select("lang", F.col("f").alias("n")), "totals")  # a row a language
    return counted.where("phrase is not null"), totals


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase of two or more words, cut where it scores least."""
    many = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = many.select("lang", "phrase", F.col("f").alias("a"), "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda name, f: counts.select(F.col("lang").alias(f"_{f}"), F.col("phrase").alias(f"_{name}"), F.col("f").alias(f))
    both = (cuts.join(side("left", "l"), (F.col("lang") == F.col("_l")) & (F.col("left") == F.col("_left")))
            .join(side("right", "r"), (F.col("lang") == F.col("_r")) & (F.col("right") == F.col("_right")))
            .join(totals.withColumnRenamed("lang", "_n"), F.col("lang") == F.col("_n")))
    # decimals of 38 digits: products stay exact
    big = lambda c: F.col(c).cast("decimal(19,0)")
    over = (big("a") * big("n")).cast("decimal(34,0)") * F.lit(SCALE).cast("decimal(4,0)")
    both = both.withColumn("over", over).withColumn("under", big("l") * big("r")).withColumn("score", F.expr("over div under"))
    best = both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, cover: int = COVER,
                 lang: str = "lang", text: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases.

    Texts (null: empty) are lower-cased in A-Z, cut at [.,;:!?] and line ends, and split at spaces and tabs; a null language is
    `und`. A phrase goes if a longer one that holds it occurs at least `cover` percent as often.
    As every phrase between two occurs no less than the longer one, the phrases one word longer tell. Rows that repeat count again;
    other columns are not read."""
    counts, totals = frequent(docs, support, longest, lang, text, sizes)
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, 1, F.col("size") - 1), " "), F.array_join(F.slice(words, 2, F.col("size") - 1), " "))
    held = (counts.where("size > 2").select(F.col("lang").alias("_lang"), F.explode(inner).alias("_phrase"), "f")
            .groupBy("_lang", "_phrase").agg(F.max("f").alias("longer")))
    left = scored(counts, totals).join(held, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    order = F.struct((-F.col("score")).alias("x"), (-F.col("a")).alias("y"), F.col("phrase").alias("z")).alias("order")
    ranked = number_within(left.select("lang", "phrase", "a", "l", "r", "n", "score", order), ["lang"], "order", "rank")
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
    FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, phrase, k AS size, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
cuts AS (
    SELECT c.lang, phrase, size, f, unnest(range(1, c.size)) AS k, string_split(phrase, ' ') AS w FROM counts c WHERE size > 1),
rated AS (
    SELECT c.lang, c.phrase, c.f AS a, c.k, a1.f AS l, a2.f AS r, t.n,
        CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(a1.f AS HUGEINT) * a2.f) AS BIGINT) AS score
    FROM cuts c JOIN totals t USING (lang)
    JOIN counts a1 ON a1.lang = c.lang AND a1.phrase = array_to_string(list_slice(w, 1, c.k), ' ')
    JOIN counts a2 ON a2.lang = c.lang AND a2.phrase = array_to_string(list_slice(w, c.k + 1, c.size), ' ')),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
    SELECT lang, f, unnest(list_concat(list_transform(range(2, size), lambda m: array_to_string(list_slice(w, 1, m), ' ')),
        flatten(list_transform(range(2, size), lambda m: list_transform(range(2, size - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' ')))))) AS phrase
    FROM cuts WHERE size > 2 AND k = 1),
held AS (SELECT lang, phrase, max(f) AS longer FROM inner_phrases GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
"""
