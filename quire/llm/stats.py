"""Statistics of whole texts, one narrow Arrow pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import arrow_map

WINDOW = 8  # words of a window that may repeat
# White space between words, and the symbols that are counted.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
STOP, SHOUT, REST = b".,;:'\"()-", b"!?", b"+/=@[\\]^_`{}~"

COLUMNS = {  # name: SQL type
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_lines": "long", "n_distinct": "long", "n_bytes": "long", "n_upper": "long", "n_lower": "long", "n_digits": "long",
    "n_stops": "long", "n_shouts": "long", "n_marks": "long", "longest": "long"}


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, the first included."""
    n = len(words)
    if n <= window or len(seen := dict.fromkeys(words)) == n:
        return 0
    for i, w in enumerate(seen):
        seen[w] = i
    rank = np.fromiter(map(seen.__getitem__, words), "int64", n)
    done = 1
    while done < window:  # ranks of twice as many words from the ranks of their halves
        step = min(done, window - done)
        pair = rank[:len(rank) - step] * n + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        done += step
    again = np.bincount(rank)[rank] > 1
    if not again.any():
        return 0
    cover = np.zeros(n + 1, "int64")
    at = np.nonzero(again)[0]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of COLUMNS; all 0 for null and empty texts."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    count = lambda some: len(raw) - len(raw.translate(None, some))
    return (len(words), len(text) - sum(map(text.count, SPACE)), count(SYMBOLS), len(lines) - len(set(lines)),
            repeat_words(words), len(lines), len(set(words)), len(raw), count(UPPER), count(LOWER), count(DIGIT),
            count(STOP), count(SHOUT), count(REST), max(map(len, words), default=0))


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and COLUMNS of each row; repeated rows and null keys stay."""
    fields = {c: docs.schema[c].dataType.simpleString() for c in keep}

    def run(batch: pa.RecordBatch) -> dict:
        rows = [statistics(t.as_py()) for t in batch.column("text")]
        return {c: batch.column(c) for c in keep} | dict(zip(COLUMNS, zip(*rows)))

    schema = ", ".join(f"`{c}` {k}" for c, k in (fields | COLUMNS).items())
    return arrow_map(docs.select(*keep, *(["text"] if "text" not in keep else [])), run, schema)
