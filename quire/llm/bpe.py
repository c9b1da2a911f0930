"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled one after the other. The automaton starts as one state with a loop for each
byte; its arcs are tokens and its paths are the token sequences of a text. The gadget of a merge
`u v -> w` splits the state that `u` leads to: `u` now leads to a copy without the arc `v`, and
every state that has an arc `u` gets an arc `w` to where `v` led. What is left after all merges is
deterministic and has exactly one path for each byte string, the one that BPE gives.

All arcs of a token lead to one state, so a state is stored as what its gadgets took away: the arc
`v` was cut at merge k, inherited from the tokens on the right edge of the merge tree up to the
merge that left them. The row of arcs of a state is filled in as arcs are asked for.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import arrow_map, tokenizer_path

# Fixed value: the pre-split of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the same for ASCII texts, where it runs faster.
ASCII_SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-Z]+| ?[0-9]+| ?[^\t-\r a-zA-Z0-9]+"
               r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
KEPT_UNITS = 600_000  # entries of a worker's cache of encoded units; it starts anew when full
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for
    themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        letter = byte_letters()
        size = max([*vocabulary.values(), *added.values()]) + 1
        self.added = dict(sorted(added.items(), key=lambda x: -len(x[0])))
        self.label: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.label[i] = bytes(letter[c] for c in token)
        for token, i in added.items():
            self.label[i] = token.encode()
        self.born = [0] * size  # the merge that made the token, from 1; 0: a byte
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.cut: list[dict[int, int]] = [{} for _ in range(size)]  # u: {v: merge that cut arc v behind u}
        self.row: list[dict[int, bool]] = [{} for _ in range(size)]
        self.arc = {self.label[i]: i for t, i in vocabulary.items() if len(t) == 1}
        live = set(self.arc.values())
        for k, (left, right) in enumerate(merges, 1):
            u, v, w = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if u in live and v in live and w not in live and self._open(u, v):
                self.cut[u][v] = k
                self.born[w], self.parts[w] = k, (u, v)
                self.arc[self.label[w]] = w
                live.add(w)
        self.row = [{} for _ in range(size)]
        self.reach: dict[bytes, int] = {}  # first four bytes: length of the longest token
        for b in self.arc:
            if len(b) >= 4:
                self.reach[b[:4]] = max(self.reach.get(b[:4], 4), len(b))

    def _open(self, a: int, b: int) -> bool:
        """Whether the state behind token a has an arc b: no gadget cut a token on the left edge of
        b, before b's was put on it, behind a token on the right edge of a, before a's left it."""
        until = NEVER
        while True:
            cut = self.cut[a]
            if cut:
                c, before = b, NEVER
                while True:
                    k = cut.get(c)
                    if k is not None and k < until and k <= before:
                        return False
                    if not self.parts[c]:
                        break
                    before, c = self.born[c], self.parts[c][0]
            if not self.parts[a]:
                return True
            until, a = self.born[a], self.parts[a][1]

    def path(self, word: bytes) -> list[int]:
        """The arcs of the one path that spells the word. The longest arc is tried first; a place
        from which none goes on is left for good, as each prefix has one path only."""
        whole = self.arc.get(word)
        if whole is not None:
            return [whole]
        n, at, out, dead = len(word), 0, [], set()
        arc, row, reach = self.arc, self.row, self.reach
        end = min(n, reach.get(word[:4], 3))
        while at < n:
            known = row[out[-1]] if out else None
            while end > at:
                t = arc.get(word[at:end])
                if t is not None and end not in dead:
                    if known is None:
                        break
                    ok = known.get(t)
                    if ok is None:
                        ok = known[t] = self._open(out[-1], t)
                    if ok:
                        break
                end -= 1
            if end > at:
                out.append(t)
                at = end
                end = min(n, at + reach.get(word[at:at + 4], 3))
            else:
                dead.add(at)
                end = at - 1
                at -= len(self.label[out.pop()])
        return out


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return Automaton(spec["model"]["vocab"], merges, {x["content"]: x["id"] for x in spec["added_tokens"]})


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Coder:
    """Texts to ids and back, with the cache that a worker keeps."""

    def __init__(self, path: str):
        import regex

        self.auto = automaton(path)
        self.split = regex.compile(SPLIT).findall
        self.split_ascii = re.compile(ASCII_SPLIT).findall
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.special = re.compile("|".join(map(re.escape, self.auto.added))) if self.auto.added else None
        self.decimal = [str(i) for i in range(len(self.auto.label))]

    def presplit(self, text: str) -> list[str]:
        """Letters newer than a Unicode version are told apart by the library that defines the split."""
        if text.isascii():
            return self.split_ascii(text)
        if max(text) < "ɐ":
            return self.split(text)
        from tokenizers import pre_tokenizers

        cuts = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in cuts]

    def unit(self, text: str) -> bytes:
        out = []
        for word in self.presplit(text):
            got = self.words.get(word)
            if got is None:
                got = packed(self.auto.path(word.encode()))
                if len(word) <= 64:
                    self.words[word] = got
            out.append(got)
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        """A word never reaches over a space that a non-space follows, so the pieces between single
        spaces are encoded on their own and kept."""
        pieces = text.split(" ")
        if "" in pieces[1:] or any(p[0].isspace() for p in pieces[1:]):
            return self.unit(text)
        units = self.units
        if len(units) > KEPT_UNITS:
            units.clear()
        if len(self.words) > KEPT_UNITS:
            self.words.clear()
        out = [self.unit(pieces[0])]
        for piece in pieces[1:]:
            got = units.get(piece)
            if got is None:
                if piece.isalpha() and piece.isascii():
                    got = packed(self.auto.path(b" " + piece.encode()))
                else:
                    got = self.unit(" " + piece)
                if len(piece) <= 64:
                    units[piece] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; none for a null or empty text. The strings
        of added tokens in a text are those tokens."""
        if not text:
            return b""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            if m.start() > at:
                out.append(self.plain(text[at:m.start()]))
            out.append(packed([self.auto.added[m[0]]]))
            at = m.end()
        if at < len(text):
            out.append(self.plain(text[at:]))
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, one after the other; bytes that are no UTF-8 become U+FFFD."""
        label = self.auto.label
        raw = b"".join([label[i] for i in ids])
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(key, ids array<int>). A narrow pass. Null and empty texts have no ids; repeated rows give
    repeated rows, null keys stay, and no other column is read."""
    path = tokenizer or tokenizer_path()

    def run(batch: pa.RecordBatch) -> dict:
        code = coder(path)
        ids = [np.frombuffer(code.encode(t), dtype="<u4") for t in batch.column(1).to_pylist()]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("int32")
        return {key: batch.column(0),
                "ids": pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(ids).astype("int32")))}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), run, f"`{key}` {kind}, ids array<int>")


def decode(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """(key, text) of lists of ids; a null list gives a null text. An id outside the vocabulary is
    an error."""
    path = tokenizer or tokenizer_path()

    def run(batch: pa.RecordBatch) -> dict:
        code = coder(path)
        return {key: batch.column(0),
                "text": [None if x is None else code.decode(x).decode() for x in batch.column(1).to_pylist()]}

    kind = tokens.schema[key].dataType.simpleString()
    return arrow_map(tokens.select(key, ids), run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """`encode` and `decode` of whole texts in one pass: doc_id, n_tokens, ids_sha256 (of the decimal
    ids joined by commas) and decoded_sha256 (of the text that the ids decode to)."""
    path = tokenizer or tokenizer_path()

    def run(batch: pa.RecordBatch) -> dict:
        code = coder(path)
        decimal, out = code.decimal, {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch.column(1):
            ids = np.frombuffer(code.encode(text.as_py()), dtype="<u4").tolist()
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(code.decode(ids)).hexdigest())
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run,
                     f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
