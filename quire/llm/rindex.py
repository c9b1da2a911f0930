"""A run-length index of texts: the Burrows-Wheeler transform as runs, with the places of the first
and last row of each run, and thresholds between neighbouring runs of one byte. Matching statistics
are streamed through it for many patterns side by side."""

from __future__ import annotations

import numpy as np

SYMBOL = 9  # bits: 0 ends a text, a byte b is b + 1
PACK = 7  # symbols of a key
DEPTH = 19 * PACK  # common prefixes are told apart up to here


def _keys(s: np.ndarray) -> np.ndarray:
    padded = np.concatenate([s + s.dtype.type(1), np.zeros(PACK, s.dtype)]).astype("uint64")  # 0: past the end
    key = np.zeros(len(s), "uint64")
    for j in range(PACK):
        key = (key << np.uint64(SYMBOL)) | padded[j:j + len(s)]
    return key


def suffix_array(s: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(s)
    sa = np.argsort(keys, kind="stable")
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(keys[sa[1:]], keys[sa[:-1]], out=new[1:])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, "int64")
    rank[n] = -1
    rank[sa] = first
    slots = np.nonzero(~(new & np.append(new[1:], True)))[0]
    h = PACK
    while len(slots):
        tied = sa[slots]
        key = rank[tied] * (n + 1) + rank[np.minimum(tied + h, n)] + 1
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        sa[slots] = tied
        new = np.append(True, key[1:] != key[:-1])
        rank[tied] = slots[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def _common(sa: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order, up to DEPTH."""
    n = len(sa)
    padded = np.append(keys, np.zeros(DEPTH + PACK, "uint64"))
    out = np.zeros(n, "uint8")
    rows = np.arange(1, n)
    for t in range(0, DEPTH, PACK):
        x = padded[sa[rows] + t] ^ padded[sa[rows - 1] + t]
        same = sum(((x >> np.uint64(SYMBOL * (PACK - j))) == 0).astype("uint8") for j in range(1, PACK + 1))
        out[rows] += same
        rows = rows[same == PACK]
        if not len(rows):
            break
    return out


class RunIndex:
    def __init__(self, texts: list[bytes]):
        size = sum(len(t) + 1 for t in texts)
        s = np.zeros(size, "uint16")
        at, self.begins = 0, []
        for t in texts:
            s[at:at + len(t)] = np.frombuffer(t, "uint8")
            s[at:at + len(t)] += 1
            self.begins.append(at)
            at += len(t) + 1
        keys = _keys(s)
        sa = suffix_array(s, keys)
        bwt = s[sa - 1]
        head = np.append(True, bwt[1:] != bwt[:-1])
        self.start = np.nonzero(head)[0]
        self.last = np.append(self.start[1:], size) - 1
        self.symbol = bwt[self.start].astype("int64")
        back = np.empty(size, "int64")
        back[np.argsort(bwt, kind="stable")] = np.arange(size)
        self.back = back[self.start]  # where the first row of a run goes
        self.first_at, self.last_at = sa[self.start], sa[self.last]
        self.r = len(self.start)
        code = self.symbol * (self.r + 1) + np.arange(self.r)
        self.by_symbol = np.sort(code)
        run = self.by_symbol % (self.r + 1)
        self.run_of = run
        same = np.append(False, self.by_symbol[1:] // (self.r + 1) == self.by_symbol[:-1] // (self.r + 1))
        self.has_above = same  # a run of the same symbol comes before
        self.threshold = np.zeros(self.r, "int64")
        k = np.nonzero(same)[0]
        self.threshold[k] = self._least(_common(sa, keys), self.last[run[k - 1]] + 1, self.start[run[k]])

    @staticmethod
    def _least(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first place of the least value of common[a..b], for each pair."""
        levels = [common]
        while 2 << (len(levels) - 1) <= len(common):
            w = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-w], levels[-1][w:]))
        width = b - a + 1
        level = np.floor(np.log2(np.maximum(width, 1))).astype(int)
        least = np.empty(len(a), common.dtype)
        for v in np.unique(level):
            of = level == v
            least[of] = np.minimum(levels[v][a[of]], levels[v][b[of] - (1 << int(v)) + 1])
        at = a.copy()
        for v in range(len(levels) - 1, -1, -1):
            w = 1 << v
            fits = at + w - 1 <= b
            i = np.nonzero(fits)[0]
            i = i[levels[v][at[i]] > least[i]]
            at[i] += w
        return at

    def stream(self, s: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each byte of the patterns s[end - size : end], the place in the indexed texts of a longest
        match (up to DEPTH) of what begins there; -1 where the byte occurs in no text. The patterns are
        read backwards together, the longest first."""
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = ends[order], sizes[order]
        out = np.full(len(s), -1, "int64")
        row = np.zeros(len(ends), "int64")
        place = np.full(len(ends), self.first_at[0], "int64")
        run = np.zeros(len(ends), "int64")
        live = len(ends)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[live - 1] <= t:
                live -= 1
            at = ends[:live] - 1 - t
            c = s[at].astype("int64") + 1
            r, p = run[:live], row[:live]
            goes = self.symbol[r] == c
            place[:live] -= 1
            np.copyto(p, self.back[r] + p - self.start[r], where=goes)
            no = np.nonzero(~goes)[0]
            if len(no):
                code = c[no] * (self.r + 1) + r[no]
                k = np.searchsorted(self.by_symbol, code)
                inside = np.minimum(k, self.r - 1)
                below = (k < self.r) & (self.by_symbol[inside] // (self.r + 1) == c[no])
                up = np.maximum(k - 1, 0)
                above = (k > 0) & (self.by_symbol[up] // (self.r + 1) == c[no])
                take = above & (~below | (row[no] < self.threshold[inside]))
                chosen = self.run_of[np.where(take, up, inside)]
                none = ~above & ~below
                row[no] = self.back[chosen] + np.where(take, self.last[chosen] - self.start[chosen], 0)
                place[no] = np.where(take, self.last_at[chosen], self.first_at[chosen]) - 1
                lost = no[none]
                row[lost], place[lost] = 0, self.first_at[0]
            run[:live] = np.searchsorted(self.start, row[:live], "right") - 1
            out[at] = place[:live]
            if len(no):
                out[at[lost]] = -1
        return out
