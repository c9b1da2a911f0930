"""Hashes of many short stretches of one text at once."""

from __future__ import annotations

import hashlib
from math import sin

import numpy as np

_TURNS = [n for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in four * 4]
_SINES = [int(abs(sin(i + 1)) * 2 ** 32) for i in range(64)]
_START = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476
TOGETHER = 8192  # stretches that are hashed at a time
BLOCK = 56  # bytes of a block of MD5 but for the length; a shorter stretch is one block


def _one_block(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """`md5_heads` of stretches under BLOCK bytes; `flat` goes on for BLOCK bytes behind the last."""
    cells = np.zeros((len(starts), 64), "u1")
    cells[:, :BLOCK] = np.lib.stride_tricks.sliding_window_view(flat, BLOCK)[starts]
    cells[:, :BLOCK][np.arange(BLOCK) >= sizes[:, None]] = 0
    cells[np.arange(len(starts)), sizes] = 0x80
    words = np.ascontiguousarray(cells.view("<u4").T)
    words[14] = sizes * 8
    a, b, c, d = (np.full(len(starts), v, "u4") for v in _START)
    for i, (turn, sine) in enumerate(zip(_TURNS, _SINES)):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g]
        f += np.uint32(sine)
        a, d, c, b = d, c, b, b + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
    return np.stack([a + np.uint32(_START[0]), b + np.uint32(_START[1])], 1).astype("<u4").view("u1")


def md5_heads(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the MD5 of each stretch of the text, a row each. Short ones are hashed side by side."""
    out, sizes = np.zeros((len(starts), 8), "u1"), ends - starts
    flat = np.frombuffer(text + bytes(BLOCK), "u1")
    short, long = np.nonzero(sizes < BLOCK)[0], np.nonzero(sizes >= BLOCK)[0]
    for at in range(0, len(short), TOGETHER):
        some = short[at:at + TOGETHER]
        out[some] = _one_block(flat, starts[some], sizes[some])
    for i in long:
        out[i] = np.frombuffer(hashlib.md5(text[starts[i]:ends[i]]).digest()[:8], "u1")
    return out


def xxh64_values(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The XXH64 of each stretch, as Spark seeds it, highest byte first."""
    from xxhash import xxh64_digest

    digests = b"".join(xxh64_digest(text[i:j], 42) for i, j in zip(starts.tolist(), ends.tolist()))
    return np.frombuffer(digests, "u1").reshape(-1, 8)
