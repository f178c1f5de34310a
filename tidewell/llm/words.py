"""Vectorised word and shingle digests over UTF-8 bytes (numpy, no loop per word).

Words are digested by 8-byte blocks: each block is put through a 64-bit finaliser on top of what
came before, so a digest isn't a sum over places and no pair of words collides by construction.
Two differently keyed halves make 128 bits; words of more than ``SHORT`` bytes have theirs from blake2b.
"""

from __future__ import annotations

import hashlib

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Longer words are digested one by one.
SHORT = 128
#: Keys of the two halves of a digest.
KEYS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class Runs:
    """Runs ``buf[starts[i]:ends[i]]`` of a byte buffer, read by blocks of 8 bytes."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.concatenate((buf, np.zeros(8, np.uint8)))
        self._at = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
        self.starts, self.size, self.data = np.asarray(starts, np.int64), np.asarray(ends - starts, np.int64), padded

    def __len__(self) -> int:
        return len(self.starts)

    def block(self, which: np.ndarray, k: int) -> np.ndarray:
        """Block k of the runs at places ``which`` (all longer than 8k bytes), zeros after their ends."""
        return self._at[self.starts[which] + 8 * k] & _MASK[np.minimum(self.size[which] - 8 * k, 8)]

    def bytes(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.size[i]].tobytes()

    def levels(self, which: np.ndarray):
        """(k, places in ``which``) of the runs that have a block k, for runs of at most SHORT bytes."""
        live, k = np.flatnonzero((self.size[which] > 0) & (self.size[which] <= SHORT)), 0
        while len(live):
            yield k, live
            k += 1
            live = live[self.size[which[live]] > 8 * k]

    def digests(self, halves: int = 1) -> list[np.ndarray]:
        """One or two independent 64-bit digests of each run."""
        out = [mix(self.size.astype(np.uint64) + KEYS[h]) for h in range(halves)]
        for k, live in self.levels(np.arange(len(self))):
            b = self.block(live, k)
            for h in range(halves):
                out[h][live] = mix((out[h][live] ^ b) + KEYS[h])
        for i in np.flatnonzero(self.size > SHORT).tolist():
            d = hashlib.blake2b(self.bytes(i), digest_size=16).digest()
            for h in range(halves):
                out[h][i] = int.from_bytes(d[8 * h : 8 * h + 8], "little")
        return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def join_texts(texts: list[bytes], sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by ``sep``, and where each text starts in it."""
    buf = np.frombuffer(sep.join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + len(sep) for t in texts[:-1]], out=starts[1:])
    return buf, starts


def word_digests(texts: list[bytes], halves: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """Digests of the words (runs without white space) of all texts, and each text's number of them."""
    if not texts:
        return [np.zeros(0, np.uint64)] * halves, np.zeros(0, np.int64)
    buf, at = join_texts(texts)
    word = ~_SPACE[buf]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = np.diff(np.append(np.searchsorted(starts, at), len(starts)))
    return Runs(buf, starts, ends).digests(halves), n


def distinct_pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Distinct pairs by the first number and then the second: a row of firsts and a row of seconds."""
    order = np.argsort(high)
    high, low = high[order], low[order]
    same = high[1:] == high[:-1]
    if (same & (low[1:] != low[:-1])).any():  # equal halves that belong to different pairs
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        same = high[1:] == high[:-1]
    new = np.concatenate(([True], ~(same & (low[1:] == low[:-1]))))
    return np.stack((high[new], low[new]))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Distinct 128-bit digests of the word shingles of each text: a row of high and a row of low halves.

    A-Z are lowered; words are what stands between white space. A text of fewer words than
    ``width`` has one shingle, its whole sequence; a text without words has none.
    """
    halves, counts = word_digests([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    out, at = [], 0
    for n in counts.tolist():
        if not n:
            out.append(np.zeros((2, 0), np.uint64))
            continue
        k = min(n, width)
        made = []
        for h, key in zip(halves, KEYS, strict=True):
            w = h[at : at + n]
            s = np.full(n - k + 1, np.uint64(k), np.uint64)
            for i in range(k):  # digests are as good as random, so weights by place keep orders apart
                s = s * key + w[i : n - k + 1 + i]
            made.append(mix(s))
        out.append(distinct_pairs(*made))
        at += n
    return out
