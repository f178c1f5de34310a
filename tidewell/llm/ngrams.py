"""Hashed byte n-gram features of whole texts (numpy)."""

from __future__ import annotations

import numpy as np

from . import words


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def hashed_ngrams(data: bytes, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """A number below 2**bits for each n-gram of each size, white space read as one kind of byte."""
    if not data:
        return np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8)
    b = np.where(words._SPACE[b], np.uint8(32), b).astype(np.uint64)
    b = np.concatenate(([np.uint64(32)], b, [np.uint64(32)]))
    out, code = [], np.zeros(len(b), np.uint64)
    for n in range(1, max(sizes) + 1):
        if len(b) < n:
            break
        code = b[n - 1 :] if n == 1 else code[: len(b) - n + 1] * np.uint64(257) + b[n - 1 :]
        if n in sizes:
            mixed = (code + np.uint64(n * 0x517CC1B727220A95 % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def distinct(data: bytes, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    h = np.sort(hashed_ngrams(data, sizes, bits).astype(np.int32))
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def count_matrix(texts: list[str | None], sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text (float32)."""
    out = np.zeros((len(texts), 1 << bits), np.float32)
    for i, t in enumerate(texts):
        h = hashed_ngrams(lowered(t), sizes, bits)
        if len(h):
            out[i] = np.bincount(h, minlength=1 << bits)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
