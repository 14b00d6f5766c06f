"""Words and word shingles of many texts at once, as numpy arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.ones(n, dtype=U)
        out[1:] = base % (1 << 64)
        return np.cumprod(out)


def powers_upto(base: int, n: int) -> np.ndarray:
    return powers(base, 1 << max(16, n.bit_length()))[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """S[i] = sum of (byte + 1) * BASE**j over j < i; the hash of bytes a..b is (S[b] - S[a]) / BASE**a."""
    with np.errstate(over="ignore"):
        return np.r_[U(0), np.cumsum((data.astype(U) + U(1)) * powers_upto(BASE, len(data)))]


def joined(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank behind each, and where each starts."""
    data = b" ".join([*texts, b""])
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.frombuffer(data.translate(LOWER) if lower else data, dtype=np.uint8), np.cumsum(lens) - lens


def words(data: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of its text."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.searchsorted(text_starts, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    s = prefix_hashes(data)
    with np.errstate(over="ignore"):
        return mix((s[ends] - s[starts]) * powers_upto(BASE_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U))


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 64-bit shingle, count), ordered by text and shingle. A text of fewer words than ``size``
    has one shingle of all its words; one without words has none."""
    data, text_starts = joined(texts)
    starts, ends, text = words(data, text_starts)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int64)
    h = word_hashes(data, starts, ends)
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    last = first + n
    at = np.flatnonzero(np.arange(len(h)) < (last - np.minimum(n, size) + 1)[text])
    out = np.zeros(len(at), dtype=U)
    with np.errstate(over="ignore"):
        for j in range(size):
            there = at + j < last[text[at]]
            out = out * U(0xD6E8FEB86659FD93) + np.where(there, h[np.minimum(at + j, len(h) - 1)], U(j + 1))
    out, text = mix(out), text[at]
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    new = np.flatnonzero(np.r_[True, (out[1:] != out[:-1]) | (text[1:] != text[:-1])])
    return text[new], out[new], np.diff(np.r_[new, len(out)])
