"""Elias-Fano coded monotone sequences and a three-level n-gram trie over them, in numpy."""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np

U = np.uint64
#: Numbers that a search decodes at a time.
CHUNK = 16_384


def select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one of each 64-bit word."""
    place = np.zeros(len(words), dtype=np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = words & U((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = k >= ones
        words = np.where(up, words >> U(width), low)
        k = k - np.where(up, ones, 0)
        place += np.where(up, width, 0)
    return place


class EliasFano:
    """A non-decreasing sequence of n numbers below ``universe`` in about 2 + log2(universe / n) bits each:
    low bits side by side, high bits in unary."""

    def __init__(self, arrays: dict[str, np.ndarray], n: int, bits: int):
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]
        self.n, self.bits = n, bits

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        high = np.zeros(((max(0, universe - 1) >> bits) + n) // 64 + 2, dtype=U)
        at = (values >> bits) + np.arange(n)
        np.bitwise_or.at(high, at >> 6, U(1) << (at & 63).astype(U))
        low = np.zeros(n * bits // 64 + 2, dtype=U)
        if bits:
            rest = (values & ((1 << bits) - 1)).astype(U)
            bit = np.arange(n) * bits
            word, shift = bit >> 6, (bit & 63).astype(U)
            np.bitwise_or.at(low, word, rest << shift)
            over = np.flatnonzero((bit & 63) + bits > 64)
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (U(64) - shift[over]))
        return cls({"low": low, "high": high, "ones": np.cumsum(np.bitwise_count(high).astype(np.int64))}, n, bits)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones}

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.int64)
        bit = i * self.bits
        word, shift = bit >> 6, (bit & 63).astype(U)
        both = self.low[word] >> shift
        over = np.where(shift > 0, self.low[word + 1] << (U(64) - np.maximum(shift, U(1))), U(0))
        return ((both | over) & U((1 << self.bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right")
        before = np.where(word > 0, self.ones[np.maximum(word - 1, 0)], 0)
        place = word * 64 + select_in_word(self.high[word], i - before)
        return ((place - i) << self.bits) | self.lows(i)

    def decoded(self, first: int, last: int) -> np.ndarray:
        """The numbers first .. last - 1."""
        if last <= first:
            return np.empty(0, dtype=np.int64)
        word = int(np.searchsorted(self.ones, first, side="right"))
        stop = int(np.searchsorted(self.ones, last - 1, side="right")) + 1
        place = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high[word:stop]).view(np.uint8), bitorder="little"))
        skip = first - (int(self.ones[word - 1]) if word else 0)
        i = np.arange(first, last)
        return ((place[skip:skip + last - first] + word * 64 - i) << self.bits) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each ``x`` (not negative), -1 where it is not in the sequence. The queries are taken in order;
        a chunk is decoded when some fall into it, and gives the first number not below each of them."""
        out = np.full(len(x), -1, dtype=np.int64)
        if not self.n or not len(x):
            return out
        order = None if (x[1:] >= x[:-1]).all() else np.argsort(x, kind="stable")
        q = x if order is None else x[order]
        heads = np.arange(0, self.n, CHUNK)
        cut = np.r_[np.searchsorted(q, self.access(heads)), len(q)]
        found = np.full(len(q), -1, dtype=np.int64)
        for k in np.flatnonzero(cut[1:] > cut[:-1]):
            some = q[cut[k]:cut[k + 1]]
            values = self.decoded(int(heads[k]), min(self.n, int(heads[k]) + CHUNK))
            at = np.searchsorted(values, some)
            at[at == len(values)] = 0
            found[cut[k]:cut[k + 1]] = np.where(values[at] == some, at + heads[k], -1)
        if order is None:
            return found
        out[order] = found
        return out


def code(x: np.ndarray) -> np.ndarray:
    """Positive numbers as 16-bit steps of their logarithm; 0 stands for nothing."""
    return (1 + np.rint((np.log10(x) + 12) * (65534 / 24))).astype(np.uint16)


def decode(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, 10.0 ** ((c.astype(np.float64) - 1) * (24 / 65534) - 12), 0.0)


class Trie:
    """Trigrams (u, v, w) below their middle word v. Level 1 holds the v; below each v stand its contexts u
    (level 2, with the count of u v) and its successors w. Level 3 names a trigram by its context and by the
    rank of w among the successors of v, a number that is small however large the vocabulary is."""

    SEQUENCES = ("middle", "contexts", "successors", "grams", "context_start", "successor_start", "gram_start")

    def __init__(self, sequences: dict[str, EliasFano], counts: np.ndarray, probabilities: np.ndarray, words: int):
        self.__dict__.update(sequences)
        self.counts, self.probabilities, self.words = counts, probabilities, words

    @classmethod
    def build(cls, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, none: int, prior: float) -> Trie:
        """From distinct trigrams ordered by (v, u, w) with counts above 0; w = ``none`` only counts its context."""
        words = int(max(u.max(initial=0), v.max(initial=0), w.max(initial=0))) + 1
        middle, k = np.unique(v, return_inverse=True)
        new = np.r_[True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])] if len(v) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        context = np.cumsum(new) - 1
        count = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        real = w != none
        pairs = np.unique(k[real] * words + w[real])
        start = lambda owner: np.r_[0, np.cumsum(np.bincount(owner, minlength=len(middle)))]
        context_start, successor_start = start(k[first]), start(pairs // words)
        several = np.diff(successor_start)
        gram_start = np.r_[0, np.cumsum(np.diff(context_start) * several)]
        rank = np.searchsorted(pairs, k[real] * words + w[real]) - successor_start[k[real]]
        grams = gram_start[k[real]] + (context[real] - context_start[k[real]]) * several[k[real]] + rank
        made = {"middle": (middle, words), "contexts": (k[first] * words + u[first], len(middle) * words), "successors": (pairs, len(middle) * words),
                "grams": (grams, int(gram_start[-1])), "context_start": (context_start, len(first) + 1), "successor_start": (successor_start, len(pairs) + 1),
                "gram_start": (gram_start, int(gram_start[-1]) + 1)}
        return cls({name: EliasFano.build(x, top) for name, (x, top) in made.items()}, code(count.astype(float)),
                   code(n[real] / (count[context[real]] + prior)), words)

    def look_up(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the count of each context (u, v) and of the probability of w in it; 0: not seen."""
        known = (u < self.words) & (v < self.words)
        runs = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
        k = np.repeat(self.middle.find(v[runs]), np.diff(np.r_[runs, len(v)]))
        k = np.where(known, k, -1)
        counts, probabilities = np.zeros(len(u), dtype=np.uint16), np.zeros(len(u), dtype=np.uint16)
        at = np.flatnonzero(k >= 0)
        new = np.r_[True, (u[at][1:] != u[at][:-1]) | (v[at][1:] != v[at][:-1])] if len(at) else np.zeros(0, bool)
        context = self.contexts.find((k[at] * self.words + u[at])[new])[np.cumsum(new) - 1] if len(at) else np.zeros(0, np.int64)
        at, context = at[context >= 0], context[context >= 0]
        counts[at] = self.counts[context]
        go = w[at] < self.words
        at, context = at[go], context[go]
        place = self.successors.find(k[at] * self.words + w[at])
        at, context, place = at[place >= 0], context[place >= 0], place[place >= 0]
        own, back = np.unique(k[at], return_inverse=True)
        first, last = self.successor_start.access(own), self.successor_start.access(own + 1)
        base, contexts = self.gram_start.access(own), self.context_start.access(own)
        found = self.grams.find(base[back] + (context - contexts[back]) * (last - first)[back] + place - first[back])
        probabilities[at[found >= 0]] = self.probabilities[found[found >= 0]]
        return counts, probabilities

    def save(self, path: str) -> None:
        arrays = {f"{s}.{a}": x for s in self.SEQUENCES for a, x in getattr(self, s).arrays().items()} | {"counts": self.counts, "probabilities": self.probabilities}
        spec, at = {"words": self.words, "sizes": {s: [getattr(self, s).n, getattr(self, s).bits] for s in self.SEQUENCES}, "arrays": {}}, 0
        for name, x in arrays.items():
            spec["arrays"][name] = [at, len(x), x.dtype.str]
            at += -(-x.nbytes // 8) * 8
        head = json.dumps(spec).encode()
        with open(path, "wb") as f:
            f.write(len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8))
            for x in arrays.values():
                f.write(x.tobytes() + b"\0" * (-x.nbytes % 8))

    @classmethod
    def load(cls, path: str) -> Trie:
        """The trie with its levels memory-mapped."""
        m = np.memmap(path, dtype=np.uint8, mode="r")
        size = int.from_bytes(m[:8].tobytes(), "little")
        spec, base = json.loads(m[8:8 + size].tobytes()), 8 + size + -size % 8
        x = {name: m[base + at:base + at + n * np.dtype(kind).itemsize].view(kind) for name, (at, n, kind) in spec["arrays"].items()}
        return cls({s: EliasFano({a: x[f"{s}.{a}"] for a in ("low", "high", "ones")}, *spec["sizes"][s]) for s in cls.SEQUENCES}, x["counts"], x["probabilities"], spec["words"])

    def mapped(self) -> Trie:
        """The same trie, mapped from a file that goes as soon as the mapping does."""
        handle, path = tempfile.mkstemp(suffix=".trie")
        os.close(handle)
        try:
            self.save(path)
            return Trie.load(path)
        finally:
            os.unlink(path)
