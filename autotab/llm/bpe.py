"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

The distinct pre-token words of a slice of documents lie behind each other in one flat
symbol array. A round looks up every adjacent pair in the sorted array of packed pair keys
(``searchsorted``), takes each word's lowest rank by a segmented minimum and merges all
non-overlapping places of that pair, left to right. Words without a mergeable pair leave
the array. Nothing is trained; the vocabulary file is a parameter.

Cases: a NULL text is the empty text and has no ids; an empty table gives an empty table;
repeated rows are encoded each; the other columns pass through untouched, whatever their
names (one called like the output column is replaced). Texts are encoded whole;
special tokens of the file that stand in a text get their own ids, as the tokenizers library
does by default.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import map_texts, table

#: Fixed value: the published pre-token pattern of this family of vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a Python worker keeps between slices; beyond it the memory starts anew.
CACHE_WORDS = 400_000
NO_RANK = np.iinfo(np.int64).max


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Vocabulary file as arrays: sorted packed pairs, their ranks and merged ids, the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        order = np.argsort(left << 32 | right)
        self.keys, self.ranks, self.made = (left << 32 | right)[order], order.astype(np.int64), made[order]
        born = np.full(max(max(vocab.values()), *self.special.values(), 0) + 1, -1, dtype=np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        # with every symbol made before it is merged further, all places of a pair can merge in one round
        self.ordered = bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())
        self.first = np.zeros(256, dtype=np.int64)
        self.pieces = [b""] * len(born)
        for token, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in token)
            if len(token) == 1:
                self.first[letters[token]] = i
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.pre_token = regex.compile(PRE_TOKEN)
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)
        self.piece_sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.forget()

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NO_RANK: none) and its place among the sorted keys."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], NO_RANK), at

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the (non-empty) words behind each other, and how many each word has."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        rank, at = np.full(len(sym), NO_RANK), np.zeros(len(sym), dtype=np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])  # the last symbol of a word starts no pair
        rank[inner], at[inner] = self.ranks_of(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            low = np.minimum.reduceat(rank, starts)
            going = low != NO_RANK
            if not going.all():
                rest = np.repeat(~going, sizes)
                done.append((word[rest], sym[rest]))
                sym, word, rank, at, low, sizes = sym[~rest], word[~rest], rank[~rest], at[~rest], low[going], sizes[going]
                if not len(sym):
                    break
            # in a run of neighbouring places (a a a ...) every second one merges, from the left
            places = np.flatnonzero(rank == np.repeat(low, sizes))
            fresh = np.r_[True, places[1:] != places[:-1] + 1]
            runs = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - runs) % 2 == 0]
            if not self.ordered:
                places = places[np.r_[True, word[places[1:]] != word[places[:-1]]]]
            sym[places] = self.made[at[places]]
            keep = np.ones(len(sym), dtype=bool)
            keep[places + 1] = False
            places = places - np.arange(len(places))
            sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
            # only pairs beside a merged symbol have changed
            near = np.zeros(len(sym), dtype=bool)
            near[places] = near[places[places > 0] - 1] = True
            rank[near] = NO_RANK
            redo = np.flatnonzero(near)
            redo = redo[redo < len(sym) - 1]
            redo = redo[word[redo] == word[redo + 1]]
            rank[redo], at[redo] = self.ranks_of(sym[redo], sym[redo + 1])
        if not done:
            return np.empty(0, np.int64), lens
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def forget(self) -> None:
        self.cache = {t: i for i, t in enumerate(self.special)}
        self.known, self.sizes = np.array(list(self.special.values()), np.int64), np.ones(len(self.special), np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts behind each other, and how many each text has."""
        cut, cache = self.pre_token.findall, self.cache
        words, ends = [], []
        for t in texts:
            if self.special and any(x in t for x in self.special):
                for k, part in enumerate(self.split_special.split(t)):
                    words += [part] if k % 2 else cut(part)
            else:
                words += cut(t)
            ends.append(len(words))
        new = list(set(words).difference(cache))
        if len(cache) + len(new) > CACHE_WORDS:
            self.forget()
            cache = self.cache
            new = list(set(words).difference(cache))
        ids, sizes = self.merge_words([w.encode() for w in new])
        cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
        self.known, self.sizes = np.concatenate([self.known, ids]), np.concatenate([self.sizes, sizes])
        which = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        out = gather(self.known, np.cumsum(self.sizes) - self.sizes, self.sizes, which)
        upto = np.r_[0, np.cumsum(self.sizes[which])]
        return out, np.diff(upto[np.r_[0, np.array(ends, dtype=np.int64)]])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of the ids that lie behind each other, ``counts`` of them in each text."""
        data = gather(self.piece_bytes, self.piece_starts, self.piece_sizes, ids).tobytes()
        upto = np.r_[0, np.cumsum(self.piece_sizes[ids])][np.r_[0, np.cumsum(counts)]].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(upto[:-1], upto[1:], strict=True)]


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces ``which`` of ``values`` behind each other."""
    n = sizes[which]
    shift = starts[which] - (np.cumsum(n) - n)
    return values[np.repeat(shift, n) + np.arange(int(n.sum()))]


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` without ``text``, with the ids of its texts as ``out`` (array<int>)."""
    rest = [c for c in docs.columns if c not in (text, out)]
    src = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(text), F.lit("")).alias(text))
    schema = StructType([*src.drop(text).schema, StructField(out, ArrayType(IntegerType()))])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = merge_table(path).encode(b.column(b.num_columns - 1).to_pylist())
        values = pa.array(ids.astype(np.int32))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, values)], names=[*b.schema.names[:-1], out])

    return map_texts(src, run, schema, text)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its ``ids`` as ``out``; NULL ids give the empty text."""
    df = df.drop(out)
    schema = StructType([*df.schema, StructField(out, StringType())])
    at = df.columns.index(ids)

    def run(batches):
        m = merge_table(path)
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                x = part.column(at)
                texts = m.decode(x.flatten().to_numpy(), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return decode(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
