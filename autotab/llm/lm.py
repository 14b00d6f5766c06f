"""Language-model scores from a trigram model in Elias-Fano tries.

Texts are read once into blocks: the block's distinct words (64-bit hashes) and its tokens as
numbers into them. Word counts and ids come from word shards (by hash): a block sends each shard
its distinct words and gets their ids and counts back. Trigrams go the same way: a block sends
its distinct trigrams, with their training counts, to the shard of their first two words (so a
frequent word spreads over all shards, and a frequent pair arrives merged); the shard adds up the
counts, builds one trie, maps its levels from a file and looks all trigrams of all blocks up in it.
The number of shards follows the number of tokens. No shard holds more than its part of the distinct
trigrams, and nothing but sums passes through the driver.

p(w | u v) = c(u v w) / (c(u v) + PRIOR) + PRIOR / (c(u v) + PRIOR) * p(w | v), p(w | v) likewise from
c(v w) and c(v), and p(w) = (c(w) + 1) / (N + V + 1): the Dirichlet-smoothed chain down to the
base model, each a distribution over the training vocabulary and one unknown word. Stored values
are 16-bit steps of logarithms (within 0.0002 each).

Cases: a NULL text is empty and has the end token only; a NULL id trains (the check sum of the empty
text) and stays NULL; repeated rows train and are scored each; an empty table gives an empty table.
Without training documents every probability is that of the unknown word. Other columns are not taken over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table
from .eliasfano import Trie, decode
from .tokens import U, joined, mix, word_hashes, words

START, END, NONE, OWN = 0, 1, 2, 3
PRIOR = 20.0
FOLDS, HELD = 7, 2
BLOCK_CHARS, SHARD_DOCS, SHARD_TOKENS = 6_000_000, 4096, 2_000_000
BLOCKS = "block long, kind int, shard int, n long, known long, data array<binary>"


def pack(x: np.ndarray, gaps: bool = False) -> bytes:
    """Non-negative numbers, byte planes apart; ``gaps``: sorted ones by their differences."""
    x = np.diff(x, prepend=0) if gaps else x
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width, gaps]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:], max_output_size=1 << 31), dtype=np.uint8).reshape(data[0], -1)
    x = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    x[:, :data[0]] = planes.T
    x = x.reshape(-1).view("<i8").astype(np.int64)
    return np.cumsum(x) if data[1] else x


def word_shard_bits(n_docs: int) -> int:
    """Bits of a hash that name its word shard: shards follow the documents, 64 to 65 536 of them."""
    return min(16, max(6, (n_docs // SHARD_DOCS).bit_length()))


def read_blocks(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of kind 0: a block (doc ids, held-out flags, words per text, tokens, where words stand in hash order).
    Rows of kind 1: the block's hashes in hash order and their training counts, by shard (the first ``bits`` of a hash)."""
    src = docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("known", pa.int64()), ("data", pa.list_(pa.binary()))])
        for wide in batches:
            for b in slices([wide], 2, BLOCK_CHARS):
                block, seq = part << 32 | seq, seq + 1
                texts = [t.encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()]
                ids = b.column(0)
                held = np.array(b.column(1).to_pylist(), dtype=np.int64)
                data, starts = joined(texts)
                begin, end, text = words(data, starts)
                h, at, total = np.unique(word_hashes(data, begin, end), return_inverse=True, return_counts=True)
                often = np.argsort(-total, kind="stable")  # frequent words get small numbers
                number = np.empty(len(h), dtype=np.int64)
                number[often] = np.arange(len(h))
                train = np.bincount(at, weights=1.0 - held[text], minlength=len(h)).astype(np.int64)
                rows = [(block, 0, 0, len(at) + len(texts), int((1 - held).sum()),
                         [pack(zigzag(ids)), pack(np.array([x is None for x in ids.to_pylist()], dtype=np.int64)), pack(held),
                          pack(np.bincount(text, minlength=len(texts))), pack(number[at]), pack(often)])]
                cut = np.searchsorted((h >> U(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
                rows += [(block, 1, s, int(train[i:j].sum()), 0, [h[i:j].tobytes(), pack(train[i:j])]) for s, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return src.mapInArrow(run, BLOCKS)


def zigzag(ids) -> np.ndarray:
    """Ids as numbers that are not negative."""
    x = np.array([i or 0 for i in ids.to_pylist()], dtype=np.int64)
    return np.where(x >= 0, x << 1, (-x << 1) - 1)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return np.where(x & 1, -((x + 1) >> 1), x >> 1)


def word_answers(rows: DataFrame) -> DataFrame:
    """For each (block, shard) the ids and training counts of the block's words; n: the shard's training tokens, known: its
    vocabulary, both on one row per shard only."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = key[0]
        lists = [np.frombuffer(d[0], dtype=U) for d in pdf["data"]]
        counts = [unpack(d[1]) for d in pdf["data"]]
        h, at = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(h)).astype(np.int64)
        cut = np.cumsum([0, *map(len, lists)])
        number = np.empty(len(h), dtype=np.int64)  # frequent words get small ids
        number[np.argsort(-total, kind="stable")] = np.arange(len(h))
        out = [(b, 1, shard, 0, 0, [pack(number[at[i:j]]), pack(total[at[i:j]])]) for b, i, j in zip(pdf["block"], cut[:-1], cut[1:], strict=True)]
        frame = pd.DataFrame(out, columns=["block", "kind", "shard", "n", "known", "data"])
        frame.loc[0, ["n", "known"]] = [int(total.sum()), int((total > 0).sum())]
        return frame

    return rows.groupBy("shard").applyInPandas(run, BLOCKS)


class Block:
    """A block with the ids and counts of its words, and its distinct trigrams by shard."""

    def __init__(self, data: list[bytes], answers: list[tuple[int, list[bytes]]], shards: int, bits: int):
        zig, null, self.held, self.lens, token, often = map(unpack, data)
        self.ids, self.null = unzigzag(zig), null.astype(bool)
        answers = sorted(answers, key=lambda a: a[0])
        ids = [(unpack(d[0]) << bits) + s + OWN for s, d in answers]
        counts = [unpack(d[1]) for _, d in answers]
        self.word_id = np.concatenate([*ids, np.empty(0, np.int64)])[often]
        self.word_count = np.concatenate([*counts, np.empty(0, np.int64)])[often]
        # numbers of the block: START, END, NONE, then its words; START START w1 ... wn END NONE per text
        n = self.lens + 4
        self.first = np.cumsum(n) - n
        self.s = np.full(int(n.sum()), START, dtype=np.int64)
        last = self.first + self.lens + 2
        self.s[last], self.s[last + 1] = END, NONE
        place = np.arange(len(token)) + np.repeat(self.first + 2 - (np.cumsum(self.lens) - self.lens), self.lens)
        self.s[place] = token + OWN
        self.text = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(self.s) - 2)
        self.at = at[self.text[at] == self.text[at + 2]] if len(at) else at
        self.gid = np.r_[START, END, NONE, self.word_id]
        width = max(1, len(self.gid).bit_length())
        mask = (1 << width) - 1
        pairs, pair = None, (self.s[self.at + 1] << width) | self.s[self.at]
        if 3 * width >= 63:  # a block with a long text of unlike words: its pairs by their ranks
            pairs, pair = np.unique(pair, return_inverse=True)
        key, self.which = np.unique(pair << width | self.s[self.at + 2], return_inverse=True)
        pair = key >> width if pairs is None else pairs[key >> width]
        v, u, w = (self.gid[k] for k in (pair >> width, pair & mask, key & mask))
        train = np.bincount(self.which, weights=1.0 - self.held[self.text[self.at]], minlength=len(key)).astype(np.int64)
        with np.errstate(over="ignore"):
            shard = (mix(mix(u.astype(U)) + v.astype(U)) % U(shards)).astype(np.int64)
        self.order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
        self.u, self.v, self.w, self.n = (x[self.order] for x in (u, v, w, train))
        self.cut = np.searchsorted(shard[self.order], np.arange(shards + 1))

    def payload(self, shard: int) -> list[bytes]:
        i = slice(self.cut[shard], self.cut[shard + 1])
        v, u, w = self.v[i], self.u[i], self.w[i]
        new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
        size = np.diff(np.r_[np.flatnonzero(new), len(u)])
        return [pack(v[new]), pack(u[new]), pack(size), pack(w), pack(self.n[i])]

    def score(self, answers: list[tuple[int, list[bytes]]], n: int, known: int, train_docs: int) -> tuple[np.ndarray, ...]:
        counts, probabilities = np.zeros(len(self.u)), np.zeros(len(self.u))
        for shard, (c, p) in answers:
            i = slice(self.cut[shard], self.cut[shard + 1])
            new = np.r_[True, (self.u[i][1:] != self.u[i][:-1]) | (self.v[i][1:] != self.v[i][:-1])]
            counts[i], probabilities[i] = decode(unpack(c))[np.cumsum(new) - 1], decode(unpack(p))
        back = np.empty(len(self.order), dtype=np.int64)
        back[self.order] = np.arange(len(self.order))
        mine = back[self.which]
        pair, gram = counts[mine], probabilities[mine]  # of the trigram at each place: count of its first two words, probability
        c = np.r_[train_docs, train_docs, 0, self.word_count].astype(float)
        real = np.flatnonzero(self.s[self.at + 2] != NONE)  # the next trigram of the same text follows
        word, before = self.s[self.at[real] + 2], self.s[self.at[real] + 1]
        base = (c[word] + 1) / (n + known + 1)
        two = pair[real + 1] / (c[before] + PRIOR) + PRIOR / (c[before] + PRIOR) * base
        three = gram[real] + PRIOR / (pair[real] + PRIOR) * two
        text = self.text[self.at[real]]
        add = lambda x: np.bincount(text, weights=x, minlength=len(self.lens))
        return self.lens + 1, add(c[word] > 0).astype(np.int64), add(np.log10(base)), add(np.log10(three))


def merged(payloads: list[list[bytes]]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """Of a shard's payloads: (contexts, trigrams) of each, the number of every context and trigram among the distinct
    ones, the distinct trigrams (u, v, w) ordered by (v, u, w), and their training counts."""
    v, u, size, w, n = ([unpack(d[i]) for d in payloads] for i in range(5))
    sizes = [(len(a), len(b)) for a, b in zip(v, w, strict=True)]
    v, u, size, w, n = (np.concatenate(x) for x in (v, u, size, w, n))
    order = np.lexsort((u, v))
    new = np.r_[True, (v[order][1:] != v[order][:-1]) | (u[order][1:] != u[order][:-1])]
    context = np.empty(len(v), dtype=np.int64)
    context[order] = np.cumsum(new) - 1
    v, u = v[order][new], u[order][new]
    width = int(w.max(initial=0)).bit_length() + 1
    key = np.repeat(context, size) << width | w
    assert len(v).bit_length() + width < 63, "a shard holds too many contexts"
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    gram = np.empty(len(key), dtype=np.int64)
    gram[order] = np.cumsum(new) - 1
    key, n = key[new], np.add.reduceat(n[order], np.flatnonzero(new))
    return sizes, context, gram, (u[key >> width], v[key >> width], key & ((1 << width) - 1)), n


def trie_of(grams: tuple[np.ndarray, ...], n: np.ndarray) -> Trie:
    seen = n > 0
    return Trie.build(*(x[seen] for x in grams), n[seen], NONE, PRIOR)


def trigram_answers(payloads: DataFrame) -> DataFrame:
    """For each (block, shard) the codes of its contexts and trigrams, from the shard's memory-mapped trie."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, context, gram, grams, n = merged(pdf["data"].tolist())
        counts, probabilities = trie_of(grams, n).mapped().look_up(*grams)
        first = np.flatnonzero(np.r_[True, (grams[0][1:] != grams[0][:-1]) | (grams[1][1:] != grams[1][:-1])])
        counts, out, i, j = counts[first].astype(np.int64), [], 0, 0
        for (contexts, trigrams), block, shard in zip(sizes, pdf["block"], pdf["shard"], strict=True):
            out.append((block, 2, shard, 0, 0, [pack(counts[context[i:i + contexts]]), pack(probabilities[gram[j:j + trigrams]].astype(np.int64))]))
            i, j = i + contexts, j + trigrams
        return pd.DataFrame(out, columns=["block", "kind", "shard", "n", "known", "data"])

    return payloads.groupBy("shard").applyInPandas(run, BLOCKS)


def score(docs: DataFrame) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text, held_out boolean) under the model of those not held out."""
    bits = word_shard_bits(docs.count())
    rows = stored(read_blocks(docs, bits))
    blocks = rows.where("kind = 0")
    found = stored(word_answers(rows.where("kind = 1")))
    tokens, train_docs = (int(x or 0) for x in blocks.agg(F.sum("n"), F.sum("known")).first())
    n, known = (int(x or 0) for x in found.agg(F.sum("n"), F.sum("known")).first())
    n, known = n + train_docs, known + (train_docs > 0)  # the end token is one word, once in each text
    shards = -(-tokens // SHARD_TOKENS) or 1

    def send(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b = Block(left["data"][0], list(zip(right["shard"], right["data"], strict=True)), shards, bits)
        out = [(key[0], 2, s, 0, 0, b.payload(s)) for s in range(shards) if b.cut[s] < b.cut[s + 1]]
        return pd.DataFrame(out, columns=["block", "kind", "shard", "n", "known", "data"])

    def finish(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of = {k: list(zip(r["shard"], r["data"], strict=True)) for k, r in right.groupby("kind")}
        b = Block(left["data"][0], of.get(1, []), shards, bits)
        n_tokens, n_known, base, own = b.score(of.get(2, []), n, known, train_docs)
        return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(b.ids, b.null),
                             "held_out": b.held.astype(bool), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": n, "base_score": base, "score": own})

    payloads = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(send, BLOCKS)
    answers = found.unionByName(trigram_answers(payloads))  # the exchange of the blocks above serves here, too
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out")))
