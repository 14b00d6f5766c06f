"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs that follows from its code point alone. A word's letters and the
blanks around it give one three-letter gram per letter; its vector binds the letters' vectors, permuted by their place:
roll(a, 2) * roll(b, 1) * c. A text's profile bundles (adds) its grams' vectors, a language's prototype
bundles those of all its training texts. A text gets the language whose prototype has the largest cosine with its
profile; ``score`` is that cosine, cut at 0.

Profiles are whole numbers, so sums do not depend on the order of rows or tasks. Training bundles inside each task, per
language, and adds the tasks' bundles up by dimension; nothing but one vector per language leaves a task. Prototypes reach
the tasks that compare in pieces of at most ``PIECE`` languages, one pass each, so that their size is bounded whatever the
column holds; a pass carries the best so far.

Letters are the characters that Python calls alphabetic, lower-cased; all others count as blanks. Grams count in whole texts.

Cases: a NULL text, or one without a letter, gets ``und`` and score 0, as does every text where nothing could be learned;
rows without a language or a letter teach nothing; ties go to the smaller language; NULL ids count as the empty text
where the crc decides and rows are kept as they come, repeated ones too; very long texts are counted in pieces; other
columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices, table, whole_text

DIM, SEED = 2048, 42
FOLDS, HELD = 4, 2
UNKNOWN = "und"
#: Languages whose prototypes one pass compares, texts of one bundle, grams whose vectors are in memory at once.
PIECE, TEXTS, GRAMS = 1024, 512, 4096
#: Characters of texts that are counted at once.
CHARS = 1_500_000
#: Largest number of counters per text; alphabets beyond it are counted by sorting.
COUNTERS = 1 << 22
#: Share of a bundle's texts from which a gram is added by a matrix product instead of text by text.
COMMON = 0.06

BLANK = 0
GAP = re.compile(r"[\x09-\x0D\x20]")


class Letters:
    """Numbers and vectors of the letters that a task has met."""

    def __init__(self):
        self.number = np.full(0x110000, -1, np.int32)
        self.points = [0x20]
        self.vectors = [vector_of(0x20)]

    def numbered(self, points: np.ndarray) -> np.ndarray:
        """Letter numbers of code points; blanks and all that is no letter are ``BLANK``."""
        got = self.number[points]
        if (got < 0).any():
            for p in np.unique(points[got < 0]).tolist():
                if chr(p).isalpha():
                    self.number[p] = len(self.points)
                    self.points.append(p)
                    self.vectors.append(vector_of(p))
                else:
                    self.number[p] = BLANK
            got = self.number[points]
        return got

    def bound(self, grams: np.ndarray, base: int) -> np.ndarray:
        """The vectors of grams, given as numbers to ``base``."""
        used, inverse = np.unique(np.stack([grams // (base * base), grams // base % base, grams % base]), return_inverse=True)
        a, b, c = inverse.reshape(3, -1)
        v = np.stack([self.vectors[i] for i in used.tolist()])
        return (np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]).astype(np.float32)


def vector_of(point: int) -> np.ndarray:
    return np.random.default_rng([SEED, point]).integers(0, 2, DIM).astype(np.int8) * 2 - 1


def gram_numbers(letters: Letters, texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, gram) of every letter of the texts, and the base of the gram numbers."""
    low = [t.lower() for t in texts]
    lengths = np.array([len(t) + 1 for t in low])
    points = np.frombuffer((" " + " ".join([*low, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    numbers = letters.numbered(points).astype(np.int64)
    base = len(letters.points)
    at = np.flatnonzero(numbers)
    grams = (numbers[at - 1] * base + numbers[at]) * base + numbers[at + 1]
    return np.searchsorted(np.cumsum(lengths), at - 1, "right"), grams, base


def counted(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below ``most``, ascending, and their counts."""
    if most <= max(COUNTERS, 4 * len(keys)):
        n = np.bincount(keys)
        found = np.flatnonzero(n)
        return found, n[found]
    return np.unique(keys, return_counts=True)


def bundle(letters: Letters, text: np.ndarray, grams: np.ndarray, counts: np.ndarray, n: int, base: int) -> np.ndarray:
    """Profiles of ``n`` texts from the counts of their grams (whole numbers in 64-bit floats, exact to 2**53)."""
    out = np.zeros((n, DIM))
    kinds, inverse = np.unique(grams, return_inverse=True)
    spread = np.bincount(inverse, minlength=len(kinds))
    order = np.argsort(-spread, kind="stable")
    place = np.empty(len(kinds), np.int64)
    place[order] = np.arange(len(kinds))
    by = np.argsort(place[inverse], kind="stable")
    where, text, counts = place[inverse][by], text[by], counts[by]
    for start in range(0, len(kinds), GRAMS):
        v = letters.bound(kinds[order[start:start + GRAMS]], base)
        lo, hi = np.searchsorted(where, [start, start + GRAMS])
        dense = int((spread[order[start:start + GRAMS]] >= COMMON * n).sum())
        mid = lo + int(np.searchsorted(where[lo:hi], start + dense))
        if dense:
            m = np.zeros((n, dense), np.float32 if counts[lo:mid].sum(initial=0) < 1 << 24 else np.float64)
            m[text[lo:mid], where[lo:mid] - start] = counts[lo:mid]
            out += m @ v[:dense]
        rows = np.argsort(text[mid:hi], kind="stable") + mid
        for some in np.array_split(rows, max(1, -(-len(rows) // GRAMS))):
            if len(some):
                first = np.flatnonzero(np.r_[True, np.diff(text[some]) > 0])
                out[text[some][first]] += np.add.reduceat(v[where[some] - start] * counts[some][:, None].astype(np.float64), first, 0)
    return out


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in runs of at most ``CHARS`` characters and ``TEXTS`` texts; a longer text is cut behind white
    space, where no gram stands."""
    rows, run, total = [], [], 0
    for i, t in enumerate(texts):
        start = 0
        while start < len(t):
            if total >= CHARS or len(set(rows)) >= TEXTS:
                yield rows, run
                rows, run, total = [], [], 0
            gap = GAP.search(t, start + CHARS)
            stop = gap.end() if gap else len(t)
            rows.append(i)
            run.append(t[start:stop])
            total, start = total + stop - start, stop
    if rows:
        yield rows, run


def profiles(letters: Letters, texts: list[str]) -> np.ndarray:
    """One profile per text; all zero without letters."""
    out = np.zeros((len(texts), DIM))
    for rows, run in pieces(texts):
        own = np.unique(rows)
        text, grams, base = gram_numbers(letters, run)
        text = np.searchsorted(own, np.array(rows))[text]
        kinds, inverse = np.unique(grams, return_inverse=True) if base ** 3 > COUNTERS else lookup(grams, base ** 3)
        keys, counts = counted(text * max(1, len(kinds)) + inverse, len(own) * max(1, len(kinds)))
        if len(keys):
            out[own] += bundle(letters, keys // len(kinds), kinds[keys % len(kinds)], counts, len(own), base)
    return out


def lookup(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and each key's place among them."""
    seen = np.zeros(most, bool)
    seen[keys] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[keys]


def prototypes(rows: DataFrame) -> DataFrame:
    """(lang, profile array<double>) bundled over all rows (lang, text) with both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(), {}
        for b in slices(batches, 1, CHARS):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            names = sorted(set(langs))
            for some in (names[i:i + TEXTS] for i in range(0, len(names), TEXTS)):
                at = {x: i for i, x in enumerate(some)}
                mine = [(at[x], t) for x, t in zip(langs, texts, strict=True) if x in at]
                got = by_language(letters, mine, len(some))
                for x, v in zip(some, got, strict=True):
                    sums[x] = sums.get(x, 0) + v
            if len(sums) >= TEXTS:
                yield packed(sums)
                sums = {}
        if sums:
            yield packed(sums)

    def packed(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    part = rows.select("lang", "text").mapInArrow(run, "lang string, v array<double>")
    cells = part.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    return cells.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("profile")).where(F.exists("profile", lambda x: x != 0))


def by_language(letters: Letters, rows: list[tuple[int, str]], n: int) -> np.ndarray:
    """Bundles of the texts of ``n`` languages: grams are counted per language first."""
    out = np.zeros((n, DIM))
    for places, run in pieces([t for _, t in rows]):
        text, grams, base = gram_numbers(letters, run)
        lang = np.array([rows[i][0] for i in places])[text]
        kinds, inverse = np.unique(grams, return_inverse=True) if base ** 3 > COUNTERS else lookup(grams, base ** 3)
        keys, counts = counted(lang * max(1, len(kinds)) + inverse, n * max(1, len(kinds)))
        if len(keys):
            out += bundle(letters, keys // len(kinds), kinds[keys % len(kinds)], counts, n, base)
    return out


def compared(docs: DataFrame, names: list[str], unit: np.ndarray) -> DataFrame:
    """``docs`` (.., text, lang_pred, cosine) with a better language of ``names`` where there is one."""
    at, cols = docs.columns.index("text"), docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for b in slices(batches, at, CHARS):
            for start in range(0, b.num_rows, TEXTS):
                s = b.slice(start, TEXTS)
                p = profiles(letters, s.column(at).to_pylist())
                norm = np.sqrt((p * p).sum(1))
                cosine = np.round(p @ unit.T / np.maximum(norm, 1)[:, None], 9)
                best = cosine.argmax(1)  # the first of equal ones: names ascend
                before = s.column(cols.index("cosine")).to_numpy(zero_copy_only=False).astype(float)
                value = np.where(norm > 0, cosine[np.arange(len(best)), best], np.nan)
                old = s.column(cols.index("lang_pred")).to_pylist()
                better = (norm > 0) & (~(value <= before) | (value == before) & [o is not None and names[i] < o for i, o in zip(best, old, strict=True)])
                pred = [names[i] if new else o for i, new, o in zip(best, better, old, strict=True)]
                columns = [pa.array(pred, pa.string()) if c == "lang_pred" else pa.array(np.where(better, value, before), from_pandas=True) if c == "cosine"
                           else s.column(i) for i, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays(columns, names=cols)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, prototype: DataFrame) -> DataFrame:
    """``docs`` (.., text) with lang_pred and score, by the prototypes (lang, profile) of ``prototypes``."""
    prototype = cut_lineage(prototype)
    ranked = prototype.withColumn("bucket", F.pmod(F.xxhash64("lang"), F.lit(max(1, -(-prototype.count() // PIECE)))))
    d = docs.withColumns({"text": whole_text(), "lang_pred": F.lit(None).cast("string"), "cosine": F.lit(None).cast("double")})
    for bucket in sorted(r.bucket for r in ranked.select("bucket").distinct().collect()):
        got = sorted(ranked.where(F.col("bucket") == bucket).select("lang", "profile").collect())
        unit = np.array([r.profile for r in got])
        d = compared(d, [r.lang for r in got], unit / np.sqrt((unit * unit).sum(1))[:, None])
    return d.withColumn("score", F.greatest(F.coalesce("cosine", F.lit(0.0)), F.lit(0.0))).withColumn("lang_pred", F.coalesce("lang_pred", F.lit(UNKNOWN))).drop("cosine")


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", held_out(F.col("doc_id")).alias("held_out"))
    learned = prototypes(docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return identify(docs.drop("lang"), learned).select("doc_id", "held_out", "lang_pred", "score")
