"""Quality rules with risk-controlled thresholds.

A rule rejects a document whose signal lies above the cutoff of its stratum (language). The
cutoffs come from the labelled holdout, in which every text counts once per stratum. One part of it (a quarter,
by the texts' hash) proposes for each signal the cutoff of the fixed grid that best parts bad from
good documents; a signal without gain has none. The other part certifies: it walks a fixed sequence of rule
sets, from the loosest grid value down to the proposed cutoffs, all signals at once, and stops at the first
set of which the exact binomial tail does not say that its rules together falsely reject less than ``ALPHA`` of the
good documents, at level ``DELTA`` divided by the number of strata (Bonferroni across strata). The last
certified set is used. So with probability 1 - DELTA no stratum loses more than ALPHA of its good documents by all rules together,
and a stratum needs about 220 good texts in the certifying part (some 290 in all) to have a rule at all with four strata.

Cases: a NULL text has no words and fails the base rule (fewer than 20 words); a NULL language is a
stratum of its own; strata without enough labels keep all that the base rule keeps; NULL labels
count for nothing; copies of a text and repeated labels count once, as good if any of their labels is; an empty table gives an
empty table. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.lookup import sized
from ..session import cut_lineage
from .common import SPACES, carried, content_key, map_texts, restored, table

ALPHA, DELTA, GOOD_WEIGHT, MIN_GAIN, PARTS = 0.02, 0.05, 10.0, 0.02, 4
WINDOW = 8
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]
#: Cutoffs that may be chosen, loosest first.
GRID = [2.0, 1.5, 1.0, 0.8, 0.65, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01]


def signals() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words, "bangs": F.col("n_bangs") / words,
        "upper": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def repeated_windows(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document that lie in windows of WINDOW words found twice or more in it.
    Equal hashes only select documents; these are decided by exact names (pair doubling)."""
    out = np.zeros(n_docs, dtype=np.int64)
    if len(ids) < WINDOW:
        return out

    def starts(doc):
        return np.flatnonzero(doc[:len(doc) - WINDOW + 1] == doc[WINDOW - 1:])

    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        h = np.zeros(len(ids) - WINDOW + 1, dtype=np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:len(mixed) - WINDOW + 1 + k]
        at = starts(doc)
        key = (h[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    suspects = np.zeros(n_docs, dtype=bool)
    suspects[doc[at[order[1:][same]]]] = True
    pick = suspects[doc]
    ids, doc = ids[pick], doc[pick]
    if len(ids) < WINDOW:
        return out
    name, step = ids, 1
    while step < WINDOW:  # names of 2, 4, 8 words; a window across documents is never looked at
        pair = name[:-step].astype(np.int64) << 32 | name[step:]
        name = np.unique(pair, return_inverse=True)[1]
        step *= 2
    at = starts(doc)
    _, group, count = np.unique(doc[at].astype(np.int64) << 32 | name[at], return_inverse=True, return_counts=True)
    hit = at[count[group] > 1]
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    inside = np.cumsum(cover[:-1]) > 0
    np.add.at(out, doc[inside], 1)
    return out


def measure(texts: list[str]) -> list[list[int]]:
    """The columns COUNTS of the texts."""
    names: dict[bytes, int] = {}
    rows, ids, lens = [], [], []
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").split()
        ids += [names.setdefault(w, len(names)) for w in words]
        lens.append(len(words))
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        upper = sum(map(t.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        rows.append([len(words), len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), 0, len(lines), upper, t.count("!")])
    repeats = repeated_windows(np.array(ids, dtype=np.int64), np.repeat(np.arange(len(texts)), lens), len(texts))
    for r, n in zip(rows, repeats.tolist(), strict=True):
        r[4] = n
    return rows


def with_counts(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns COUNTS."""
    rest = [c for c in docs.columns if c != text and c not in COUNTS]
    src = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text))
    kept = src if keep_text else src.drop(text)
    schema = StructType([*kept.schema, *(StructField(c, LongType()) for c in COUNTS)])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = zip(*measure([t or "" for t in b.column(b.num_columns - 1).to_pylist()]), strict=True)
        n = b.num_columns - (not keep_text)
        return pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(v, pa.int64()) for v in found)], names=[*b.schema.names[:n], *COUNTS])

    return map_texts(src, run, schema, text)


def binomial_tail(k: int, n: int, p: float) -> float:
    """Exact P(X <= k) of a binomial X, from the running sum of the logarithms of its terms' ratios."""
    if k >= n:
        return 1.0
    j = np.arange(1, k + 1, dtype=float)
    logs = n * np.log1p(-p) + np.r_[0.0, np.cumsum(np.log((n - j + 1) / j) + np.log(p) - np.log1p(-p))]
    return float(min(1.0, np.exp(logs - logs.max()).sum() * np.exp(logs.max())))


def propose(bins: np.ndarray, good: np.ndarray, weight: np.ndarray) -> list[int | None]:
    """For each signal the place in GRID of the cutoff with the largest gain on these texts (None: no gain).
    ``bins``: a row per kind of text, a column per signal; a signal in bin i lies above GRID[i] but not above GRID[i - 1]."""
    n_good, n_bad = max(1, int(weight[good].sum())), max(1, int(weight[~good].sum()))
    out = []
    for column in bins.T:
        hit = np.zeros((2, len(GRID) + 1), dtype=np.int64)
        np.add.at(hit, (good.astype(int), column), weight)
        bad, lost = np.cumsum(hit, axis=1)[:, :-1]
        gain = bad / n_bad - GOOD_WEIGHT * lost / n_good
        best = int(np.argmax(gain))  # the first, loosest one of equal gains
        out.append(best if gain[best] > MIN_GAIN else None)
    return out


def certify(bins: np.ndarray, good: np.ndarray, weight: np.ndarray, proposed: list[int | None], level: float, alpha: float) -> list[int | None]:
    """The last rule set that holds on the way to the proposed one. Rule set t has the cutoffs GRID[min(t, proposed)]
    of the proposed signals."""
    used = [j for j, p in enumerate(proposed) if p is not None]
    held: list[int | None] = [None] * len(proposed)
    n_good = int(weight[good].sum())
    if not used or not n_good:
        return held
    last = max(proposed[j] for j in used)
    # the first rule set that rejects a text: its signal lies above GRID[t] for t from its bin on, if the proposal goes so far
    first = np.min([np.where(bins[good, j] <= proposed[j], bins[good, j], last + 1) for j in used], axis=0)
    lost = np.cumsum(np.bincount(first, weights=weight[good], minlength=last + 2))[:last + 1].astype(int)
    for t, k in enumerate(lost):
        if k > alpha * n_good or binomial_tail(int(k), n_good, alpha) > level:
            break
        held = [None if p is None else min(t, p) for p in proposed]
    return held


def labelled_kinds(measured: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    """Labelled texts by stratum, part and the bins of all signals: the number of distinct texts, good and bad."""
    good = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col("quality").alias("__good"))

    def bin_of(x: Column) -> Column:  # GRID falls, so the cutoffs that x does not exceed are the first ones
        return F.size(F.filter(F.array(*map(F.lit, GRID)), lambda g: x <= g))

    binned = [bin_of(x.cast("double")).alias(f"bin_{n}") for n, x in signals().items()]
    bins = [f"bin_{n}" for n in signals()]
    texts = (measured.where(~base_failed()).join(good, F.col("doc_id") == F.col("__id"))
             .select(F.col(stratum).alias("stratum"), "text_key", "__good", *binned)
             .groupBy("stratum", "text_key", *bins).agg(F.max("__good").alias("good")))
    part = (F.pmod(F.xxhash64("text_key"), F.lit(PARTS)) == 0).alias("proposing")
    return texts.groupBy("stratum", part, "good", *bins).agg(F.count(F.lit(1)).alias("n"))


def fit_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: the stratum and a cutoff column ``cut_<signal>`` for each signal (NULL: no rule).
    ``measured``: doc_id, stratum, text_key and COUNTS; base failures take no part, as they go anyway. A stratum's group
    holds one row per combination of bins at most, whatever the number of texts."""
    names = list(signals())
    kinds = cut_lineage(labelled_kinds(measured, labels, stratum))
    strata = max(1, kinds.select("stratum").distinct().count())

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [(p[[f"bin_{n}" for n in names]].to_numpy(np.int64), p["good"].to_numpy() == 1, p["n"].to_numpy(np.int64))
                 for p in (pdf[pdf.proposing], pdf[~pdf.proposing])]
        held = certify(*sides[1], propose(*sides[0]), delta / strata, alpha)
        return pd.DataFrame([[key[0], *(None if i is None else GRID[i] for i in held)]], columns=["stratum", *(f"cut_{n}" for n in names)])

    return kinds.groupBy("stratum").applyInPandas(run, "stratum string, " + ", ".join(f"cut_{n} double" for n in names))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with base_failed and kept. The cutoffs have one row per stratum; they are broadcast
    if their measured size is within the bound, else both sides are shuffled."""
    joined = measured.join(sized(cutoffs), F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    hit = F.lit(False)
    for n, x in signals().items():
        hit = hit | F.coalesce(x > F.col(f"cut_{n}"), F.lit(False))
    out = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~hit)
    return out.drop("stratum", *[f"cut_{n}" for n in signals()])


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_key and COUNTS of ``docs``."""
    return with_counts(docs.select("doc_id", "lang", content_key().alias("text_key"), "text"), keep_text=False)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    cutoffs = fit_cutoffs(narrow(docs), labels)
    return restored(judge(with_counts(carried(docs, "doc_id", "lang", "text")), cutoffs).where("kept"), docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut_lineage(narrow(table(spark, sf_dir, "documents")))
    judged = judge(measured, fit_cutoffs(measured, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:])
