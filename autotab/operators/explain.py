"""Explanations: permutation importance, pruning advice, learning curve, CV intervals."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import HASH_BITS, key_text
from ..functions.stats import t_ppf
from ..session import cut_lineage
from . import metrics as M
from .models import fit_model, scored_frame


#: Ranks in a block of a permutation, hash ranges counted for one (2**RANGE_BITS at most), rows that a task cuts into blocks at a time.
BLOCK_ROWS, RANGES, RANGE_BITS, CHUNK_ROWS = 50_000, 8, 16, 400_000


def key_hashes(texts: np.ndarray, seed: str) -> np.ndarray:
    """``keys.row_hash`` of the key texts."""
    suffix = f"#{seed}".encode()
    return (np.frombuffer(b"".join([md5(t + suffix).digest() for t in texts]), ">u8")[::2] >> (64 - HASH_BITS)).astype(np.int64)


def chunks(batches):
    """Tables of CHUNK_ROWS rows or a little more."""
    kept, n = [], 0
    for b in batches:
        kept, n = [*kept, b], n + b.num_rows
        if n >= CHUNK_ROWS:
            yield pa.Table.from_batches(kept)
            kept, n = [], 0
    if n:
        yield pa.Table.from_batches(kept)


def range_ends(df: DataFrame, key: list[str], seeds: list[str]) -> np.ndarray:
    """Per seed the number of rows up to the end of each hash range; the ranges are of equal width and a power of 2 in number."""
    bits = min(RANGE_BITS, max(1, (RANGES * df.count() // BLOCK_ROWS).bit_length()))

    def count(batches):
        n = np.zeros((len(seeds), 1 << bits), np.int64)
        for b in batches:
            keys = b["__k"].to_numpy(zero_copy_only=False)
            for i, s in enumerate(seeds):
                n[i] += np.bincount(key_hashes(keys, s) >> (HASH_BITS - bits), minlength=1 << bits)
        s, r = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"s": s.astype(np.int32), "r": r.astype(np.int32), "n": n[s, r]})
    out = np.zeros((len(seeds), 1 << bits), np.int64)
    for row in df.select(key_bytes(key)).mapInArrow(count, "s int, r int, n long").groupBy("s", "r").agg(F.sum("n").alias("n")).collect():
        out[row["s"], row["r"]] = row["n"]
    return out.cumsum(axis=1)


def order_seeds(seed: str) -> list[str]:
    return [f"{seed}-a", f"{seed}-b"]


def key_bytes(key: list[str]):
    return F.encode(key_text(*key), "UTF-8").alias("__k")


def permute_column(df: DataFrame, col: str, key: list[str], seed: str, ends: np.ndarray | None = None) -> DataFrame:
    """Re-pair ``col`` across rows: the row ranked i under md5(key#seed-a) takes the value of
    the row ranked i under md5(key#seed-b). Counts of hash ranges say which blocks of ranks a row may
    belong to; its packed columns go there, and every block orders and pairs both sides by itself."""
    seeds = order_seeds(seed)
    ends = range_ends(df, key, seeds) if ends is None else ends
    bits, n = ends.shape[1].bit_length() - 1, int(ends[0, -1])
    size = max(BLOCK_ROWS, RANGES * n >> bits)
    d = df.select("*", key_bytes(key))
    names = df.columns
    sides = [list(dict.fromkeys([*key, *(c for c in names if c != col)])), list(dict.fromkeys([*key, col]))]

    def pack(batches):
        for t in chunks(batches):
            keys = t["__k"].to_numpy()
            for s, keep in enumerate(sides):
                h = key_hashes(keys, seeds[s])
                first, last = np.concatenate([[0], ends[s][:-1]]), ends[s] - 1
                at = h >> (HASH_BITS - bits)
                low, wide = first[at] // size, last[at] // size - first[at] // size + 1
                # a range that reaches over the end of a block goes into both, which keep their own ranks of it
                rows = np.repeat(np.arange(len(h)), wide)
                blk = low[rows] + np.arange(len(rows)) - (np.cumsum(wide) - wide)[rows]
                order = np.argsort(blk, kind="stable")
                blk, part = blk[order], t.select(keep).append_column("__h", pa.array(h)).take(pa.array(rows[order])).combine_chunks()
                cuts = np.flatnonzero(np.diff(blk, prepend=-1))
                blks, blobs = blk[cuts], []
                for i, j in zip(cuts, [*cuts[1:], len(blk)], strict=True):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as w:
                        w.write_table(part.slice(i, j - i))
                    blobs.append(sink.getvalue().to_pybytes())
                skip = blks * size - first[np.searchsorted(last, blks * size)]
                yield pa.RecordBatch.from_pydict({"blk": blks, "side": np.full(len(blks), s, np.int32), "skip": skip, "rows": pa.array(blobs, pa.binary())})

    def pair(t: pa.Table) -> pa.Table:
        def ranked(s: int) -> pa.Table:
            own = t.filter(pc.equal(t["side"], s))
            d = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in own["rows"]])
            h = d["__h"].to_numpy()
            order = np.argsort(h, kind="stable")
            if (np.diff(h[order]) == 0).any():  # equal hashes: in the order of the key
                order = pc.sort_indices(d, [("__h", "ascending"), *((k, "ascending") for k in key)], null_placement="at_start").to_numpy()
            skip = own["skip"][0].as_py()
            return d.take(pa.array(order[skip:skip + size]))
        rows, values = ranked(0), ranked(1)
        return pa.table([values[c] if c == col else rows[c] for c in names], names=names)
    return d.mapInArrow(pack, "blk long, side int, skip long, rows binary").groupBy("blk").applyInArrow(pair, df.schema)


def permutation_importance(score_fn, df: DataFrame, features: list[str], key: list[str], metric: str,
                           task: str, repeats: int = 5, seed: int = 42, parallelism: int = 4, top: int | None = 20) -> DataFrame:
    """(feature, importance_mean, importance_std, rank): mean drop of ``metric`` (higher is
    better) when one feature is permuted, over ``repeats`` seeded permutations; the ``top`` first (None: all).

    ``score_fn(frame) -> scored frame`` with y and y_pred / score columns."""
    spark = df.sparkSession
    # the input is read d·repeats + 1 times: write it once to the shared checkpoint folder, and keep its columns
    df = cut_lineage(df).persist(StorageLevel.MEMORY_AND_DISK)
    base = M.metric_by(score_fn(df).withColumn("__g", F.lit(0)), metric, ["__g"], task).first()["value"]

    # the d·repeats permutations are independent jobs: submit a few concurrently
    tasks = [(f, r) for f in features for r in range(repeats)]
    ends = range_ends(df, key, [s for f, r in tasks for s in order_seeds(f"{seed}-{f}-{r}")])

    def drop(i):
        f, r = tasks[i]
        p = permute_column(df, f, key, f"{seed}-{f}-{r}", ends[2 * i:2 * i + 2])
        return base - M.metric_by(score_fn(p).withColumn("__g", F.lit(0)), metric, ["__g"], task).first()["value"]
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        results = dict(zip(tasks, ex.map(drop, range(len(tasks)))))
    df.unpersist()
    rows = []
    for f in features:
        drops = [results[(f, r)] for r in range(repeats)]
        m = sum(drops) / len(drops)
        s = math.sqrt(sum((x - m) ** 2 for x in drops) / len(drops))
        rows.append((f, float(m), float(s)))
    rows.sort(key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame([(f, m, s, i + 1) for i, (f, m, s) in enumerate(rows[:top])],
                                 "feature string, importance_mean double, importance_std double, rank int")


def prune_features(importance: DataFrame, drop_below: float = 0.0, max_drop: int | None = None) -> DataFrame:
    """(feature, importance_mean, dropped): importance ≤ drop_below; if more than max_drop,
    only the max_drop least important (ties by name)."""
    cand = importance.where(F.col("importance_mean") <= F.lit(drop_below))
    if max_drop is not None:
        cand = cand.orderBy(F.col("importance_mean"), F.col("feature")).limit(max_drop)
    cand = cand.select("feature", F.lit(1).alias("dropped"))
    return importance.select("feature", "importance_mean").join(cand, "feature", "left").select(
        "feature", "importance_mean", F.coalesce("dropped", F.lit(0)).alias("dropped"))


def cv_confidence_interval(scores: DataFrame, col: str = "value", confidence: float = 0.95) -> DataFrame:
    """(mean, low, high, n) with a Student-t interval; n < 2 or zero spread → degenerate."""
    r = scores.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s"), F.count(col).alias("n")).first()
    m, s, n = r["m"], r["s"], int(r["n"])
    if n < 2 or not s:
        lo = hi = m
    else:
        half = t_ppf(1 - (1 - confidence) / 2, n - 1) * s / math.sqrt(n)
        lo, hi = m - half, m + half
    return scores.sparkSession.createDataFrame([(m, lo, hi, n)], "mean double, low double, high double, n long")


def learning_curve(spec, params, folds, task: str, key: list[str], metric: str,
                   sizes=(0.1, 0.325, 0.55, 0.775, 1.0), seed: int = 42) -> DataFrame:
    """(train_frac, train_mean, train_std, valid_mean, valid_std) over nested training
    fractions (md5 draws) × folds."""
    from ..functions.keys import unit_uniform
    spark = folds[0].train.sparkSession
    rows = []

    def one(fd, frac):
        tr = fd.train if frac >= 1.0 else fd.train.where(unit_uniform(*key, seed=seed) < F.lit(float(frac)))
        model = fit_model(spec, params, tr, fd.ctx)
        out = []
        for data in (tr, fd.valid):
            sc = scored_frame(model.transform(data), task, keep=[]).withColumn("__g", F.lit(0))
            out.append(M.metric_by(sc, metric, ["__g"], task).first()["value"])
        return out
    for frac in sizes:
        with ThreadPoolExecutor(max_workers=len(folds)) as ex:  # folds fit as concurrent jobs
            got = list(ex.map(lambda fd: one(fd, frac), folds))
        tr_s, va_s = [g[0] for g in got], [g[1] for g in got]

        def ms(v):
            v = [x for x in v if x is not None]
            m = sum(v) / len(v)
            return m, math.sqrt(sum((x - m) ** 2 for x in v) / len(v))
        (tm, ts), (vm, vs) = ms(tr_s), ms(va_s)
        rows.append((float(frac), tm, ts, vm, vs))
    return spark.createDataFrame(rows, "train_frac double, train_mean double, train_std double, "
                                       "valid_mean double, valid_std double")
