"""Exact quantiles and modes without funnelling a column through one task.

``percentile``/``median`` keep every distinct value of a group in one
aggregation buffer. Here the k-th smallest value is found by repeated
histogram passes: each pass counts rows per value bucket inside the current
bracket (a map-side combined aggregate returning at most ``bins`` rows), keeps
the bucket holding rank k, and stops once the bracket is a single value or
small enough (``max_collect`` rows) to fetch. Brackets are value ranges, so
parquet min/max statistics prune row groups on later passes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cleaning import named

DEFAULT_BINS = 4096
DEFAULT_MAX_COLLECT = 20_000


def _clean(df: DataFrame, col: str) -> DataFrame:
    x = named(col).cast("double")
    return df.select(x.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))


def _stats(df: DataFrame, cols: list[str]) -> dict:
    aggs = []
    for i, c in enumerate(cols):
        x = F.when(~F.isnan(named(c).cast("double")), named(c).cast("double"))
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    r = df.agg(*aggs).first()
    return {c: (int(r[f"n{i}"]), r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(cols)}


def multi_order_statistics(df: DataFrame, requests: dict[str, list[int]], bins: int = DEFAULT_BINS,
                           max_collect: int = DEFAULT_MAX_COLLECT, stats: dict | None = None) -> dict:
    """Exact values at 0-based ranks for several columns at once: {(column, rank): value}.

    Every pass is one scan for all open brackets of all columns: rows inside a bracket are
    tagged with (bracket id, bucket) and counted with a map-side combined aggregate."""
    cols = list(requests)
    stats = stats or _stats(df, cols)
    out: dict = {}
    pending = {}
    for c in cols:
        n, lo, hi = stats[c]
        for r in set(int(v) for v in requests[c]):
            if not 0 <= r < n:
                raise ValueError(f"rank {r} out of range for {n} values of {c}")
            pending[(c, r)] = (c, lo, hi, 0, n)
    for _ in range(256):
        if not pending:
            return out
        brackets: dict[tuple, list] = {}
        for cr, br in pending.items():
            brackets.setdefault(br, []).append(cr[1])
        pending = {}
        small, big = [], []
        fetched = 0
        for br, rs in sorted(brackets.items(), key=lambda b: b[0][4]):
            c, lo, hi, below, cnt = br
            if lo == hi:
                out.update({(c, r): lo for r in rs})
            elif fetched + cnt <= max_collect:  # a bound for all columns together
                fetched += cnt
                small.append((br, rs))
            else:
                big.append((br, rs))
        width = max(64, min(bins, bins * 64 // max(1, len(big))))
        if small:
            tags = [F.when((named(br[0]).cast("double") >= br[1]) & (named(br[0]).cast("double") <= br[2]),
                           F.struct(F.lit(i).alias("b"), named(br[0]).cast("double").alias("x")))
                    for i, (br, _) in enumerate(small)]
            got: dict[int, list] = {}
            for row in df.select(F.explode(F.array(*tags)).alias("t")).where(F.col("t").isNotNull()).select("t.*").collect():
                got.setdefault(row["b"], []).append(row["x"])
            for i, (br, rs) in enumerate(small):
                vals = sorted(got.get(i, []))
                out.update({(br[0], r): vals[r - br[3]] for r in rs})
        if big:
            tags = []
            for i, (br, _) in enumerate(big):
                c, lo, hi = br[0], br[1], br[2]
                x = named(c).cast("double")
                scale = (x / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves avoid overflow of hi - lo
                bucket = F.least(F.floor(scale * width), F.lit(width - 1)).cast("int")
                tags.append(F.when((x >= lo) & (x <= hi), F.struct(F.lit(i).alias("b"), bucket.alias("k"), x.alias("x"))))
            hist = (df.select(F.explode(F.array(*tags)).alias("t")).where(F.col("t").isNotNull()).select("t.*")
                    .groupBy("b", "k").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
                    .collect())
            per: dict[int, list] = {}
            for h in hist:
                per.setdefault(h["b"], []).append(h)
            for i, (br, rs) in enumerate(big):
                hs = sorted(per.get(i, []), key=lambda h: h["k"])
                for r in rs:
                    acc = br[3]
                    for h in hs:
                        if acc <= r < acc + h["c"]:
                            pending[(br[0], r)] = (br[0], h["lo"], h["hi"], acc, h["c"])
                            break
                        acc += h["c"]
    raise RuntimeError("order statistics did not converge")  # pragma: no cover


def order_statistics(df: DataFrame, col: str, ranks: list[int], **kw) -> dict[int, float]:
    """Exact values at 0-based ``ranks`` of the non-null values of ``col``."""
    res = multi_order_statistics(df, {col: ranks}, **kw)
    return {r: v for (_, r), v in res.items()}


def multi_quantiles(df: DataFrame, cols: list[str], probs: list[float], **kw) -> dict[str, list]:
    """Linear-interpolated quantiles (position (n-1)·p, as numpy / Spark ``percentile``) for
    several columns, sharing scans."""
    st = _stats(df, cols)
    req, pos = {}, {}
    for c in cols:
        n = st[c][0]
        if n == 0:
            continue
        req[c] = []
        for p in probs:
            x = (n - 1) * float(p)
            req[c] += [math.floor(x), math.ceil(x)]
    vals = multi_order_statistics(df, req, stats=st, **kw) if req else {}
    out = {}
    for c in cols:
        n = st[c][0]
        if n == 0:
            out[c] = [None for _ in probs]
            continue
        res = []
        for p in probs:
            x = (n - 1) * float(p)
            lo_i, hi_i = math.floor(x), math.ceil(x)
            a, b = vals[(c, lo_i)], vals[(c, hi_i)]
            res.append(a if lo_i == hi_i else a + (b - a) * (x - lo_i))
        out[c] = res
    return out


def exact_quantiles(df: DataFrame, col: str, probs: list[float], **kw) -> list[float | None]:
    return multi_quantiles(df, [col], probs, **kw)[col]


def exact_median(df: DataFrame, col: str, **kw) -> float | None:
    return exact_quantiles(df, col, [0.5], **kw)[0]


def medians(df: DataFrame, cols: list[str], **kw) -> dict[str, float | None]:
    return {c: v[0] for c, v in multi_quantiles(df, cols, [0.5], **kw).items()}


def modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column; ties go to the smallest value.

    Value counts are map-side combined per (column, value); the winner per
    column is a ``min(struct(-count, value))`` aggregate, so a hot value never
    lands in one task as rows.
    """
    out: dict[str, object] = {}
    if not cols:
        return out
    types = dict(df.dtypes)
    str_cols = [c for c in cols if types[c] == "string"]
    other = [c for c in cols if c not in str_cols]
    if str_cols:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), named(c).alias("v"))
                                              for c in str_cols])).alias("kv")).select("kv.k", "kv.v")
        res = (long.where(F.col("v").isNotNull()).groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
               .groupBy("k").agg(F.min(F.struct((-F.col("c")).alias("nc"), F.col("v"))).alias("m"))
               .collect())
        for r in res:
            out[r["k"]] = r["m"]["v"]
    for c in other:
        r = (df.where(named(c).isNotNull()).groupBy(named(c).alias("v")).agg(F.count(F.lit(1)).alias("c"))
             .agg(F.min(F.struct((-F.col("c")).alias("nc"), F.col("v"))).alias("m")).first())
        out[c] = r["m"]["v"] if r and r["m"] is not None else None
    for c in cols:
        out.setdefault(c, None)
    return out
