"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range-partitioned by length into buckets; each bucket is one row that packs its
vectors in decreasing length. The longest bucket gives every query a first bound: its k-th best
product so far. With it a query needs of a bucket only vectors whose cosine reaches the local
threshold bound / (|q| * longest of the bucket). Above 1 the bucket is skipped. Otherwise the
bucket is pruned by length (a prefix of its vectors) or, where that leaves fewer, by the query's
strongest coordinates: a cosine of at least t forces each unit coordinate into
q*t +- sqrt((1 - q^2) * (1 - t^2)), an interval found by binary search in the bucket's vectors
sorted by that coordinate. The products of what is left are verified exactly.

Query blocks meet only the buckets that some query of the block still needs, in tiles of one bucket
and at most ``TILE`` query blocks. Only the buckets' lengths reach the driver: two numbers for each of at most
``MAX_BUCKETS`` rows.

Cases: vectors that are NULL or hold NULL, NaN or infinite components take no part; components are
floor(64 * x); shorter vectors count as filled up with zeros; ties go to the smaller id; rows with
the same id are candidates each, but none is a candidate of a query with that id; a query with
fewer than k candidates gets all; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table

K, SCALE, QUERY_STEP = 20, 64, 20
BUCKET_ROWS, QUERY_ROWS, MAX_BUCKETS = 4096, 512, 65_536
COORDINATES, TILE = 3, 32
#: Products up to this are exact in floating point.
EXACT = 2.0 ** 53
SLACK = 1e-9
BLOCK = "block long, n int, dim int, longest double, ids binary, data binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """id, v (array of whole doubles), length; only vectors that take part."""
    v = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("double"))
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.where(ok).select(F.col("vec_id").alias("id"), v.alias("v"))
            .withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))))


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """One row per run of at most ``rows`` vectors of a partition, by decreasing length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, n, left = TaskContext.get().partitionId(), 0, []

        def pack(pdf):
            pdf = pdf.sort_values(["length", "id"], ascending=[False, True], kind="stable")
            dim = max(map(len, pdf.v), default=0)
            m = np.zeros((len(pdf), dim))
            for i, v in enumerate(pdf.v):
                m[i, :len(v)] = v
            return pd.DataFrame([[part << 32 | n, len(pdf), dim, float(pdf.length.max()), pdf.id.to_numpy(np.int64).tobytes(), m.tobytes()]],
                                columns=["block", "n", "dim", "longest", "ids", "data"])

        for pdf in batches:
            left.append(pdf)
            while sum(map(len, left)) >= rows:
                whole = pd.concat(left)
                yield pack(whole.iloc[:rows])
                n, left = n + 1, [whole.iloc[rows:]]
        if sum(map(len, left)):
            yield pack(pd.concat(left))

    return vectors.mapInPandas(run, BLOCK)


def unpack(ids: bytes, data: bytes, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(n, dim)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, as int64."""
    dim = min(q.shape[1], c.shape[1])
    q, c = q[:, :dim], c[:, :dim]
    top = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * max(dim, 1)
    return (q @ c.T).astype(np.int64) if top < EXACT else q.astype(np.int64) @ c.astype(np.int64).T


def best(ids: np.ndarray, scores: np.ndarray, own: int, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the scores that reach the bound; lower ones cannot be among the query's k best."""
    keep = (ids != own) & (scores >= bound)
    ids, scores = ids[keep], scores[keep]
    if len(ids) > 4 * k:  # all scores that reach the k-th highest, ties included
        some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_block(q_ids, q, bounds, c_ids, c, k):
    """(query id, candidate ids, scores) of a query block in a bucket sorted by decreasing length."""
    c_len, q_len = np.sqrt((c * c).sum(1)), np.sqrt((q * q).sum(1))
    unit = c / np.maximum(c_len, 1e-300)[:, None]
    order = np.argsort(unit, axis=0)
    column = np.take_along_axis(unit, order, 0)
    by_length: dict[int, list[int]] = {}
    for i in range(len(q_ids)):
        if q_len[i] == 0 or not math.isfinite(bounds[i]) or bounds[i] <= 0 or c_len[0] == 0:
            by_length.setdefault(len(c), []).append(i)
            continue
        t = bounds[i] / (q_len[i] * c_len[0]) * (1 - SLACK)
        if t > 1:
            continue
        least, pick = int(np.searchsorted(-c_len, -bounds[i] / q_len[i] * (1 - SLACK), side="right")), None
        u = q[i] / q_len[i]
        for f in np.argsort(-np.abs(u[:c.shape[1]]))[:COORDINATES]:
            wide = math.sqrt(max(0.0, (1 - u[f] ** 2) * (1 - t * t))) + SLACK
            lo = 0 if u[f] < -t else int(np.searchsorted(column[:, f], u[f] * t - wide, "left"))
            hi = len(c) if u[f] > t else int(np.searchsorted(column[:, f], u[f] * t + wide, "right"))
            if hi - lo < least // 2:
                least, pick = max(hi - lo, 0), order[lo:max(hi, lo), f]
        if pick is None:
            by_length.setdefault(least, []).append(i)
        else:
            yield (q_ids[i], *best(c_ids[pick], products(q[i:i + 1], c[pick])[0], q_ids[i], k, bounds[i]))
    longest = max(by_length, default=0)
    chosen = [i for some in by_length.values() for i in some]
    if longest and chosen:
        some = products(q[chosen], c[:longest])
        prefix_of = {i: n for n, rows in by_length.items() for i in rows}
        for row, i in zip(some, chosen, strict=True):
            n = prefix_of[i]
            yield (q_ids[i], *best(c_ids[:n], row[:n], q_ids[i], k, bounds[i]))


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs as ``quantised`` gives them."""
    vectors, queries = cut_lineage(vectors), cut_lineage(queries)
    n, n_queries = vectors.count(), queries.count()
    rows = max(BUCKET_ROWS, -(-n // MAX_BUCKETS))

    def blocks_of(v, n, rows):
        order = [F.col("length").desc(), F.col("id")]
        return cut_lineage(packed(v.repartitionByRange(max(1, -(-n // rows)), *order).sortWithinPartitions(*order), rows))

    buckets, blocks = blocks_of(vectors, n, rows), blocks_of(queries, n_queries, QUERY_ROWS)
    lengths = sorted(((r.longest, r.block) for r in buckets.select("longest", "block").collect()), reverse=True)
    first = buckets.where(F.col("block") == lengths[0][1]).first() if lengths else None
    longest, names = np.array([x for x, _ in lengths]), [b for _, b in lengths]

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c_ids, c = unpack(first.ids, first.data, first.n, first.dim)
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                ids, q = unpack(r.ids, r.data, r.n, r.dim)
                low = np.full(r.n, -math.inf)
                for i, scores in enumerate(products(q, c)):
                    s = scores[c_ids != ids[i]]
                    if len(s) >= k:
                        low[i] = np.partition(s, len(s) - k)[len(s) - k]
                q_len = np.sqrt((q * q).sum(1))
                least = np.where((low > 0) & (q_len > 0), low / np.maximum(q_len, 1e-300), 0.0).min(initial=math.inf)
                need = int(np.searchsorted(-longest, -least * (1 - SLACK), side="right"))
                out.append([r.block, r.n, r.dim, r.ids, r.data, low.tobytes(), names[:need]])
            yield pd.DataFrame(out, columns=["qblock", "qn", "qdim", "qids", "qdata", "bounds", "need"])

    if first is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bounded = cut_lineage(blocks.mapInPandas(bound, "qblock long, qn int, qdim int, qids binary, qdata binary, bounds binary, need array<long>"))
    tiles = -(-blocks.count() // TILE)
    asked = (bounded.withColumn("tile", F.pmod(F.xxhash64("qblock"), F.lit(max(1, tiles))))
             .withColumn("block", F.explode("need")).drop("need"))
    pairs = asked.select(F.col("block").alias("pblock"), F.col("tile").alias("ptile")).distinct()
    sides = buckets.join(pairs, F.col("block") == F.col("pblock"))

    def tile(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        got = []
        for r in c.itertuples():
            c_ids, data = unpack(r.ids, r.data, r.n, r.dim)
            for x in q.itertuples():
                ids, m = unpack(x.qids, x.qdata, x.qn, x.qdim)
                got += [(o, i, s) for o, i, s in search_block(ids, m, np.frombuffer(x.bounds), c_ids, data, k) if len(i)]
        return pd.DataFrame({"query_id": np.repeat(np.array([o for o, _, _ in got], np.int64), [len(i) for _, i, _ in got]),
                             "vec_id": np.concatenate([i for _, i, _ in got] or [np.empty(0, np.int64)]),
                             "score": np.concatenate([s for _, _, s in got] or [np.empty(0, np.int64)])})

    found = asked.groupBy("block", "tile").cogroup(sides.groupBy("pblock", "ptile")).applyInPandas(
        tile, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("id") % QUERY_STEP == 0))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
