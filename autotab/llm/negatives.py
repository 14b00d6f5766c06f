"""Hard negatives from Parquet blocks in the order of a Hilbert curve, with zone maps.

Candidates are sorted by label and, within a label, along a Hilbert curve through the ``AXES`` components of the largest
spread. Runs of them become blocks: rows of a Parquet table, each with the smallest and largest value of every
component (its zone map) and the labels it spans. The about ``TILE`` blocks of a range partition make a tile.

For an anchor a, interval arithmetic over a zone map gives the least and the largest inner product that any vector
of the block can have with a:  sum_i min(a_i lo_i, a_i hi_i) .. sum_i max(a_i lo_i, a_i hi_i).

1. Positives. The anchor's own block holds near vectors of its label: their products give a first bound for its
   ``POSITIVES`` best. Only blocks that span its label and whose upper product reaches the bound are read.
2. Negatives. Each positive score p gives a window: p/2 <= product <= 0.95 p in whole numbers. Only blocks that hold another label
   and whose interval meets one of the anchor's windows are read, above the products already found in that window.

Anchors are packed in groups. A group meets a tile only if one of its anchors needs one of the tile's blocks, and
of the tile's blocks only the needed ones are read. Within the tile they are read by falling upper product with the bounds
carried on, and at most ``POSITIVES`` (``NEGATIVES`` per window) rows an anchor leave it. Products are exact.

The zone maps of all tiles meet the anchors' groups tile by tile, so none of them passes through the driver. The table of
blocks stands in the shared checkpoint folder until the result is there.

Cases: rows with a NULL id, label or vector or a NULL or non-finite component take no part; shorter vectors count as
filled up with zeros; ties go to the smaller id; rows that share an id are candidates each, but none is a candidate of an
anchor with that id; equal anchor rows count once, different ones with the same id have lists each; anchors without
positives, windows without negatives and empty tables give no rows; other columns are ignored.
Inner products have to fit 64-bit whole numbers.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage
from .common import removed, table
from .merkle import numbered
from .topk import products

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Window of a positive score p: LOW * p <= WHOLE * negative <= HIGH * p.
LOW, HIGH, WHOLE = 50, 95, 100
#: Bytes of a block's and of an anchor group's vectors (as 64-bit numbers), blocks of a tile.
BLOCK_BYTES, GROUP_BYTES, TILE = 1 << 19, 1 << 18, 16
AXES, AXIS_BITS = 6, 10
BLOCK = ("tile int, block long, n int, dim int, first_label int, last_label int, lo array<double>, hi array<double>, "
         "ids binary, labels binary, kind string, data binary")
GROUP = "an int, adim int, aids binary, alabels binary, kind string, adata binary, wlo binary, whi binary"
#: Relative rounding that bounds allow for.
SLACK = 1e-9


def taking_part(vectors: DataFrame, label: Column) -> DataFrame:
    """id, label, v (array of whole doubles) of the rows that take part."""
    v = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("double"))
    ok = (F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & label.isNotNull()
          & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("id"), label.cast("int").alias("label"), v.alias("v"))


def widest_axes(rows: DataFrame) -> list[tuple[int, float, float]]:
    """(component, least, largest value) of the components with the largest spread; at most ``AXES`` rows reach the driver."""
    cells = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return [(r.i, r.lo, r.hi) for r in cells.orderBy(F.col("s").desc(), "i").limit(AXES).collect()]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of whole points (rows) with ``bits`` bits a component: turns and flips are undone from the
    high bits to the low ones, then a Gray code numbers the cells."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = 1 << b, (1 << b) - 1
        for i in range(n):
            flip = (x[i] & high) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    parity = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        parity ^= np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= parity
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def on_curve(rows: DataFrame) -> DataFrame:
    """``rows`` with their place ``curve``."""
    axes = widest_axes(rows)
    bits = AXIS_BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = np.zeros((len(pdf), max(1, len(axes))), np.int64)
            for k, (i, lo, hi) in enumerate(axes):
                x = np.array([v[i] if i < len(v) else 0.0 for v in pdf.v])
                cells[:, k] = np.clip((x - lo) / max(hi - lo, 1) * ((1 << bits) - 1), 0, (1 << bits) - 1).astype(np.int64)
            yield pdf.assign(curve=hilbert(cells, bits))

    return rows.mapInPandas(run, "id long, label int, v array<double>, curve long")


def matrix(vectors, dim: int) -> np.ndarray:
    m = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        m[i, :len(v)] = v
    return m


def narrow(m: np.ndarray) -> tuple[str, bytes]:
    """The matrix in the smallest type that holds its whole numbers."""
    top = np.abs(m).max(initial=0)
    kind = next((k for k, most in (("<i2", 2 ** 15), ("<i4", 2 ** 31)) if top < most), "<f8")
    return kind, m.astype(kind).tobytes()


def wide(kind: str, data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, dim).astype(float)


def blocks_of(rows: DataFrame, dim: int) -> DataFrame:
    """Blocks of consecutive rows in the order of label, curve and id."""
    size = max(1, BLOCK_BYTES // (8 * max(1, dim)))
    order = ["label", "curve", "id", "tie"]

    def pack(part: int, n: int, pdf: pd.DataFrame) -> pd.DataFrame:
        m = matrix(pdf.v, dim)
        return pd.DataFrame([[part, part << 32 | n, len(pdf), dim, int(pdf.label.iloc[0]), int(pdf.label.iloc[-1]), m.min(0).tolist(), m.max(0).tolist(),
                              pdf.id.to_numpy(np.int64).tobytes(), pdf.label.to_numpy(np.int32).tobytes(), *narrow(m)]],
                            columns=["tile", "block", "n", "dim", "first_label", "last_label", "lo", "hi", "ids", "labels", "kind", "data"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, n, left = TaskContext.get().partitionId(), 0, None
        for pdf in batches:
            left = pdf if left is None else pd.concat([left, pdf])
            while len(left) >= size:
                yield pack(part, n, left.iloc[:size])
                n, left = n + 1, left.iloc[size:]
        if left is not None and len(left):
            yield pack(part, n, left)

    parts = max(1, -(-rows.count() // (size * TILE)))
    # rows that are alike in everything still spread over partitions
    return rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(run, BLOCK)


def unpacked(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int32), wide(r.kind, r.data, r.n, r.dim)


def intervals(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of each row of ``a`` with any vector inside each zone."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    low, high = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    slack = SLACK * np.maximum(np.abs(low), np.abs(high))
    return low - slack, high + slack


def best(k: int, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the k first in the order of falling score and rising id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Anchors:
    """The anchors of a group row with the rows found so far in each of their windows."""

    def __init__(self, r, keep: int):
        self.ids, self.labels, self.a = np.frombuffer(r.aids, np.int64), np.frombuffer(r.alabels, np.int32), wide(r.kind, r.adata, r.an, r.adim)
        self.lo, self.hi = (np.frombuffer(x).reshape(r.an, -1) for x in (r.wlo, r.whi))
        self.keep, self.found = keep, {}
        self.least = self.lo.copy()   # products below cannot be among the window's first

    def needs(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, other: bool) -> np.ndarray:
        """Which anchors (rows) must read which blocks (columns)."""
        own = (first[None, :] <= self.labels[:, None]) & (self.labels[:, None] <= last[None, :])
        pure = own & (first == last)[None, :]
        need = np.zeros(low.shape, bool)
        for w in range(self.lo.shape[1]):
            need |= (high >= self.least[:, w, None]) & (low <= self.hi[:, w, None])
        return need & (~pure if other else own)

    def read(self, who: np.ndarray, ids: np.ndarray, labels: np.ndarray, c: np.ndarray, other: bool) -> None:
        for i, scores in zip(who.tolist(), products(self.a[who], c), strict=True):
            ok = ((labels != self.labels[i]) if other else (labels == self.labels[i])) & (ids != self.ids[i])
            for w in range(self.lo.shape[1]):
                at = np.flatnonzero(ok & (scores >= self.least[i, w]) & (scores <= self.hi[i, w]))
                if len(at):
                    s, o = self.found.get((i, w), (np.empty(0, np.int64), np.empty(0, np.int64)))
                    s, o = np.concatenate([s, scores[at]]), np.concatenate([o, ids[at]])
                    first = best(self.keep, s, o)
                    self.found[i, w] = s[first], o[first]
                    if len(first) == self.keep:
                        self.least[i, w] = max(self.least[i, w], s[first[-1]])


def sweep(groups: DataFrame, blocks: DataFrame, keep: int, other: bool) -> DataFrame:
    """(grp, place, win, id, score): per anchor, window and tile the first ``keep`` candidates in the window.

    ``groups``: grp and the columns of ``GROUP`` with the windows per anchor; ``blocks``: as ``blocks_of`` gives them."""
    zones = blocks.groupBy("tile").agg(F.collect_list(F.struct("block", "lo", "hi", "first_label", "last_label")).alias("zones"))
    tiles = (blocks.agg(F.max("tile")).first()[0] or 0) + 1

    def need(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                z, group = list(r.zones), Anchors(r, keep)
                low, high = intervals(group.a, *(np.array([list(x[k]) for x in z]) for k in ("lo", "hi")))
                wanted = group.needs(low, high, *(np.array([x[k] for x in z]) for k in ("first_label", "last_label")), other).any(0)
                out.append([z[i]["block"] for i in np.flatnonzero(wanted)])
            yield pdf.drop(columns=["zones"]).assign(need=out)

    # the stated query set, in groups, against the zone maps of every tile
    met = groups.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).join(zones, "tile")
    asked = cut_lineage(met.mapInPandas(need, f"tile int, grp long, {GROUP}, need array<long>").where(F.size("need") > 0))
    pairs = asked.select(F.col("grp").alias("for_grp"), F.explode("need").alias("need_block"))
    sides = blocks.withColumnRenamed("tile", "in_tile").join(pairs, F.col("block") == F.col("need_block")).drop("need_block")

    def read(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.itertuples():
            group, rows = Anchors(r, keep), list(right.itertuples())
            low, high = intervals(group.a, *(np.array([list(x) for x in right[k]]) for k in ("lo", "hi")))
            for j in np.argsort(-high.max(0), kind="stable"):
                b = rows[j]
                who = np.flatnonzero(group.needs(low[:, j:j + 1], high[:, j:j + 1], np.array([b.first_label]), np.array([b.last_label]), other)[:, 0])
                if len(who):
                    group.read(who, *unpacked(b), other)
            out += [(r.grp, i, w, int(x), int(y)) for (i, w), (s, o) in group.found.items() for x, y in zip(o, s, strict=True)]
        return pd.DataFrame(out, columns=["grp", "place", "win", "id", "score"])

    return asked.drop("need").groupBy("grp", "tile").cogroup(sides.groupBy("for_grp", "in_tile")).applyInPandas(read, "grp long, place int, win int, id long, score long")


def anchors_of(blocks: DataFrame, step: int) -> DataFrame:
    """(block, place, id, label, v, lo): the rows whose id ``step`` divides, with the ``POSITIVES``-th best product of the
    anchor's label in its own block as a first bound (minus infinity where it holds fewer)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf.itertuples():
                ids, labels, c = unpacked(b)
                out = []
                for i in np.flatnonzero(ids % step == 0):
                    s = products(c[i:i + 1], c)[0][(labels == labels[i]) & (ids != ids[i])]
                    low = np.partition(s, len(s) - POSITIVES)[len(s) - POSITIVES] if len(s) >= POSITIVES else -math.inf
                    out.append((b.block, int(i), int(ids[i]), int(labels[i]), c[i].tolist(), float(low)))
                yield pd.DataFrame(out, columns=["block", "place", "id", "label", "v", "lo"])

    return blocks.mapInPandas(run, "block long, place int, id long, label int, v array<double>, lo double").dropDuplicates(["id", "label", "v"])


def grouped(anchors: DataFrame, dim: int, size: int) -> DataFrame:
    """Rows of ``size`` anchors (position, id, label, v, wlo and whi arrays) that follow each other on the curve."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        kind, data = narrow(matrix(pdf.v, dim))
        return pd.DataFrame([[int(key[0]), len(pdf), dim, pdf.id.to_numpy(np.int64).tobytes(), pdf.label.to_numpy(np.int32).tobytes(), kind, data,
                              np.array(list(map(list, pdf.wlo)), float).tobytes(), np.array(list(map(list, pdf.whi)), float).tobytes()]],
                            columns=["grp", "an", "adim", "aids", "alabels", "kind", "adata", "wlo", "whi"])

    return cut_lineage(anchors.withColumn("grp", F.floor(F.col("position") / size).cast("long")).groupBy("grp").applyInPandas(run, f"grp long, {GROUP}"))


def ranked(found: DataFrame, size: int, keep: int) -> DataFrame:
    """(position, win, rank, id, score) of the first ``keep`` of every anchor and window."""
    by = Window.partitionBy("grp", "place", "win").orderBy(F.col("score").desc(), "id")
    d = found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= keep)
    return d.select((F.col("grp") * size + F.col("place")).alias("position"), "win", "rank", "id", "score")


def hard_negatives(rows: DataFrame, step: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors, the rows whose id ``step``
    divides, among ``rows`` as ``taking_part`` gives them."""
    spark = rows.sparkSession
    rows = cut_lineage(rows)
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if not dim:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    folder = f"{checkpoint_dir(spark)}/blocks-{uuid.uuid4()}"
    blocks_of(cut_lineage(on_curve(rows)), dim).write.parquet(folder)
    blocks = spark.read.parquet(folder)
    anchors = numbered(anchors_of(blocks, step).withColumn("all", F.lit("")), "all", ["block", "place"]).select("position", "id", "label", "v", "lo")
    anchors = cut_lineage(anchors)
    size = max(1, min(GROUP_BYTES // (8 * dim), -(-anchors.count() // spark.sparkContext.defaultParallelism)))

    top = grouped(anchors.select("position", "id", "label", "v", F.array("lo").alias("wlo"), F.array(F.lit(math.inf)).alias("whi")), dim, size)
    positives = cut_lineage(ranked(sweep(top, blocks, POSITIVES, False), size, POSITIVES))

    p = F.col("score").cast("decimal(38,0)")
    low, high = F.ceil(p * LOW / WHOLE).cast("double"), F.floor(p * HIGH / WHOLE).cast("double")
    none = F.struct(F.lit(math.inf).alias("lo"), F.lit(-math.inf).alias("hi"))
    window = F.when(low <= high, F.struct(low.alias("lo"), high.alias("hi"))).otherwise(none)
    windows = positives.groupBy("position").agg(F.map_from_entries(F.collect_list(F.struct(F.col("rank"), window.alias("w")))).alias("w"))
    each = F.transform(F.sequence(F.lit(1), F.lit(POSITIVES)), lambda i: F.coalesce(F.col("w")[i], none))
    asking = anchors.join(windows, "position").select("position", "id", "label", "v", F.transform(each, lambda x: x["lo"]).alias("wlo"), F.transform(each, lambda x: x["hi"]).alias("whi"))
    negatives = ranked(sweep(grouped(asking, dim, size), blocks, NEGATIVES, True), size, NEGATIVES)

    out = (negatives.withColumn("place", F.col("win") + 1).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
           .join(positives.select("position", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["position", "place"])
           .join(anchors.select("position", F.col("id").alias("anchor_id")), "position"))
    out = cut_lineage(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    removed(spark, folder)
    return out


ANCHOR_STEP, MOVED_STEP, LABELS = 50, 7, 10


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % MOVED_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(taking_part(table(spark, sf_dir, "embeddings"), moved), ANCHOR_STEP)


OP11_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT *, row_number() OVER () AS k FROM (SELECT DISTINCT id, label, v FROM v WHERE id % 50 = 0)),
s AS (SELECT k, a.id AS anchor_id, c.id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
      FROM a JOIN v c ON a.id <> c.id),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.k, p.place ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
      FROM p JOIN s ON p.k = s.k AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
