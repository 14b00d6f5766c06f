"""Near-duplicate classes by DartMinHash.

A document is the weighted set of its five-word shingles (weight: how often it stands there). For
every shingle, hashed darts fall on the plane of weight and rank as a unit-rate Poisson process:
the weight axis is cut to the regions [0, 1), [1, 2), [2, 4), ..., and within a region the darts
come by rising rank with exponential gaps. A document owns the darts below its weights and, at
first, below a rank at which it owns about K (ln K + 2) of them; each dart belongs to one of K
coordinates, and the earliest of a coordinate is its signature there. While a coordinate is empty,
the rank limit doubles. Two documents agree in a coordinate with their weighted Jaccard similarity.

Bands of the signature are bucketed by an equi-join. Documents with equal text are one node from
the start. First every node is compared, exactly, with the smallest node of its buckets, which
settles groups of much alike copies with one comparison a node. What buckets still tie together
but lies in different classes is compared exactly in tiles: the nodes that buckets chain to each
other are cut to chunks of at most ``CHUNK``, and each pair of chunks is one small group, in which a
matrix product gives all overlaps. Chunks of one and the same class need no tile, a tile returns a
forest of links only, and no bucket or class is ever collected; no link between classes is lost.

Cases: a NULL text is empty; texts without words are in one class only if equal; fewer than five
words are one shingle; NULL ids take part and never name a class that has another id; repeated
rows are members each; empty tables give empty tables; other columns pass through ``first_of_class``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import carried, content_key, map_texts, release, restored, slices, table, whole_text
from .graph import components
from .tokens import U, mix, shingles

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 24, 5
K = BANDS * BAND_ROWS
CHUNK, SALTS = 256, 32


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> U(11)).astype(np.float64) + 1.0) / 9007199254740992.0


def darts(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc * K + coordinate, rank, dart) of all darts that the documents own below their rank limits."""
    regions = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    at = np.repeat(np.arange(len(doc)), regions)
    region = np.arange(len(at)) - np.repeat(np.cumsum(regions) - regions, regions)
    low = np.where(region == 0, 0.0, 2.0 ** (region - 1))
    width = np.where(region == 0, 1.0, low)
    with np.errstate(over="ignore"):
        seed = mix(element[at] + region.astype(U) * U(0xA0761D6478BD642F))
        rank, slot, rank_id, dart_id, j = np.zeros(len(at)), [], [], [], 0
        while len(at):
            h = mix(seed + U(j) * U(0x9E3779B97F4A7C15))
            rank = rank - np.log(unit(h)) / width
            alive = rank < limit[doc[at]]
            at, rank, seed, low, width, h = at[alive], rank[alive], seed[alive], low[alive], width[alive], h[alive]
            g = mix(h ^ U(0xE7037ED1A0B428DB))
            owned = low + width * unit(g) <= weight[at]
            dart = mix(g[owned] + U(1))
            slot.append(doc[at[owned]] * K + (mix(dart) % U(K)).astype(np.int64))
            rank_id.append(rank[owned])
            dart_id.append(dart)
            j += 1
    return np.concatenate(slot or [np.empty(0, np.int64)]), np.concatenate(rank_id or [np.empty(0)]), np.concatenate(dart_id or [np.empty(0, U)])


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts that have words, and their K earliest darts."""
    doc, element, weight = shingles(texts, SHINGLE)
    total = np.bincount(doc, weights=weight, minlength=len(texts))
    have = np.flatnonzero(total > 0)
    limit = K * (np.log(K) + 2) / np.maximum(total, 1)
    out = np.zeros((len(texts), K), dtype=U)
    todo = np.zeros(len(texts), dtype=bool)
    todo[have] = True
    while todo.any():
        pick = todo[doc]
        slot, rank, dart = darts(doc[pick], element[pick], weight[pick].astype(np.float64), limit)
        earliest = np.full(len(texts) * K, np.inf)
        np.minimum.at(earliest, slot, rank)
        first = rank == earliest[slot]
        sign = np.full(len(texts) * K, np.iinfo(U).max, dtype=U)
        np.minimum.at(sign, slot[first], dart[first])
        done = todo & np.isfinite(earliest).reshape(len(texts), K).all(1)
        out[done] = sign.reshape(len(texts), K)[done]
        todo &= ~done
        limit = limit * 2
    return have, out[have]


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.repeat(np.arange(1, BANDS + 1, dtype=U)[None, :], len(sig), 0)
        for r in range(BAND_ROWS):
            key = mix(key * U(0x9FB21C651E98DF25) + sig.reshape(len(sig), BANDS, BAND_ROWS)[:, :, r])
    return key.view(np.int64)


def banded(nodes: DataFrame) -> DataFrame:
    """(node, bands) of the texts with words."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        have, sig = signatures([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
        values = pa.array(band_keys(sig).reshape(-1))
        offsets = pa.array(np.arange(len(have) + 1, dtype=np.int32) * BANDS)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(have)), pa.ListArray.from_arrays(offsets, values)], names=["node", "bands"])

    return map_texts(nodes.select("node", "text"), run, "node binary, bands array<long>")


def verified(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have a weighted Jaccard similarity of SIMILARITY or more."""
    one = pairs.join(payload.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(payload.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in batches:
            for b in slices([wide], 2):
                n = b.num_rows
                ta, tb = (b.column(c).to_pylist() for c in (2, 3))
                names: dict[str, int] = {}
                left, right = ([names.setdefault(t, len(names)) for t in x] for x in (ta, tb))
                doc, element, weight = shingles([t.encode("utf-8", "surrogatepass") for t in names], SHINGLE)
                cut = np.searchsorted(doc, np.arange(len(names) + 1))
                keep = []
                for i in range(n):
                    x, y = slice(cut[left[i]], cut[left[i] + 1]), slice(cut[right[i]], cut[right[i] + 1])
                    if x == y:
                        keep.append(i)
                        continue
                    _, p, q = np.intersect1d(element[x], element[y], assume_unique=True, return_indices=True)
                    shared = int(np.minimum(weight[x][p], weight[y][q]).sum())
                    if shared >= SIMILARITY * (int(weight[x].sum()) + int(weight[y].sum()) - shared):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return two.mapInArrow(run, "a binary, b binary")


def overlaps(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x n sums of the smaller weights: products of 0/1 matrices with a column per (shingle, level of weight)."""
    at = np.repeat(np.arange(len(doc)), weight)
    level = np.arange(len(at)) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        _, column, count = np.unique(element[at] + level.astype(U) * U(0xA0761D6478BD642F), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, row = np.unique(column[shared], return_inverse=True)[1], doc[at[shared]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((n, n), dtype=np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        some = slice(*np.searchsorted(column, [low, low + 4096]))
        m = np.zeros((n, 4096), dtype=np.float32)
        m[row[some], column[some] - low] = 1
        out += m @ m.T
    return out


def links_in_tile(nodes: list[bytes], labels: list[bytes], texts: list[str]) -> list[tuple[bytes, bytes]]:
    """A forest of the links that tie different labels together."""
    doc, element, weight = shingles([t.encode("utf-8", "surrogatepass") for t in texts], SHINGLE)
    total = np.bincount(doc, weights=weight, minlength=len(texts))
    shared = overlaps(doc, element, weight, len(texts))
    found = np.argwhere(np.triu(shared >= SIMILARITY * (total[:, None] + total[None, :] - shared), 1) & (shared > 0))
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while x in parent:
            x = parent[x]
        return x

    out = []
    for i, j in found.tolist():
        x, y = root(labels[i]), root(labels[j])
        if x != y:
            parent[x] = y
            out.append((nodes[i], nodes[j]))
    return out


def tiled(named: DataFrame, payload: DataFrame) -> DataFrame:
    """Links (a, b) between the classes (label) of each cluster. ``named``: node, cluster, label."""
    # clusters and large classes are joined by a salt as well, so that the rows of one that is large spread over tasks
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sizes = named.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    apart = (sizes.groupBy("cluster").agg(F.count(F.lit(1)).alias("classes"), F.sum(F.when(F.col("n") <= CHUNK, F.col("n"))).alias("rest"))
             .where("classes > 1").select("cluster", "rest", salts))
    large = sizes.where(F.col("n") > CHUNK).select("cluster", "label", "n", F.col("label").alias("pure"), salts)
    of = (named.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
          .join(apart, ["cluster", "salt"]).join(large, ["cluster", "label", "salt"], "left")
          .withColumn("sub", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.coalesce("n", "rest") / CHUNK)))
          .withColumn("chunk", F.xxhash64("cluster", "pure", "sub")))
    of = cut_lineage(of.select("node", "label", "cluster", "chunk", "pure"))
    chunks = of.select("cluster", "chunk", "pure").distinct()
    other = chunks.select("cluster", F.col("chunk").alias("chunk2"), F.col("pure").alias("pure2"))
    pairs = chunks.join(other, "cluster").where((F.col("chunk") <= F.col("chunk2")) & (F.col("pure").isNull() | F.col("pure2").isNull() | (F.col("pure") != F.col("pure2"))))
    tiles = pairs.select(F.xxhash64("chunk", "chunk2").alias("tile"), F.explode(F.array_distinct(F.array("chunk", "chunk2"))).alias("chunk"))
    filled = of.select("node", "label", "chunk").join(payload, "node").join(tiles, "chunk").select("tile", "node", "label", "text")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_in_tile(pdf.node.tolist(), pdf.label.tolist(), pdf.text.tolist()), columns=["a", "b"])

    return filled.groupBy("tile").applyInPandas(run, "a binary, b binary")


def labels_of(docs: DataFrame) -> DataFrame:
    """(node, label) of the nodes that are in a class with another text; ``docs`` has node and text."""
    bands = cut_lineage(banded(docs).dropDuplicates(["node"]))
    keys = bands.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub <> other").drop("other")
    member = cut_lineage(keys.join(shared, "key"))  # buckets of two nodes or more
    payload = cut_lineage(docs.select("node", "text").join(member.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    del bands, keys, shared
    release(docs.sparkSession)

    nearest = member.where("hub <> node").groupBy("node").agg(F.min("hub").alias("b")).select(F.col("node").alias("a"), "b")
    edges = cut_lineage(verified(nearest, payload))
    label = components(edges)
    release(docs.sparkSession)
    cluster = components(member.select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("label", "cluster")
    named = cut_lineage(cluster.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    links = cut_lineage(edges.unionByName(tiled(named, payload)))
    del member, payload, edges, label, cluster, named, nearest
    release(docs.sparkSession)
    return components(links)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id (the smallest id of the class), n_same_text, n_class."""
    d = docs.select("doc_id", whole_text().alias("text")).withColumn("node", content_key())
    label = labels_of(d)
    n = d.groupBy("node").agg(F.count(F.lit(1)).alias("n_same_text"), F.min("doc_id").alias("low"))
    n = n.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    n = cut_lineage(n)
    whole = n.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("n_same_text").alias("n_class"))
    return d.select("doc_id", "node").join(n.join(whole, "label").select("node", "class_id", "n_same_text", "n_class", "label"), "node")


def first_of_class(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the smallest id (NULL last), then of the smallest text address."""
    c = classes(docs)
    keep = c.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k")).select(
        F.col("k.doc_id").alias("kid"), F.col("k.node").alias("knode"))
    d = carried(docs, "doc_id", "text").withColumn("node", content_key())
    kept = d.join(keep, (F.col("node") == F.col("knode")) & F.col("doc_id").eqNullSafe(F.col("kid")), "left_semi")
    return restored(kept.dropDuplicates(["node", "doc_id"]), docs.columns)


def op4_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_same_text", "n_class")
