"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents stand in a permuted order (hash of id and text); the mix draws the first
target words of that order, going round at most twice. The drawn documents are cut to blocks
of about ``BLOCK_WORDS`` words, and the exact number of blocks of each source is its quota. A
binary tree parts the quotas among the output shards: at every node the left half of the blocks
is a multivariate-hypergeometric draw from the node's quotas, seeded by the node, so each leaf
can be computed by itself and reruns agree. Draws are exact for any number of blocks. A shard takes the next disjoint run of each source's
permuted blocks and orders its documents by a hash.

A document is drawn whole if its middle lies before the target, so a source's words miss its
target by half a document at most. Prefix sums run over hash ranges whose number follows the
rows, so a source with a third of all rows is summed by many tasks. One row per source (and, in
the tree, one number per source and shard) is all that stands together.

Cases: a NULL or wordless text has size 0 and counts as taken with 0 words; a NULL source is a
source of its own, last in order; equal rows are drawn each by itself; an empty table gives an empty table. Other columns pass through;
those called like one that the operator adds (``ADDED``) are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import HASH_BITS, row_hash
from ..functions.lookup import sized
from ..functions.ranking import hash_rank
from ..session import cut_lineage
from .common import WORD, carried, restored, table, whole_text

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK_WORDS, SHARD_BLOCKS, RANGE_ROWS, SEED = 4096, 1024, 8192, 17
ADDED = ["size", "row_key", "source_key", "source_size", "target", "position", "words_before", "epoch", "block", "shard"]


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_key (rank by code point, NULL last), source_size, rows, target.
    Water filling: sources are capped in the order of cap / weight as long as the common level exceeds it."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("source_key", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_key") - 1) % len(WEIGHTS) + 1))
    s = s.withColumn("cap", MOST * F.col("source_size")).withColumn("total", SHARE * F.sum("source_size").over(everything))
    tightest = everything.orderBy(F.col("cap") / F.col("w"), "source_key")
    before = F.coalesce(F.sum("cap").over(tightest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(tightest.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("capped", F.col("cap") * left <= (F.col("total") - before) * F.col("w"))
    given = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    share = F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0)).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("total") - given) / share * F.col("w"))
    return s.select("source", "source_key", "source_size", "rows", target.alias("target"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with size and row_key, equal for equal ids with equal texts only."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(whole_text()), F.lit(f"#{SEED}")))
    return docs.withColumn("size", size_of(whole_text())).withColumn("row_key", key)


def positions(narrow: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row (row_key, source, size) with its source's row, its rank in the permuted source (position), the words
    before it and its number among equal rows (twin)."""
    n = sources.agg(F.sum("rows")).first()[0] or 0
    bits = min(30, max(0, (n // RANGE_ROWS).bit_length()))
    src = sources.select(F.col("source").alias("__source"), "source_key", "source_size", "target")
    d = narrow.join(sized(src), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    top = md5_prefix("row_key")
    d = d.withColumn("__range", F.shiftright(top, HASH_BITS - bits) if bits else F.lit(0).cast("long"))
    keys = ["source_key", "__range"]
    sums = d.groupBy(*keys).agg(F.sum("size").alias("__w"), F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy("source_key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, *[F.coalesce(F.sum(c).over(run), F.lit(0)).alias(c) for c in ("__w", "__n")])
    inside, twins = Window.partitionBy(*keys).orderBy("row_key", "size"), Window.partitionBy(*keys, "row_key").orderBy("size")
    d = d.join(offsets, keys)
    return (d.withColumn("position", F.row_number().over(inside) - 1 + F.col("__n")).withColumn("twin", F.row_number().over(twins))
            .withColumn("words_before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("__w"))
            .drop("__range", "__w", "__n"))


def md5_prefix(col: str) -> Column:
    """The first HASH_BITS bits of an md5 in hexadecimal, as a number."""
    return F.conv(F.substring(col, 1, HASH_BITS // 4), 16, 10).cast("long")


def drawn(placed: DataFrame) -> DataFrame:
    """One row per drawn document and epoch, with the block in which it starts."""
    start = F.col("words_before") + F.col("epoch") * F.col("source_size")
    d = placed.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(MOST)])))
    return (d.where((2 * start + F.col("size") <= 2 * F.col("target")) & (F.col("size") > 0))
            .withColumn("block", F.floor(start / BLOCK_WORDS).cast("long")))


def subset(rng: np.random.Generator, k: int, n: int) -> np.ndarray:
    """A uniform set of ``k`` of the numbers below ``n``, sorted."""
    taken = np.empty(0, dtype=np.int64)
    while len(taken) < k:  # never more new numbers than are missing, so every set is as likely as any other
        taken = np.union1d(taken, rng.integers(0, n, k - len(taken)))
    return taken


def half_of(rng: np.random.Generator, counts: np.ndarray) -> np.ndarray:
    """Multivariate-hypergeometric draw of half (rounded down) of all items, of any number: each item goes left by
    a fair coin, then a uniform set of the surplus, about the root of the number of items, changes sides."""
    left, want = rng.binomial(counts, 0.5), int(counts.sum()) // 2
    surplus = int(left.sum()) - want
    side = left if surplus > 0 else counts - left
    moved = subset(rng, abs(surplus), int(side.sum()))
    change = np.bincount(np.searchsorted(np.cumsum(side), moved, side="right"), minlength=len(counts))
    return left - change if surplus > 0 else left + change


def leaf_quota(quota: np.ndarray, shards: int, shard: int, seed: int = SEED) -> np.ndarray:
    """Blocks of every source that a leaf of the splitting tree gets (``shards`` is a power of 2)."""
    low, high, counts = 0, shards, quota.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = half_of(rng, counts)
        counts, low, high = (left, low, middle) if shard < middle else (counts - left, middle, high)
    return counts


def assign_shards(blocks: DataFrame, seed: int = SEED) -> DataFrame:
    """(source_key, block) -> shard. Only the number of blocks per source reaches the driver."""
    spark = blocks.sparkSession
    quotas = blocks.groupBy("source_key").agg(F.count(F.lit(1)).alias("n")).orderBy("source_key").collect()
    names, quota = [r.source_key for r in quotas], np.array([r.n for r in quotas], dtype=np.int64)
    shards = 1 << max(0, (int(quota.sum()) - 1) // SHARD_BLOCKS).bit_length()

    def leaves(batches):
        for pdf in batches:
            yield pd.concat([pd.DataFrame({"shard": s, "source_key": names, "n": leaf_quota(quota, shards, s, seed)}) for s in pdf["id"]])

    tree = spark.range(shards).mapInPandas(leaves, "shard long, source_key int, n long").where("n > 0")
    run = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    taken = tree.withColumn("first", F.coalesce(F.sum("n").over(run), F.lit(0)))
    ranks = taken.select("source_key", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("rank"))
    permuted = hash_rank(blocks.withColumn("h", row_hash("source_key", "block", seed=seed)), "h", ["block"], ["source_key"])
    return permuted.join(ranks, ["source_key", "rank"]).select("source_key", "block", "shard")


def draws(narrow: DataFrame) -> DataFrame:
    """One row for each time a row of ``narrow`` (row_key, source, size) is taken, with its block and shard."""
    sources = cut_lineage(source_targets(narrow))
    placed = cut_lineage(drawn(positions(narrow.select("row_key", "source", "size"), sources)))
    return placed.join(assign_shards(cut_lineage(placed.select("source_key", "block").distinct())), ["source_key", "block"])


def mix(docs: DataFrame) -> DataFrame:
    """The drawn documents, one row for each time a document is taken, with ``ADDED``; ordered by
    (shard, hash) they are the shuffled shards. Who is drawn is settled without the texts, which are
    dealt out once to meet their draws."""
    rows = keyed(carried(docs.drop(*[c for c in ADDED if c not in ("doc_id", "source", "text")]), "doc_id", "source", "text"))
    narrow = cut_lineage(rows.select("row_key", "source", "size"))
    taken = cut_lineage(draws(narrow))
    times = [c for c in ADDED if c not in ("size", "source_key", "row_key")]
    by_row = taken.groupBy("source_key", "row_key").agg(F.collect_list(F.struct("twin", *times)).alias("times"))
    keys = sized(taken.select(F.col("source").alias("__source"), "source_key").distinct())
    d = rows.join(keys, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    d = d.withColumn("__twin", F.row_number().over(Window.partitionBy("source_key", "row_key").orderBy("size"))).join(by_row, ["source_key", "row_key"])
    d = d.withColumn("__time", F.explode(F.filter("times", lambda t: t["twin"] == F.col("__twin")))).select("*", *[F.col(f"__time.{c}").alias(c) for c in times])
    return restored(d, [*[c for c in docs.columns if c not in ADDED], *ADDED])


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix dealt out by shard, every shard in the order of a hash."""
    return mixed.repartition("shard").sortWithinPartitions("shard", row_hash("source_key", "position", "epoch", seed="order"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(keyed(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    taken = draws(rows).groupBy("source_key", "row_key", "twin").agg(F.sum("size").alias("taken"))
    sources = sized(source_targets(rows).select(F.col("source").alias("__source"), "source_key", "source_size", "target"))
    every = rows.join(sources, F.col("source").eqNullSafe(F.col("__source"))).withColumn(
        "twin", F.row_number().over(Window.partitionBy("source_key", "row_key").orderBy("size")))
    return every.join(taken, ["source_key", "row_key", "twin"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || '#17') AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
w AS (SELECT *, [5, 2, 1][CAST((k - 1) % 3 + 1 AS INT)] AS w, 2 * source_size AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM r),
c AS (SELECT *, cap * sum(w) OVER (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          <= (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS capped FROM w),
t AS (SELECT source, k, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
          (total - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE)) / CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS DOUBLE) * w END AS target FROM c),
p AS (SELECT d.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY t.k ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS p
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN 2 * p + size <= 2 * target THEN size ELSE 0 END
       + CASE WHEN 2 * (p + source_size) + size <= 2 * target THEN size ELSE 0 END AS BIGINT) AS taken FROM p
"""
