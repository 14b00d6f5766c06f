"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import release


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for every node of ``edges`` (a, b).

    Alternates large-star and small-star rounds until nothing changes; a round aggregates the
    minimum of each neighbourhood (merged before the shuffle) and joins it back, so no
    neighbourhood is ever collected. Every round is checkpointed."""
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        star = (large.join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                .unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        e = cut_lineage(star)
        del both, low, large, star
        release(e.sparkSession)  # else every round's shuffle files and checkpoint stay until the end
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    # every node now hangs directly from its component's smallest
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
