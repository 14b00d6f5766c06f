"""Distributed ranks and prefix sums.

A window ``ORDER BY`` without ``PARTITION BY`` moves every row into one task.
These helpers split the order into range buckets, count per bucket (map-side
combined), turn the small per-bucket table into offsets, and finish with a
window partitioned by bucket, so no task sees more than one bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import HASH_BITS
from .lookup import null_safe_join


def hash_rank(df: DataFrame, hash_col: str, tie_cols: list[str], by: list[str] | None = None,
              out: str = "rank", size_col: str | None = None, bits: int = 16) -> DataFrame:
    """0-based rank of each row within ``by`` ordered by (hash_col, *tie_cols).

    ``hash_col`` must be a uniform non-negative 60-bit hash (``keys.row_hash``),
    so equal-width hash ranges give balanced buckets without sampling.
    Optionally adds ``size_col`` = number of rows in the ``by`` group.
    """
    by = list(by or [])
    shift = HASH_BITS - bits
    d = df.withColumn("__hbkt", F.shiftright(F.col(hash_col), shift))
    counts = d.groupBy(*by, "__hbkt").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*by).orderBy("__hbkt")
    offs = counts.withColumn("__off", F.sum("__cnt").over(w) - F.col("__cnt"))
    cols = [*by, "__hbkt", "__off"]
    if size_col:
        offs = offs.withColumn(size_col, F.sum("__cnt").over(Window.partitionBy(*by)))
        cols.append(size_col)
    if by:
        d = null_safe_join(d, offs.select(*cols), [*by, "__hbkt"], how="inner")
    else:  # at most 2**bits rows: a proven bound, broadcast without counting
        d = d.join(F.broadcast(offs.select(*cols)), "__hbkt")
    w2 = Window.partitionBy(*by, "__hbkt").orderBy(F.col(hash_col), *[F.col(c) for c in tie_cols])
    return (d.withColumn(out, (F.row_number().over(w2) - 1 + F.col("__off")).cast("bigint"))
             .drop("__hbkt", "__off"))


#: Grouped rows that one bucket of a prefix sum should hold.
BUCKET_ROWS = 100_000


def range_bounds(df: DataFrame, col: str, n_buckets: int | None = None, accuracy: int = 10_000) -> list[float]:
    """Approximate range-partition bounds of ``col``: as many buckets as the rows and the shuffle
    partitions ask for, at most ``accuracy``."""
    n = n_buckets or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // BUCKET_ROWS)
    n = min(n, accuracy)
    if n <= 1:
        return []
    b = df.agg(F.percentile_approx(F.col(col).cast("double"), [i / n for i in range(1, n)], accuracy)).first()[0]
    return sorted({float(v) for v in b or [] if v is not None})


def prefix_sums(g: DataFrame, order_col: str, value_cols: list[str], by: list[str] | None = None,
                descending: bool = False, n_buckets: int | None = None, inclusive: bool = True,
                prefix: str = "cum_") -> DataFrame:
    """Running sums of ``value_cols`` within ``by`` in the order of ``order_col``.

    ``g`` should already hold one row per (by, order value) — callers aggregate
    first so ties share one row. Adds ``cum_<v>`` (inclusive of the current row
    unless ``inclusive=False``).
    """
    by = list(by or [])
    okey = (-F.col(order_col).cast("double")) if descending else F.col(order_col).cast("double")
    # the grouped rows are written once to the shared checkpoint folder, so the bounds, the
    # totals, the offsets and the bucket windows below read them instead of recomputing them
    from ..session import cut_lineage
    d = cut_lineage(g.withColumn("__ok", okey))
    bounds = range_bounds(d, "__ok", n_buckets)
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        d = Bucketizer(splits=splits, inputCol="__ok", outputCol="__bk", handleInvalid="keep").transform(d)
    else:
        d = d.withColumn("__bk", F.lit(0.0))
    tot = d.groupBy(*by, "__bk").agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols])
    wb = Window.partitionBy(*by).orderBy("__bk")
    offs = tot.select(*by, "__bk", *[(F.sum(f"__t_{v}").over(wb) - F.col(f"__t_{v}")).alias(f"__o_{v}")
                                     for v in value_cols])
    d = null_safe_join(d, offs, [*by, "__bk"], how="inner")
    frame_end = Window.currentRow if inclusive else -1
    wr = (Window.partitionBy(*by, "__bk").orderBy("__ok")
          .rowsBetween(Window.unboundedPreceding, frame_end))
    for v in value_cols:
        d = d.withColumn(f"{prefix}{v}", F.coalesce(F.sum(v).over(wr), F.lit(0)) + F.col(f"__o_{v}"))
    return d.drop("__ok", "__bk", *[f"__o_{v}" for v in value_cols])


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list, n: int,
                    spread_col: str | None = None, buckets: int = 256, out: str = "rank") -> DataFrame:
    """Exact top-n rows per group without ranking a whole group in one task.

    Stage 1 ranks inside (group, hash bucket of ``spread_col``) and keeps n per
    bucket; stage 2 ranks the at most n·buckets survivors per group.
    ``order_cols`` are Column sort expressions (e.g. ``F.col('c').desc()``).
    """
    d = df
    if spread_col is not None and buckets > 1:
        d = d.withColumn("__sb", F.pmod(F.xxhash64(F.col(spread_col)), F.lit(buckets)))
        w1 = Window.partitionBy(*group_cols, "__sb").orderBy(*order_cols)
        d = d.withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= n).drop("__r1", "__sb")
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return d.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= n)


#: Rows that a range partition of ``range_rank`` should hold.
RANGE_ROWS = 50_000


def range_rank(df: DataFrame, by: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """0-based rank of each row within ``by`` in the order of ``order`` (any sortable columns, together with ``by`` unique), from
    range partitions and their counts: no task orders more than its range, however large a group is."""
    from ..session import cut_lineage
    keys = [*by, *order]
    parts = max(1, -(-df.count() // RANGE_ROWS))
    ranged = cut_lineage(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(*by, "__part").orderBy(*order)
    d = null_safe_join(ranged.withColumn(out, F.row_number().over(inside) - 1), firsts, [*by, "__part"], how="inner")
    return d.withColumn(out, (F.col(out) + F.col("__first")).cast("bigint")).drop("__part", "__first")
