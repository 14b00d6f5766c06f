"""Mutual information of numeric features with classes by nearest neighbours, feature by feature.

For a row with value x and a class of n rows, r is the distance to its k-th nearest row of the class (k = 3, or n - 1) and m the
number of rows of any class nearer than r, itself included (the rows of equal value where r is 0). Then
MI = psi(N) + mean psi(k) - mean psi(n) - mean psi(m), at least 0. Classes of one row take no part. No noise is added.

Equal values of a class are one weighted cell. Cells get their place within feature and class from bucketed prefix sums and are cut into
runs of ``RUN`` cells; each run also holds the k cells on both sides of it, so a window inside a run sees every neighbour
and no feature or class is ordered in one task. The m are differences of two running counts, read where a cell's
reach begins and ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import named
from ..functions.lookup import null_safe_join
from ..functions.ranking import prefix_sums
from ..session import cut_lineage

NEIGHBOURS, RUN = 3, 4096


def digamma(n: Column) -> Column:
    """psi of a positive number: six steps of the recurrence, then the asymptotic series."""
    z = n.cast("double") + 6
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * F.pow(z, 4)) - 1 / (252 * F.pow(z, 6)) + 1 / (240 * F.pow(z, 8))
    return series - sum((1 / (n.cast("double") + i) for i in range(6)), F.lit(0.0))


def mutual_information_knn(df: DataFrame, features: list[str], target: str, k: int = NEIGHBOURS) -> DataFrame:
    """(feature, mi); rows without the value (NULL or NaN) or the class count in no feature."""
    long = (df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), named(c).cast("double").alias("x")) for c in features])).alias("e"))
        .select("e.feature", "y", (F.col("e.x") + F.lit(0.0)).alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")))
    cells = long.groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    classes = cells.groupBy("feature", "y").agg(F.sum("n").alias("nc")).where("nc > 1")
    cells = null_safe_join(cells, classes, ["feature", "y"], how="inner")
    placed = prefix_sums(cells.withColumn("one", F.lit(1)), "x", ["one"], by=["feature", "y"])

    # runs with the k cells before and behind them
    at, run = F.col("cum_one") - 1, F.floor((F.col("cum_one") - 1) / RUN)
    beside = F.array(run, F.floor((at - k) / RUN), F.floor((at + k) / RUN))
    spread = placed.withColumn("own", run).withColumn("run", F.explode(F.array_distinct(beside)))
    w = Window.partitionBy("feature", "y", "run").orderBy("x")
    x, need = F.col("x"), F.least(F.lit(k), F.col("nc") - 1)
    sides = [F.struct(F.abs(f("x", i).over(w) - x).alias("r"), f("x", i).over(w).alias("v"), f("n", i).over(w).alias("c")) for i in range(1, k + 1) for f in (F.lag, F.lead)]
    near = F.array_sort(F.filter(F.array(F.struct(F.lit(0.0).alias("r"), x.alias("v"), (F.col("n") - 1).alias("c")), *sides), lambda s: s["c"].isNotNull()))
    d = spread.withColumn("near", near).where("run = own").withColumn("k", need)
    start = F.struct(F.lit(0).cast("long").alias("got"), F.lit(0.0).alias("r"), x.alias("v"))
    kth = F.aggregate("near", start, lambda a, s: F.when(a["got"] >= F.col("k"), a).otherwise(F.struct((a["got"] + s["c"]).alias("got"), s["r"].alias("r"), s["v"].alias("v"))))
    d = d.withColumn("kth", kth).select("feature", "x", "n", "nc", "k", F.col("kth.r").alias("r"), F.col("kth.v").alias("v"))
    # the neighbour's own value ends the reach on its side, so that rounding cannot let it in
    low, high = F.when(F.col("v") < x, F.col("v")).otherwise(x - F.col("r")), F.when(F.col("v") > x, F.col("v")).otherwise(x + F.col("r"))
    d = cut_lineage(d.withColumn("low", low).withColumn("high", high))

    ends = d.select("feature", F.explode(F.array("low", "high")).alias("x"), F.lit(0).cast("long").alias("n"))
    values = d.select("feature", "x", "n").unionByName(ends).groupBy("feature", "x").agg(F.sum("n").alias("t"))
    counts = cut_lineage(prefix_sums(values, "x", ["t"], by=["feature"]).select("feature", "x", "t", "cum_t"))
    d = null_safe_join(d, counts.select("feature", F.col("x").alias("low"), F.col("cum_t").alias("below")), ["feature", "low"], how="inner")
    d = null_safe_join(d, counts.select("feature", F.col("x").alias("high"), (F.col("cum_t") - F.col("t")).alias("before")), ["feature", "high"], how="inner")
    d = null_safe_join(d, counts.select("feature", "x", "t"), ["feature", "x"], how="inner")
    m = F.when(F.col("r") > 0, F.col("before") - F.col("below")).otherwise(F.col("t"))
    weighted = [(F.sum(F.col("n") * digamma(c)) / F.sum("n")) for c in (F.col("k"), F.col("nc"), m)]
    mi = d.groupBy("feature").agg(F.greatest(F.lit(0.0), digamma(F.sum("n")) + weighted[0] - weighted[1] - weighted[2]).alias("mi"))
    every = df.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    return every.join(mi, "feature", "left").select("feature", F.coalesce("mi", F.lit(0.0)).alias("mi"))
