"""Evaluation metrics as aggregates over a scored table.

Binary metrics group the scored table by distinct score first (map-side
combined), then run cumulative sums over the grouped rows with range-bucketed
windows (``functions.ranking.prefix_sums``), so ties are handled exactly and no
single task holds the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.ranking import prefix_sums
from ..session import cut_lineage

# Fixed value: probability clipping used by the reference's log loss (float64 machine epsilon).
LOG_LOSS_EPS = 2.220446049250313e-16


def _ddiv(a, b):
    """a / b as double, NULL when b is 0."""
    return F.when(b.cast("double") == 0, F.lit(None).cast("double")).otherwise(
        a.cast("double") / b.cast("double"))


def score_groups(df: DataFrame, label: str = "y", score: str = "score", by=None) -> DataFrame:
    """(by..., s, p, n): positives / negatives per distinct score."""
    by = list(by or [])
    yv = F.col(label).cast("long")
    return (df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
              .groupBy(*by, F.col(score).cast("double").alias("s"))
              .agg(F.sum(yv).alias("p"), F.sum(1 - yv).alias("n")))


def roc_auc(df: DataFrame, label: str = "y", score: str = "score", by=None) -> DataFrame:
    """ROC-AUC with half credit for ties: Σ_s p_s·(neg below s + ½·n_s) / (P·N)."""
    by = list(by or [])
    g = prefix_sums(score_groups(df, label, score, by), "s", ["n"], by=by, inclusive=False)
    num = F.sum(F.col("p") * (F.col("cum_n") + F.lit(0.5) * F.col("n")))
    den = F.sum("p").cast("double") * F.sum("n").cast("double")
    return g.groupBy(*by).agg(_ddiv(num, den).alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "y", score: str = "score", by=None) -> DataFrame:
    """Step-wise average precision: Σ over distinct scores (descending) of (ΔTP/P)·precision."""
    by = list(by or [])
    g = prefix_sums(score_groups(df, label, score, by), "s", ["p", "n"], by=by, descending=True)
    prec = F.col("cum_p") / (F.col("cum_p") + F.col("cum_n"))
    return g.groupBy(*by).agg(_ddiv(F.sum(F.col("p") * prec), F.sum("p")).alias("avg_precision"))


def _clip(c):
    return F.least(F.greatest(c.cast("double"), F.lit(LOG_LOSS_EPS)), F.lit(1 - LOG_LOSS_EPS))


def log_loss_binary(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    p_true = F.when(F.col(label) == 1, F.col(score)).otherwise(1 - F.col(score))
    return df.agg(F.avg(-F.log(_clip(p_true))).alias("log_loss"))


def log_loss_multi(df: DataFrame, label: str = "y", proba: str = "proba") -> DataFrame:
    """Mean −ln(clip(p[y])) with y a 0-based class index into the ``proba`` array."""
    p_true = F.element_at(F.col(proba), F.col(label).cast("int") + 1)
    return df.agg(F.avg(-F.log(_clip(p_true))).alias("log_loss"))


def brier(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def accuracy(df: DataFrame, y_true: str = "y", y_pred: str = "y_pred") -> DataFrame:
    return df.agg(F.avg((F.col(y_true) == F.col(y_pred)).cast("double")).alias("accuracy"))


def per_label_counts(df: DataFrame, y_true: str = "y", y_pred: str = "y_pred", by=None) -> DataFrame:
    """(by..., label, tp, n_true, n_pred) over labels in y_true ∪ y_pred."""
    by = list(by or [])
    t, p = F.col(y_true).cast("string"), F.col(y_pred).cast("string")
    hit = (t == p).cast("long")
    ev = F.explode(F.array(
        F.struct(t.alias("label"), hit.alias("tp"), F.lit(1).cast("long").alias("nt"),
                 F.lit(0).cast("long").alias("np")),
        F.struct(p.alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("nt"),
                 F.lit(1).cast("long").alias("np"))))
    return (df.select(*by, ev.alias("e")).select(*by, "e.*")
              .groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("nt").alias("n_true"),
                                         F.sum("np").alias("n_pred")))


def f1_per_label(df: DataFrame, y_true: str = "y", y_pred: str = "y_pred", by=None) -> DataFrame:
    by = list(by or [])
    c = per_label_counts(df, y_true, y_pred, by)
    den = F.col("n_true") + F.col("n_pred")
    return c.select(*by, "label", F.when(den == 0, 0.0).otherwise(2 * F.col("tp") / den).alias("f1"))


def f1_macro(df: DataFrame, y_true: str = "y", y_pred: str = "y_pred", by=None) -> DataFrame:
    """Unweighted mean of per-label F1 over labels seen in y_true or y_pred (0/0 → 0)."""
    by = list(by or [])
    return f1_per_label(df, y_true, y_pred, by).groupBy(*by).agg(F.avg("f1").alias("f1_macro"))


def confusion_matrix(df: DataFrame, y_true: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """Dense confusion matrix in long form (y_true, y_pred, n) over all labels, zeros included: every label
    is paired with the array of labels, then the counted cells are joined in."""
    cells = cut_lineage(df.groupBy(F.col(y_true).cast("string").alias("y_true"), F.col(y_pred).cast("string").alias("y_pred")).agg(F.count(F.lit(1)).alias("n")))
    seen = cells.select(F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()
    whole = Window.partitionBy(F.lit(0))
    grid = seen.withColumn("row", F.collect_list(F.struct("label")).over(whole)).select(F.col("label").alias("t"), F.explode("row.label").alias("p"))
    return grid.join(cells, F.col("t").eqNullSafe(F.col("y_true")) & F.col("p").eqNullSafe(F.col("y_pred")), "left").select(
        F.col("t").alias("y_true"), F.col("p").alias("y_pred"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _totals(groups: DataFrame) -> tuple[int, int]:
    """(P, N) of a score_groups table as driver scalars."""
    r = groups.agg(F.sum("p").alias("P"), F.sum("n").alias("N")).first()
    return int(r["P"] or 0), int(r["N"] or 0)


def roc_curve(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """One ROC point per distinct score (descending): threshold, fpr, tpr."""
    groups = score_groups(df, label, score)
    P, N = _totals(groups)
    g = prefix_sums(groups, "s", ["p", "n"], descending=True)
    return g.select(F.col("s").alias("threshold"), _ddiv(F.col("cum_n"), F.lit(N)).alias("fpr"),
                    _ddiv(F.col("cum_p"), F.lit(P)).alias("tpr"))


def pr_curve(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """One precision-recall point per distinct score: threshold, precision, recall."""
    groups = score_groups(df, label, score)
    P, _ = _totals(groups)
    g = prefix_sums(groups, "s", ["p", "n"], descending=True)
    return g.select(F.col("s").alias("threshold"),
                    (F.col("cum_p") / (F.col("cum_p") + F.col("cum_n"))).alias("precision"),
                    _ddiv(F.col("cum_p"), F.lit(P)).alias("recall"))


def threshold_grid_index(score_col, n: int = 101):
    """Largest grid index i with i/(n-1) (computed as i*step in double) <= score; -1 if none."""
    step = 1.0 / (n - 1)
    s = score_col.cast("double")
    i0 = F.floor(s * (n - 1)).cast("long")
    i = (F.when((i0 + 1).cast("double") * step <= s, i0 + 1)
          .when(i0.cast("double") * step > s, i0 - 1).otherwise(i0))
    return F.when(s.isNull(), F.lit(None)).otherwise(F.least(F.greatest(i, F.lit(-1)), F.lit(n - 1)))


def f1_by_threshold(df: DataFrame, label: str = "y", score: str = "score", n: int = 101) -> DataFrame:
    """F1 of predicting ``score >= t`` for t on the grid linspace(0, 1, n): (i, threshold, f1)."""
    spark = df.sparkSession
    step = 1.0 / (n - 1)
    b = (df.where(F.col(score).isNotNull())
           .groupBy(threshold_grid_index(F.col(score), n).alias("i"))
           .agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("c")))
    grid = spark.range(-1, n).select(F.col("id").alias("i"))
    t = grid.join(F.broadcast(b), "i", "left").fillna(0, ["p", "c"])
    w = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = (t.withColumn("tp", F.sum("p").over(w)).withColumn("pp", F.sum("c").over(w))
          .withColumn("P", F.sum("p").over(Window.partitionBy())))
    thr = F.when(F.col("i") == n - 1, F.lit(1.0)).otherwise(F.col("i").cast("double") * F.lit(step))
    den = F.col("pp") + F.col("P")
    return (t.where(F.col("i") >= 0)
             .select("i", thr.alias("threshold"),
                     F.when(den == 0, 0.0).otherwise(2.0 * F.col("tp") / den).alias("f1")))


def with_positive_score(df: DataFrame, label: str = "y", proba: str = "proba", out: str = "score") -> DataFrame:
    """The one of two probability columns (array ``proba``) that correlates better with the 0/1 label, as ``out``; the second one
    in case of doubt (equal, or a column that does not vary)."""
    p = [F.element_at(proba, i + 1) for i in range(2)]
    known = F.col(label).isNotNull()
    y = F.col(label).cast("double")
    corr = [F.try_divide(F.covar_pop(c, y), F.stddev_pop(c) * F.stddev_pop(y)) for c in p]
    r = df.where(known).agg(*[F.coalesce(c, F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(corr)]).first()
    return df.withColumn(out, p[1] if r["c1"] >= r["c0"] else p[0])


def best_threshold_f1(df: DataFrame, label: str = "y", score: str = "score", n: int = 101) -> DataFrame:
    """Grid threshold with the best F1; the lowest threshold wins ties."""
    f = f1_by_threshold(df, label, score, n)
    m = f.agg(F.max(F.struct(F.col("f1"), (-F.col("i")).alias("ni"), F.col("threshold"))).alias("m"))
    return m.select(F.col("m.threshold").alias("threshold"), F.col("m.f1").alias("f1"))


def best_threshold_youden(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """argmax(tpr − fpr) over distinct scores, highest threshold on ties; J <= 0 → 1.0; clipped to [0,1]."""
    r = roc_curve(df, label, score).withColumn("j", F.col("tpr") - F.col("fpr"))
    m = r.agg(F.max(F.struct("j", "threshold")).alias("m"))
    t = (F.when(F.col("m.j").isNull(), F.lit(None).cast("double"))
          .when(F.col("m.j") <= 0, F.lit(1.0))
          .otherwise(F.least(F.greatest(F.col("m.threshold"), F.lit(0.0)), F.lit(1.0))))
    return m.select(t.alias("threshold"))


def best_threshold_pr(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Threshold maximising 2pr/(p+r+1e-12) on the PR points (lowest threshold on ties)."""
    r = pr_curve(df, label, score)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-12))
    m = r.withColumn("f1", f1).agg(F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("nt"),
                                                  F.col("threshold"))).alias("m"))
    return m.select(F.col("m.threshold").alias("threshold"), F.col("m.f1").alias("f1"))


def apply_threshold(df: DataFrame, threshold: float, score: str = "score", out: str = "y_pred") -> DataFrame:
    """Binary decision: clip(score, 0, 1) >= threshold → 1 else 0."""
    s = F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0))
    return df.withColumn(out, (s >= F.lit(float(threshold))).cast("int"))


def calibration_curve(df: DataFrame, label: str = "y", score: str = "score", n_bins: int = 10) -> DataFrame:
    """Quantile-binned reliability table (bin, n, frac_pos, mean_pred); empty bins dropped.

    Edges are exact linear-interpolated quantiles; a value's bin is the number of
    inner edges strictly below it."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    edges = exact_quantiles(df, score, probs)
    inner = [e for e in edges[1:-1] if e is not None]
    s = F.col(score).cast("double")
    b = sum((F.when(s > F.lit(e), 1).otherwise(0) for e in inner), F.lit(0)) if inner else F.lit(0)
    return (df.where(F.col(score).isNotNull())
              .groupBy(b.cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("frac_pos"),
                   F.avg(s).alias("mean_pred")))


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """rmse, mae, r2 (zero total variance: r2 = 1 if residuals are all 0, else 0)."""
    e = F.col(y).cast("double") - F.col(pred).cast("double")
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"),
               F.var_pop(F.col(y).cast("double")).alias("vy"))
    sst = F.col("vy") * F.col("n")
    r2 = (F.when(F.col("n") == 0, F.lit(None).cast("double"))
           .when(sst == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0))
           .otherwise(1 - F.col("sse") / sst))
    return a.select(F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), F.col("mae"), r2.alias("r2"))


def residual_histogram(df: DataFrame, y: str = "y", pred: str = "pred", bins: int = 30) -> DataFrame:
    """Histogram of y − pred over [min, max] in ``bins`` equal bins (last bin closed)."""
    spark = df.sparkSession
    r = df.select((F.col(y).cast("double") - F.col(pred).cast("double")).alias("r")).where(F.col("r").isNotNull())
    st = r.agg(F.min("r").alias("mn"), F.max("r").alias("mx")).first()
    if st["mn"] is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    lo, hi = float(st["mn"]), float(st["mx"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    b = F.least(F.floor((F.col("r") - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)), F.lit(bins - 1)).cast("int")
    counts = r.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = (hi - lo) / bins
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")
                .select("bin", (F.lit(lo) + F.col("bin") * F.lit(w)).alias("bin_lo"),
                        (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("bin_hi"),
                        F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def one_vs_rest(df: DataFrame, label: str = "y", proba: str = "proba") -> DataFrame:
    """Explode class probabilities into (cls, y_bin, score) rows."""
    return (df.select(F.col(label).alias("__y"), F.posexplode(proba).alias("cls", "score"))
              .select(F.col("cls").cast("int").alias("cls"), (F.col("__y") == F.col("cls")).cast("int").alias("y_bin"),
                      "score"))


def roc_auc_ovr(df: DataFrame, label: str = "y", proba: str = "proba") -> DataFrame:
    """Macro one-vs-rest ROC-AUC for a class-index label and a probability array."""
    per = roc_auc(one_vs_rest(df, label, proba), "y_bin", "score", by=["cls"])
    return per.agg(F.avg("roc_auc").alias("roc_auc_ovr"))


def avg_precision_ovr(df: DataFrame, label: str = "y", proba: str = "proba") -> DataFrame:
    per = average_precision(one_vs_rest(df, label, proba), "y_bin", "score", by=["cls"])
    return per.agg(F.avg("avg_precision").alias("avg_precision"))


def pos_weight(df: DataFrame, label: str = "y") -> DataFrame:
    """max(1, negatives / positives); positive = label 1 when present, else the minority class."""
    c = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("v")).agg(
        F.count(F.lit(1)).alias("c"))
    a = c.agg(F.sum("c").alias("n"),
              F.sum(F.when(F.col("v").isin("1", "true"), F.col("c"))).alias("c1"),
              F.min(F.struct("c", "v")).alias("minor"))
    pos = F.coalesce(F.col("c1"), F.col("minor.c"))
    return a.select(F.greatest(F.lit(1.0), (F.col("n") - pos) / pos).alias("pos_weight"))


def binary_summary(df: DataFrame, label: str = "y", score: str = "score", y_pred: str | None = None) -> dict:
    """Metrics dict for a binary scored table (used by search, holdout and reports)."""
    out = {}
    out["roc_auc"] = roc_auc(df, label, score).first()["roc_auc"]
    out["avg_precision"] = average_precision(df, label, score).first()["avg_precision"]
    out["log_loss"] = log_loss_binary(df, label, score).first()["log_loss"]
    if y_pred:
        out["accuracy"] = accuracy(df, label, y_pred).first()["accuracy"]
        out["f1_macro"] = f1_macro(df, label, y_pred).first()["f1_macro"]
    return out


# Metric names where larger is better; regression errors are negated.
def metric_by(df: DataFrame, metric: str, by: list[str], task: str) -> DataFrame:
    """(by..., value) of a named metric over a scored table (y, y_pred[, proba, score])."""
    if metric == "roc_auc" and task == "classification":
        return roc_auc(df, "y", "score", by).withColumnRenamed("roc_auc", "value")
    if metric in ("roc_auc_ovr",):
        per = roc_auc(df.select(*by, "y", F.posexplode("proba").alias("cls", "p"))
                        .select(*by, "cls", (F.col("y") == F.col("cls")).cast("int").alias("yb"), "p"),
                      "yb", "p", [*by, "cls"])
        return per.groupBy(*by).agg(F.avg("roc_auc").alias("value"))
    if metric == "f1_macro":
        return f1_macro(df, "y", "y_pred", by).withColumnRenamed("f1_macro", "value")
    if metric == "accuracy":
        return df.groupBy(*by).agg(F.avg((F.col("y") == F.col("y_pred")).cast("double")).alias("value"))
    e = F.col("y").cast("double") - F.col("y_pred").cast("double")
    if metric in ("neg_root_mean_squared_error", "rmse"):
        return df.groupBy(*by).agg((-F.sqrt(F.avg(e * e))).alias("value"))
    if metric in ("neg_mean_absolute_error", "mae"):
        return df.groupBy(*by).agg((-F.avg(F.abs(e))).alias("value"))
    if metric == "r2":
        return df.groupBy(*by).agg((1 - F.sum(e * e) / (F.var_pop(F.col("y")) * F.count(F.lit(1)))).alias("value"))
    raise ValueError(f"unknown metric {metric}")
