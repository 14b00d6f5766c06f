"""Hand-computed metric fixtures (FIXTURES.md §5)."""

import pytest
from pyspark.sql import functions as F

from autotab.operators import metrics as M


def frame(spark, rows, schema="y int, score double"):
    return spark.createDataFrame(rows, schema)


def test_ties_auc_and_average_precision(spark):
    df = frame(spark, [(1, .5), (0, .5), (1, .9), (0, .1)])
    assert M.roc_auc(df).first()["roc_auc"] == pytest.approx(0.875)
    assert M.average_precision(df).first()["avg_precision"] == pytest.approx(5 / 6)


def test_one_class_auc_is_null(spark):
    df = frame(spark, [(1, .2), (1, .4), (1, .9)])
    assert M.roc_auc(df).first()["roc_auc"] is None


def test_macro_f1_over_union_of_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b")], "y string, y_pred string")
    per = {r["label"]: r["f1"] for r in M.f1_per_label(df).collect()}
    assert per == pytest.approx({"a": 2 / 3, "b": 1.0, "c": 0.0})
    assert M.f1_macro(df).first()["f1_macro"] == pytest.approx(5 / 9)


def test_youden_inverted_returns_one(spark):
    df = frame(spark, [(1, .1), (0, .9)])
    assert M.best_threshold_youden(df).first()["threshold"] == 1.0


def test_best_f1_threshold_lowest_on_ties(spark):
    df = frame(spark, [(1, .8), (0, .2), (1, .9), (0, .1)])
    r = M.best_threshold_f1(df).first()
    assert r["f1"] == pytest.approx(1.0)
    assert r["threshold"] == pytest.approx(0.21)


def test_threshold_grid_index_matches_linspace(spark):
    import numpy as np
    grid = np.linspace(0, 1, 101)
    vals = [0.0, 0.57, 0.5700000000000001, 0.99, 1.0, 1.5, -0.2, 0.41]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = [r[0] for r in df.select(M.threshold_grid_index(F.col("s"))).collect()]
    want = [int(max([i for i, t in enumerate(grid) if t <= v], default=-1)) for v in vals]
    assert got == want


def test_regression_constant_target(spark):
    df = spark.createDataFrame([(5.0, 5.0), (5.0, 5.0)], "y double, pred double")
    assert M.regression_metrics(df).first()["r2"] == 1.0
    df2 = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0)], "y double, pred double")
    assert M.regression_metrics(df2).first()["r2"] == 0.0


def test_confusion_matrix_dense(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b")], "y string, y_pred string")
    cm = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[("a", "c")] == 1 and cm[("c", "a")] == 0


def test_prefix_sums_in_any_number_of_buckets(spark):
    from autotab.functions.ranking import prefix_sums
    rows = [(float(i % 997) / 997.0, i % 3) for i in range(5000)]
    g = spark.createDataFrame(rows, "s double, v long").groupBy("s").agg(F.sum("v").alias("v"))
    want, total = {}, 0
    for r in g.orderBy("s").collect():
        total += r["v"]
        want[r["s"]] = total
    for n in (1, 2, 16, None):
        assert {r["s"]: r["cum_v"] for r in prefix_sums(g, "s", ["v"], n_buckets=n).collect()} == want


def test_nan_scores_stay_out(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 0.9), (0, 0.1), (1, 0.8)], "y int, score double")
    assert M.roc_auc(df).first()["roc_auc"] == 1.0


def test_confusion_matrix_of_many_labels(spark):
    df = spark.range(1100).selectExpr("CAST(id AS STRING) AS y", "CAST((id + 1) % 1100 AS STRING) AS y_pred")
    r = M.confusion_matrix(df).agg(F.count("*").alias("cells"), F.sum("n").alias("n")).first()
    assert (r["cells"], r["n"]) == (1100 * 1100, 1100)
