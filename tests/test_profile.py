"""Profiling helpers: dates, correlations, leak columns, type counts, probability choice, importance limit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from autotab.operators import metrics as M
from autotab.operators import profile as P


def test_date_grammars(spark):
    cols = {"iso": "2024-02-29 10:11:12", "day_first": "29/02/2024", "month_first": "02/29/2024 23:59", "month_name": "29 Feb 2024", "long_name": "February 29, 2024", "dots": "29.02.2024",
            "slashes": "2024/2/29", "dashes": "29-Feb-2024", "packed": "20240229", "epoch": "1709164800", "millis": "1709164800000", "not_a_day": "31/02/2024", "number": "123456", "text": "may"}
    df = spark.createDataFrame([tuple(cols.values())] * 9 + [("x",) * len(cols)], ", ".join(f"{c} string" for c in cols))
    got = {r["column"]: (r["format"], r["parsed_frac"]) for r in P.date_formats(df).collect()}
    want = {"iso": "iso", "day_first": "d/m/y", "month_first": "m/d/y", "month_name": "d mon y", "long_name": "month d, y", "dots": "d.m.y", "slashes": "y/m/d", "dashes": "d mon y", "packed": "ymd",
            "epoch": "epoch s", "millis": "epoch ms"}
    assert {c: got[c][0] for c in want} == want and all(abs(got[c][1] - 0.9) < 1e-9 for c in want)
    dates = {r["column"] for r in P.date_columns(df).where("is_date = 1").collect()}
    assert dates == set(want)


def brute_corr(x):
    d = x.shape[1]
    out = np.full((d, d), np.nan)
    for i in range(d):
        for j in range(d):
            ok = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            if ok.sum() > 1 and x[ok, i].std() > 0 and x[ok, j].std() > 0:
                out[i, j] = np.corrcoef(x[ok, i], x[ok, j])[0, 1]
    np.fill_diagonal(out, 1.0)
    return out


@pytest.mark.parametrize("block", [128, 3])
def test_correlations_of_blocks_with_nulls(spark, monkeypatch, block):
    monkeypatch.setattr(P, "CORR_BLOCK", block)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8)) + 1e6
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=60) * 0.1
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 6] = 5.0
    names = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in names)).repartition(3)
    got = {(r.col_a, r.col_b): r["corr"] for r in P.correlation_matrix(df, names).collect()}
    want = brute_corr(x)
    assert len(got) == 64
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert (got[a, b] is None) == bool(np.isnan(want[i, j])) and (got[a, b] is None or abs(got[a, b] - want[i, j]) < 1e-6)


def test_the_plan_of_many_columns_stays_small(spark):
    df = spark.range(40).select(*[(F.col("id") * F.lit(i % 7 + 1) % 11).cast("double").alias(f"c{i}") for i in range(400)])
    got = P.correlation_matrix(df)
    assert got.count() == 160_000 and got.where("col_a = 'c0' AND col_b = 'c7'").first()["corr"] == pytest.approx(1.0)


def test_dtype_counts_and_leak_columns(spark):
    from autotab.operators import train as TR
    from autotab.plans.options import changed
    df = spark.createDataFrame([(1, "a", 2.0, 0), (2, "b", 3.0, 1)], "k long, Name string, x double, y int")
    assert P.dtype_counts(df) == {"bigint": 1, "string": 1, "double": 1, "int": 1}
    o = changed(TR.RunOptions(), data__target="y", data__key=["k"], data__drop_id_like=False, data__leak_columns=["Name", "Ticket"])
    assert TR.prepare_training_frame(df, o)[1] == ["x"]


def test_the_probability_that_follows_the_label(spark):
    for flip in (False, True):
        rows = [(i % 2, [1 - (0.2 + 0.6 * (i % 2)), 0.2 + 0.6 * (i % 2)][::-1 if flip else 1]) for i in range(10)] + [(None, [0.5, 0.5])]
        df = spark.createDataFrame(rows, "y int, proba array<double>")
        got = M.with_positive_score(df).where("y is not null").select("y", "score").collect()
        assert all(abs(s - (0.2 + 0.6 * y)) < 1e-9 for y, s in got)
    flat = spark.createDataFrame([(0, [0.3, 0.7]), (1, [0.3, 0.7])], "y int, proba array<double>")
    assert [r.score for r in M.with_positive_score(flat).collect()] == [0.7, 0.7]


def test_importances_are_cut_at_the_top(spark):
    from autotab.operators import explain as EX
    df = spark.range(30).selectExpr("id AS k", "CAST(id AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) AS b", "CAST(id AS DOUBLE) AS y")
    out = EX.permutation_importance(lambda d: d.select("y", (F.col("a") + F.col("b") * 0).alias("y_pred")), df, ["a", "b"], ["k"], "rmse", "regression", repeats=1, top=1)
    assert [r.feature for r in out.collect()] == ["a"]
