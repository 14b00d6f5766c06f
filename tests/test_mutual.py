"""Nearest-neighbour mutual information against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from autotab.operators import mutual as MU

GAMMA = 0.5772156649015329


def psi(n):
    return -GAMMA + sum(1 / i for i in range(1, int(n)))


def brute(x, y, k=3):
    keep = np.array([(y == c).sum() > 1 for c in y])
    x, y = x[keep], y[keep]
    total = psi(len(x))
    for i in range(len(x)):
        own = np.sort(np.abs(np.delete(x[y == y[i]], np.flatnonzero(np.flatnonzero(y == y[i]) == i)) - x[i]))
        kk = min(k, len(own))
        r = own[kk - 1]
        m = (np.abs(x - x[i]) < r).sum() if r > 0 else (x == x[i]).sum()
        total += (psi(kk) - psi(len(own) + 1) - psi(m)) / len(x)
    return max(0.0, total)


def test_equals_brute_force_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(MU, "RUN", 16)
    rng = np.random.default_rng(11)
    y = rng.integers(0, 3, 500)
    y[0] = 7  # a class of one row takes no part
    cols = {"informative": np.round((y + rng.normal(size=500)) * 256) / 256, "noise": np.round(rng.normal(size=500) * 1024) / 1024, "tied": rng.integers(0, 6, 500) + y * (rng.random(500) < 0.5),
            "constant": np.ones(500)}
    df = spark.createDataFrame([(int(c), *[float(v[i]) for v in cols.values()]) for i, c in enumerate(y)], "y int, " + ", ".join(f"{c} double" for c in cols))
    got = {r.feature: r.mi for r in MU.mutual_information_knn(df, list(cols), "y").collect()}
    assert all(abs(got[c] - brute(np.asarray(v, float), y)) < 1e-9 for c, v in cols.items()) and got["informative"] > 0.2 > got["noise"]


def test_nulls_few_rows_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("b", float("nan")), (None, 3.0), ("b", 5.0)], "y string, x double")
    assert MU.mutual_information_knn(df, ["x"], "y").first().mi == brute(np.array([1.0, 2.0]), np.array(["a", "a"]))
    assert MU.mutual_information_knn(df.where("false"), ["x"], "y").collect() == [("x", 0.0)]


def test_digamma(spark):
    for n, v in spark.range(1, 200).select("id", MU.digamma(F.col("id"))).collect():
        assert abs(v - psi(n)) < 1e-10 and math.isfinite(v)
