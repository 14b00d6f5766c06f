"""Feature-transform fixtures (FIXTURES.md §5) and properties."""

import pytest
from pyspark.sql import functions as F

from autotab.functions import cleaning as C
from autotab.functions.quantiles import exact_median, exact_quantiles, modes
from autotab.operators import features as FT
from autotab.operators import profile as P


def test_blank_cells(spark):
    df = spark.createDataFrame([("",), ("  ",), ("NA",), ("0",), (None,), ("　",)], "v string")
    got = [r[0] for r in df.select(C.blank_to_null(F.col("v"))).collect()]
    assert got == [None, None, "NA", "0", None, None]
    got2 = [r[0] for r in df.select(C.token_to_null(C.blank_to_null(F.col("v")))).collect()]
    assert got2 == [None, None, None, "0", None, None]


def test_median_even_and_mode_tie(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    assert exact_median(df, "x") == 2.5
    m = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "c string")
    assert modes(m, ["c"])["c"] == "a"


def test_exact_quantiles_histogram_path(spark):
    import numpy as np
    vals = [float((i * 7919) % 10007) / 3.0 for i in range(30000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, "x", [0.1, 0.5, 0.9], max_collect=100, bins=16)
    assert got == pytest.approx(list(np.percentile(vals, [10, 50, 90])))


def test_unseen_category(spark):
    tr = spark.createDataFrame([("a",), ("b",)], "c string")
    sc = spark.createDataFrame([("c",)], "c string")
    oe = FT.OrdinalEncode(cols=["c"]).fit(tr)
    assert oe.transform(sc).first()["c"] == -1.0
    oh = FT.OneHot(cols=["c"]).fit(tr)
    r = oh.transform(sc).first()
    assert r["c=a"] == 0.0 and r["c=b"] == 0.0
    fe = FT.FrequencyEncoder(threshold=1, cols=["c"]).fit(tr)
    assert fe.transform(sc).first()["c"] == 0.0


def test_freq_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "c string")
    m = FT.FrequencyEncoder(threshold=2, cols=["c"]).fit(df)
    got = sorted((r[0] for r in m.transform(df).select("c").collect()))
    assert got == [0.25, 0.25, 0.5, 0.5]


def test_scale_population_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, k double")
    out = FT.StandardScalerPop(cols=["x", "k"]).fit(df).transform(df).orderBy("x").collect()
    assert [r["x"] for r in out] == pytest.approx([-1.2247449, 0.0, 1.2247449])
    assert [r["k"] for r in out] == [0.0, 0.0, 0.0]
    vf = FT.VarianceFilter(cols=["x", "k"], threshold=0.0).fit(df)
    assert vf.state["drop"] == ["k"]
    sk = {r["column"]: r["skew"] for r in P.skewness(df, ["x", "k"]).collect()}
    assert sk["k"] == 0.0


def test_sparse_boundary(spark):
    rows = [(None if i < 95 else 1.0, None if i < 96 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double")
    dropped = {r["column"]: r["dropped"] for r in P.sparse_columns(df, None, 0.95).collect()}
    assert dropped == {"a": 0, "b": 1}


def test_weights_binary(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    w = {r["y"]: r["weight"] for r in P.balanced_weights(df, "y").collect()}
    assert w[0] == pytest.approx(2 / 3) and w[1] == pytest.approx(2.0)
    from autotab.operators import metrics as M
    assert M.pos_weight(df).first()["pos_weight"] == pytest.approx(3.0)


def test_one_class_imbalance(spark):
    df = spark.createDataFrame([(1,), (1,), (1,)], "y int")
    r = P.class_imbalance(df, "y").first()
    assert r["ratio"] == 1.0


def test_yeo_johnson_expression_matches_definition(spark):
    import math
    df = spark.createDataFrame([(x,) for x in [-2.0, -0.5, 0.0, 0.5, 3.0]], "x double")
    for lam in [0.0, 0.5, 2.0, -1.0]:
        got = [r[0] for r in df.select(FT.yeo_johnson_expr(F.col("x"), lam)).collect()]
        want = []
        for x in [-2.0, -0.5, 0.0, 0.5, 3.0]:
            if x >= 0:
                want.append(math.log1p(x) if lam == 0 else ((x + 1) ** lam - 1) / lam)
            else:
                want.append(-math.log1p(-x) if lam == 2 else -(((1 - x) ** (2 - lam)) - 1) / (2 - lam))
        assert got == pytest.approx(want)


def test_auto_k():
    assert FT.auto_k(5) == 10 and FT.auto_k(100) == 60 and FT.auto_k(1000) == 80
    assert FT.clamp_k(10, 5) == 4


def test_svd_matches_numpy(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors
    from autotab.operators.svd import TruncatedSVD
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)) + np.array([1.0, 0.0, 2.0, 0.0, 0.5])
    df = spark.createDataFrame([(i, Vectors.dense(r.tolist())) for i, r in enumerate(x)], ["i", "features"])
    m = TruncatedSVD(k=3).fit(df)
    s = np.linalg.svd(x, compute_uv=False)[:3]
    assert m.state["singular_values"] == pytest.approx(list(s), rel=1e-6)
    out = np.array([r["svd"].toArray() for r in m.transform(df).orderBy("i").collect()])
    assert np.abs(out).sum(axis=0) == pytest.approx(np.abs(x @ np.array(m.state["components"]).T).sum(axis=0))


def test_a_grid_of_lambdas_as_text_equals_the_column_expressions(spark):
    df = spark.createDataFrame([(v,) for v in (-3.5, -1.0, 0.0, 0.25, 1e6, None)], "`a``b` double")
    for lam in (-2.0, -0.30000000000000004, 0.0, 1e-05, 0.7, 1.0, 1.9, 2.0):
        text = FT.yeo_johnson_sql("CAST(`a``b` AS DOUBLE)", lam)
        assert df.selectExpr(text).collect() == df.select(FT.yeo_johnson_expr(F.col("`a``b`"), lam)).collect()


def test_categories_keep_their_quotes_and_backslashes(spark):
    values = ["a'b\\n", "é`", 'ü\n"', "x"]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "`c``d` string")
    m = FT.OneHot(cols=["c`d"]).fit(df)
    got = [list(r) for r in m.transform(df).collect()]
    assert got == [[float(v == c) for c in sorted(values)] for v in values] + [[0.0] * 4]
