"""Category indexes as tables and sparse one-hot vectors."""

from pyspark.sql import functions as F

from autotab.functions import ranking as RK
from autotab.operators import features as FT
from autotab.operators.preprocess import Preprocessor, PreprocessOptions


def test_range_ranks_equal_a_window(spark, monkeypatch):
    monkeypatch.setattr(RK, "RANGE_ROWS", 17)
    rows = [(f"g{i % 3 if i % 2 else 0}", f"v{i * 7919 % 400:03d}") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v string").distinct()
    got = {(r.g, r.v): r["rank"] for r in RK.range_rank(df, ["g"], ["v"]).collect()}
    for g in {g for g, _ in got}:
        values = sorted(v for h, v in got if h == g)
        assert [got[g, v] for v in values] == list(range(len(values)))


def test_sparse_one_hot_of_many_categories(spark):
    df = spark.range(20_000).selectExpr("id", "CONCAT('c', LPAD(CAST(id AS STRING), 6, '0')) AS c", "IF(id % 2 = 0, 'x', NULL) AS d")
    m = FT.SparseOneHot(cols=["c", "d"]).fit(df)
    assert m.state["sizes"] == [20_000, 1]
    asked = df.where("id < 4 OR id = 19999").unionByName(spark.createDataFrame([(-1, "new", "y"), (-2, None, "x")], "id long, c string, d string"))
    out = {r["id"]: r for r in m.transform(asked).collect()}
    for i in (0, 1, 2, 3, 19_999):
        v = out[i]["c__onehot"]
        assert v.size == 20_000 and v.indices.tolist() == [i] and v.values.tolist() == [1.0]
        assert out[i]["d__onehot"].toArray().tolist() == [1.0 - i % 2]
    assert out[-1]["c__onehot"].indices.tolist() == [] and out[-2]["c__onehot"].indices.tolist() == [] and out[-2]["d__onehot"].toArray().tolist() == [1.0]


def test_preprocessor_turns_wide_columns_into_sparse_vectors(spark, tmp_path):
    from autotab.sources.sinks import load_model, save_model
    df = spark.range(60).selectExpr("id", "CAST(id % 30 AS STRING) AS wide", "CAST(id % 2 AS STRING) AS narrow", "CAST(id AS DOUBLE) AS x", "id % 2 AS y")
    cfg = PreprocessOptions(freq_encode_high_card=False, one_hot_columns=10, power_transform=False)
    pre = Preprocessor(["wide", "narrow", "x"], "logistic", "classification", cfg, target="y").fit(df)
    assert len(pre.feature_names) == 1 + 2 + 30 and "narrow=0" in pre.feature_names and "wide[29]" in pre.feature_names
    save_model(spark, pre, str(tmp_path / "pre"))
    for p in (pre, load_model(spark, str(tmp_path / "pre"))):
        v = p.transform(df).orderBy("id").select("features").collect()[31]["features"].toArray()
        assert len(v) == 33 and v[1 + 2:].sum() == 1 and v[3 + sorted(map(str, range(30))).index("1")] == 1


def test_ordinal_codes_follow_the_sorted_categories(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "c string")
    out = FT.OrdinalEncode(cols=["c"]).fit(df).transform(df.unionByName(spark.createDataFrame([("z",)], "c string")))
    assert sorted(r.c for r in out.select(F.col("c")).collect()) == [-1.0, -1.0, 0.0, 0.0, 1.0, 2.0]
