"""Properties of trained models (FIXTURES §5 / SURVEY §5 (c))."""

import pytest
from pyspark.sql import functions as F

from autotab import catalog
from autotab.operators import holdout as HO
from autotab.operators import train as TR
from autotab.plans.options import changed
from autotab.sources import fixtures as fx
from autotab.sources.sinks import load_bundle, save_bundle
from paths import SF001


@pytest.fixture(scope="module")
def trained(spark):
    return catalog.TR.train_system(fx.docs_ml(spark, SF001), catalog.docs_options(draws=1, models=["logistic"], cv__folds=3))


def test_oof_covers_every_key_once(spark, trained):
    oof = trained.oof
    n = fx.docs_ml(spark, SF001).count()
    assert oof.count() == n
    assert oof.select("doc_id").distinct().count() == n


def test_probabilities_sum_to_one(trained):
    s = trained.oof.select(F.aggregate("proba", F.lit(0.0), lambda a, b: a + b).alias("t")).collect()
    assert all(abs(r["t"] - 1.0) < 1e-9 for r in s)


def test_report_shape(trained):
    rep = trained.report
    assert rep["task"] == "classification"
    assert rep["best_models"][0]["metrics"]["roc_auc"] is not None
    assert rep["labels_info"]["classes"] == ["0", "1"]  # numeric classes indexed in natural order


def test_save_load_same_predictions(spark, trained, tmp_path):
    path = str(tmp_path / "bundle")
    save_bundle(spark, trained.bundle, path)
    again = load_bundle(spark, path)
    df = fx.docs_ml(spark, SF001)
    a, _ = HO.score_holdout(trained.bundle, df, threshold=None)
    b, _ = HO.score_holdout(again, df, threshold=None)
    ra = {r["doc_id"]: round(r["y_score"], 9) for r in a.collect()}
    rb = {r["doc_id"]: round(r["y_score"], 9) for r in b.collect()}
    assert ra == rb


def test_holdout_metrics(spark, trained):
    preds, res = HO.score_holdout(trained.bundle, fx.docs_ml(spark, SF001), threshold="f1")
    m = res["metrics"]
    assert 0.0 <= m["accuracy"] <= 1.0 and m["used_threshold"] is not None
    assert set(preds.columns) == {"doc_id", "y", "y_pred", "y_score"}


def test_smote_points_lie_on_segments_to_near_neighbours(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from autotab.operators import smote as S
    monkeypatch.setattr(S, "BLOCK", 7)
    monkeypatch.setattr(S, "QUERY_BLOCKS", 2)
    rng = np.random.default_rng(1)
    rows = [(i, 0, *map(float, rng.normal(0, 1, 3))) for i in range(90)] + [(100 + i, 1, *map(float, rng.normal(5, 1, 3))) for i in range(33)]
    df = spark.createDataFrame(rows, "k long, y int, a double, b double, c double")
    x = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).select("k", "y", "features")
    out = S.smote(x, "y", ["k"], k=4)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 90, 1: 90}
    base = np.array([r[2:] for r in rows if r[1] == 1])
    dist = ((base[:, None] - base[None]) ** 2).sum(2)
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(dist, axis=1)[:, :4]
    for p in (r["features"].toArray() for r in out.where("synthetic = 1").collect()):
        a, b = base[:, None, :], base[near]
        u = ((p - a) * (b - a)).sum(2) / ((b - a) ** 2).sum(2)
        off = np.abs(a + u[..., None] * (b - a) - p).max(2)
        assert ((off < 1e-9) & (u >= -1e-9) & (u <= 1 + 1e-9)).any()
    again = S.smote(x.repartition(5), "y", ["k"], k=4)
    assert sorted(map(str, out.where("synthetic = 1").collect())) == sorted(map(str, again.where("synthetic = 1").collect()))


def run_small(spark, tmp_path=None, **more):
    rows = [(i, float(i % 17), float((i * 7) % 11), "St. Paul" if i % 3 else "1.5", "pos" if (i % 17) + (i % 3) > 13 else "neg") for i in range(240)]
    df = spark.createDataFrame(rows, "k long, `no.` double, b double, city string, y string")
    o = changed(TR.RunOptions(), data__target="y", data__key=["k"], data__drop_id_like=False, cv__folds=3, cv__n_iter_search=1, train__model_names=["logistic"])
    return df, TR.train_system(df, changed(o, **more))


def test_plan_is_executed(spark):
    _, plain_run = run_small(spark, train__resample=False, train__calibrate=False)
    assert not plain_run.report["resampled"] and plain_run.bundle.calibrated is None and len(plain_run.bundle.members) == 1
    _, more = run_small(spark, train__resample=True, train__calibrate=False)
    assert more.report["resampled"]
    a, b = ([r["score"] for r in x.oof.orderBy("k").collect()] for x in (plain_run, more))
    assert len(a) == len(b) == 240 and a != b


def test_dotted_names_svd_and_correlation_filter(spark):
    df, run = run_small(spark, preprocess__svd_components=2, train__calibrate=False)
    assert run.bundle.members[0].pre.feature_names == ["svd_0", "svd_1"]
    df = df.withColumn("copy_of_b", F.col("b") * 2)
    o = changed(TR.RunOptions(), data__target="y", data__key=["k"], data__drop_id_like=False, cv__folds=3, cv__n_iter_search=1, train__model_names=["logistic"], preprocess__correlation_filter=True)
    names = TR.train_system(df, o).bundle.members[0].pre.feature_names
    assert "b" in names and "copy_of_b" not in names and "city=St. Paul" in names


def test_blend_early_stopping_files_and_reload(spark, tmp_path):
    out = str(tmp_path / "run")
    df, run = run_small(spark, train__model_names=["logistic", "gbt"], train__ensemble_top_n=2, train__early_stopping=True,
                        train__early_stopping_rounds=5, train__output_dir=out)
    assert len(run.bundle.members) == 2 and 1 <= run.report["early_stopping_rounds"] <= 5
    import os
    assert {"options", "features_schema", "target_mapping", "plan", "partial", "report", "leaderboard", "oof_predictions", "feature_importance", "readme", "bundle"} <= set(os.listdir(out))
    assert spark.read.parquet(f"{out}/oof_predictions").columns == ["y_true", "y_pred", "proba_0", "proba_1"]
    os.rename(out, out + "-moved")
    again = load_bundle(spark, out + "-moved/bundle")
    a, b = ({r["k"]: round(r["y_score"], 9) for r in HO.score_holdout(x, df, threshold=None)[0].collect()} for x in (run.bundle, again))
    assert a == b and len(a) == 240


def test_unseen_holdout_label_stays_out_of_the_metrics(spark):
    df, run = run_small(spark, train__calibrate=False)
    odd = df.withColumn("y", F.when(F.col("k") < 5, "maybe").otherwise(F.col("y")))
    preds, res = HO.score_holdout(run.bundle, odd)
    assert res["unmatched_labels"] == 5 and preds.count() == 240 and preds.where("y is null").count() == 5


def test_failed_candidates_fall_back_to_defaults(spark, monkeypatch):
    import dataclasses
    from autotab.plans import registry as RG
    spec = RG.FAMILIES["classification"]["logistic"]

    def build(params, ctx):
        if params:
            raise ValueError("bad parameters")
        return spec.build(params, ctx)
    monkeypatch.setitem(RG.FAMILIES["classification"], "logistic", dataclasses.replace(spec, build=build))
    _, run = run_small(spark, train__calibrate=False)
    assert run.report["best_models"][0]["params"] == {}


def test_stacked_model_scores_and_reloads(spark, tmp_path):
    from autotab.operators import ensemble as EN
    from autotab.operators import search as SE
    from autotab.plans import registry as RG
    from autotab.sources.sinks import load_model, save_model
    df = catalog.SP.stratified_folds(fx.docs_ml(spark, SF001), "quality", ["doc_id"], k=3)
    pre = catalog.PP.Preprocessor(catalog.DOCS_FEATS, "logistic", "classification", catalog._pre_no_power()).fit(df)
    x = pre.transform(df).select("doc_id", "fold", F.col("quality").cast("double").alias("label"), "features")
    folds = SE.folds_of_matrix(x, "fold", 3, "classification", len(pre.feature_names))
    reg = RG.FAMILIES["classification"]
    model, meta = EN.stacking([(reg["logistic"], {"C": 1.0}), (reg["rf"], {"numTrees": 5, "maxDepth": 3})], folds, "classification", ["doc_id"], rows=x)
    rows = folds[0].valid
    save_model(spark, model, str(tmp_path / "stack"))
    a, b = ({r["doc_id"]: round(r["score"], 9) for r in m.score(rows, ["doc_id"]).collect()} for m in (model, load_model(spark, str(tmp_path / "stack"))))
    assert a == b and len(a) == rows.count() and meta.count() > len(a)


def test_ordinal_codes_of_many_categories(spark):
    from autotab.operators import features as FT
    df = spark.range(1300).selectExpr("CONCAT('c', LPAD(CAST(id AS STRING), 5, '0')) AS c")
    out = FT.OrdinalEncode(cols=["c"]).fit(df).transform(df.unionByName(spark.createDataFrame([("new",), (None,)], "c string")))
    assert sorted(r.c for r in out.collect()) == [-1.0, -1.0, *map(float, range(1300))]


def test_streamed_batches_are_idempotent(spark, trained, tmp_path):
    from autotab.streaming.score import stream_score
    src = fx.docs_ml(spark, SF001)
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    args = (spark, trained.bundle, str(tmp_path / "in"), src.schema)
    stream_score(*args, str(tmp_path / "ck"), str(tmp_path / "out"), max_files_per_trigger=1)
    first = spark.read.parquet(str(tmp_path / "out/predictions")).count()
    assert first == src.count() and spark.read.parquet(str(tmp_path / "out/status")).select("batch_id").distinct().count() == 3
    stream_score(*args, str(tmp_path / "ck"), str(tmp_path / "out"), max_files_per_trigger=1)  # nothing new
    stream_score(*args, str(tmp_path / "ck2"), str(tmp_path / "out"), max_files_per_trigger=1)  # all batches replayed
    assert spark.read.parquet(str(tmp_path / "out/predictions")).count() == first


def test_logistic_beats_constant_on_separable_target(spark):
    from autotab.operators import metrics as M
    df = fx.orders_ml(spark, SF001)
    df = df.withColumn("big", (F.col("o_totalprice") > 150000).cast("int"))
    pre, model, x = catalog._fit_all(spark, df, ["o_totalprice", "c_acctbal"], "logistic", "classification", "big",
                                     "logistic", {"C": 100.0}, ["o_orderkey"])
    sc = catalog.scored_frame(model.transform(x), "classification", keep=["o_orderkey"])
    assert M.roc_auc(sc, "y", "score").first()["roc_auc"] > 0.95


def test_fits_read_their_rows_once(spark):
    from autotab import catalog as C
    n, seen = 200, spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf
    df = (spark.range(n).select("id", (F.col("id") % 7).cast("double").alias("a"), F.concat(F.lit("c"), F.col("id") % 3).alias("b"), (F.col("id") * 0.5).alias("y"))
          .mapInPandas(counted, "id long, a double, b string, y double"))
    pre, model, x = C._fit_all(spark, df, ["a", "b"], "linear", "regression", "y", "linear", {"alpha": 0.01, "l1_ratio": 0.5}, ["id"])
    # a checkpoint runs its rows twice at most: to compute and to write them
    assert model.transform(x).count() == n and len(pre.feature_names) == 4 and seen.value <= 2 * n
