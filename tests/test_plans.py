"""Driver-side helpers: registry, budgets, plan, config round trip, cleaning guards."""

import pytest

from autotab.plans import registry as RG
from autotab.operators.train import RunOptions
from autotab.plans.options import build, changed, plain
from autotab.plans.plan import make_plan


def test_budget_follows_the_shares():
    assert RG.split_budget("classification", ["logistic", "rf", "gbt"], 90) == {"logistic": 23, "rf": 27, "gbt": 40}
    assert RG.split_budget("classification", ["logistic", "rf"], 2) == {"logistic": 1, "rf": 1}
    for total in range(1, 60):
        for models in (["logistic"], ["logistic", "gbt"], ["logistic", "rf", "gbt", "mlp"]):
            got = RG.split_budget("classification", models, total)
            assert min(got.values()) >= min(3, max(1, total // len(models))) and (sum(got.values()) == total or total < len(models))


def test_candidates_and_registry():
    assert RG.candidate_models("classification") == ["logistic", "rf", "gbt"]
    assert RG.candidate_models("classification", True) == ["logistic", "rf", "gbt", "mlp"]
    assert RG.candidate_models("regression") == ["linear", "rf", "gbt"]


def test_draw_candidates_distinct():
    f = RG.FAMILIES["classification"]["gbt"]
    c = RG.draw_candidates(f.space, 30, seed=42)
    assert len(c) == 30 and len({str(sorted(x.items())) for x in c}) == 30
    assert c == RG.draw_candidates(f.space, 30, seed=42)


def test_unused_draws_go_to_other_families():
    assert RG.draws_made("classification", {"logistic": 23, "rf": 27, "gbt": 40}) == {"logistic": 6, "rf": 34, "gbt": 50}
    assert RG.draws_made("classification", {"logistic": 3, "rf": 5}) == {"logistic": 3, "rf": 5}
    assert RG.draws_made("classification", {"logistic": 60}) == {"logistic": 6}
    for a in range(1, 40, 3):
        got = RG.draws_made("classification", {"logistic": a, "rf": 70, "gbt": 5})
        assert sum(got.values()) == a + 75 and got["logistic"] <= 6 and got["rf"] <= 81


def test_plan_rules():
    prof = {"n_samples": 20_000, "n_features": 5, "n_num": 2, "n_cat": 3, "skewed_num_cols_sample": [],
            "high_card_cat_cols": [], "imbalance_ratio": 1.2, "task": "classification"}
    p = make_plan(prof, RunOptions())
    assert p.primary_metric == "roc_auc" and p.class_weight is None and p.search_strategy == "random"
    assert not p.resample and not p.preprocess["power_transform"] and set(p.rationale) >= {"primary_metric", "resample"}
    unlike = prof | {"imbalance_ratio": 3.0, "skewed_num_cols_sample": ["a"]}
    p = make_plan(unlike, RunOptions())
    assert p.primary_metric == "f1_macro" and p.class_weight == "balanced" and p.resample and p.preprocess["power_transform"]
    assert make_plan(unlike | {"n_samples": 10**9}, RunOptions()).to_dict() == p.to_dict() | {"dataset_profile": unlike | {"n_samples": 10**9}}
    own = make_plan(unlike, changed(RunOptions(), train__resample=False, train__primary_metric="accuracy", train__search_strategy="halving"))
    assert (own.resample, own.primary_metric, own.search_strategy) == (False, "accuracy", "halving")
    assert not make_plan(unlike, changed(RunOptions(), train__auto_plan=False)).resample


def test_options_round_trip():
    o = changed(RunOptions(), data__target="y", data__key=["k"], cv__folds=3)
    assert build(RunOptions, plain(o)) == o and o.data.key == ("k",)
    assert build(RunOptions, {"cv": {"folds": 4}}).cv.folds == 4
    with pytest.raises(ValueError, match="unknown options"):
        build(RunOptions, {"cv": {"fold": 4}})
    with pytest.raises(ValueError, match="unknown option"):
        changed(o, cv__fold=4)


def test_target_and_feature_guards(spark):
    from autotab.operators.train import prepare_training_frame
    df = spark.createDataFrame([(1, "a", 0)], "k int, f string, y int")
    with pytest.raises(ValueError, match="target column"):
        prepare_training_frame(df, changed(RunOptions(), data__key=["k"], data__target="missing"))
    with pytest.raises(ValueError, match="not found"):
        prepare_training_frame(df, changed(RunOptions(), data__key=["k"], data__target="y", data__features=["nope"]))


def test_strip_names_and_collisions(spark):
    from autotab.sources.tables import strip_column_names
    df = spark.createDataFrame([(1, 2)], "` a ` int, `b ` int")
    assert strip_column_names(df).columns == ["a", "b"]
    with pytest.raises(ValueError):
        strip_column_names(spark.createDataFrame([(1, 2)], "` a` int, `a ` int"))


def test_read_csv_tokens_and_types(spark, tmp_path):
    from autotab.sources.tables import read_csv
    p = tmp_path / "t.csv"
    p.write_text(" id ,x,c\n1,1.5,a\n2,NA,  \n3,2,N/A\n")
    df = read_csv(spark, str(p))
    assert df.columns == ["id", "x", "c"]
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "c": "string"}
    assert [r["c"] for r in df.orderBy("id").collect()] == ["a", None, None]


def test_read_csv_quotes_and_line_breaks(spark, tmp_path):
    from autotab.sources.tables import read_csv
    p = tmp_path / "q.csv"
    p.write_text('id,x\n1,"line one\nline two"\n2,"say ""hi"", twice"\n')
    assert [(r.id, r.x) for r in read_csv(spark, str(p)).orderBy("id").collect()] == [(1, "line one\nline two"), (2, 'say "hi", twice')]


def test_positive_label_order(spark):
    from autotab.operators.labels import positive_label
    df = spark.createDataFrame([("True",), ("Y",), ("Y",)], "y string")
    assert positive_label(df, "y").first()[0] == "Y"


def test_training_run_searches_with_the_default_budget():
    import __spark_entry__
    from autotab import catalog
    from autotab.operators.search import SearchOptions
    from autotab.plans import registry
    assert catalog.docs_options().cv.n_iter_search == SearchOptions().n_iter_search == 30
    assert registry.BOOSTING["maxIter"] == [100, 200, 300] and registry.BOOSTING["maxDepth"] == [3, 5, 7]
    assert __spark_entry__.FLAGSHIP == "train_report"


def test_a_run_reads_its_source_once(spark, monkeypatch):
    from pyspark.sql import functions as F
    from autotab.operators import train as TR
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        seen.add(1)
        return float(i % 7)

    class Stop(Exception):
        pass

    def stop(self):
        raise Stop
    monkeypatch.setattr(TR.Run, "search_all", stop)
    df = spark.range(120).select("id", (F.col("id") % 2).alias("y"), value("id").alias("v"))
    with pytest.raises(Stop):
        TR.train_system(df, changed(TR.RunOptions(), data__target="y", data__key=["id"]))
    assert seen.value == 120


def test_folds_hold_keys_in_place_of_long_texts(spark, monkeypatch):
    from pyspark.sql import functions as F
    from autotab.operators import preprocess as PP
    from autotab.operators import train as TR

    class Stop(Exception):
        pass

    def stop(self):
        raise Stop(self)
    monkeypatch.setattr(TR.Run, "search_all", stop)
    df = spark.range(700).select("id", (F.col("id") % 2).alias("y"), F.when(F.col("id") % 50 > 0, F.concat(F.repeat(F.lit("word "), 20), (F.col("id") % 500).cast("string"))).alias("text"),
                                 F.concat(F.repeat(F.lit("few "), 30), (F.col("id") % 3).cast("string")).alias("few"))
    opts = changed(TR.RunOptions(), data__target="y", data__key=["id"], data__features=["text", "few"])
    with pytest.raises(Stop) as caught:
        TR.train_system(df, opts)
    run = caught.value.args[0]
    types = dict(run.rows.dtypes)
    assert types["text"] == "binary" and types["few"] == "string" and run.pre_opts.keyed == ("text",)
    feats = ["text", "few"]
    keyed = PP.Preprocessor(feats, "logistic", "classification", run.pre_opts).fit(run.rows)
    plain = PP.Preprocessor(feats, "logistic", "classification", PP.PreprocessOptions(power_transform=run.pre_opts.power_transform)).fit(df)
    assert keyed.feature_names == plain.feature_names
    got, same, want = ({r.id: r.features for r in m.transform(x).collect()} for m, x in ((keyed, run.rows), (keyed, df), (plain, df)))
    # the model takes keys and texts alike
    assert len(got) == len(same) == len(want) == 700
    assert all(abs(a - b) < 1e-9 for i, v in want.items() for x in (got, same) for a, b in zip(v, x[i], strict=True))


def test_folds_write_the_columns_that_they_need(spark, monkeypatch):
    from pyspark.sql import functions as F
    from autotab.operators import search as SE
    written = []
    monkeypatch.setattr(SE, "cut_lineage", lambda d, f=SE.cut_lineage: written.append(d.columns) or f(d))
    df = spark.range(60).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 7).cast("double").alias("v"), F.repeat(F.lit("text "), 100).alias("text"), (F.col("id") % 3).cast("int").alias("fold"))
    folds = SE.prepare_folds(df, ["id"], "y", ["v", "gone"], "rf", "classification", 3)
    assert written[0] == ["id", "y", "v", "fold"] and sum(f.valid.count() for f in folds) == 60
