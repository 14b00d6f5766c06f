"""Full training run: clean → profile → plan → per-model CV search → OOF metrics →
leaderboard → blend / early stop / calibrate → refit → report and files."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_frame, named
from ..functions.lookup import table_bytes
from ..plans.options import plain
from ..plans.plan import TrainingPlan, make_plan, plan_profile
from ..plans.registry import FAMILIES, draws_made
from ..session import cut_lineage
from ..sources.sinks import save_bundle, write_json, write_table
from ..sources.tables import strip_column_names
from . import metrics as M
from . import profile as P
from .calibrate import calibrate, gbt_early_stop
from .ensemble import BlendModel, Member, blend_scored
from .features import MissingIndicators, value_key
from .labels import encode_target, index_labels
from .models import feature_importance, fit_model, model_context
from .preprocess import Preprocessor, PreprocessOptions, feature_schema
from .search import SearchOptions, SearchResult, folds_of_matrix, leaderboard_frame, oof_predictions, prepare_folds, release, search
from .smote import smote
from .split import kfold, sample_rows, stratified_folds

log = logging.getLogger("autotab")
#: Bytes of the prepared training table that one partition should hold.
PARTITION_BYTES = 32 << 20
LABEL, FOLD, WEIGHT = "__label", "__fold", "__w"


@dataclass(frozen=True)
class DataOptions:
    target: str | None = None
    key: tuple[str, ...] = ()                 # stable row key: folds and samples hang on it
    features: tuple[str, ...] | None = None
    drop_id_like: bool = True
    id_patterns: tuple[str, ...] = tuple(P.ID_PATTERNS)
    high_na_threshold: float = 0.95
    sample_rows: int | None = None
    leak_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class TrainOptions:
    task: str | None = None
    model_names: tuple[str, ...] | None = None
    include_mlp: bool = False
    class_weight: str | None = None
    resample: bool | None = None              # None: the plan decides
    primary_metric: str | None = None
    search_strategy: str | None = None        # "random" or "halving"
    auto_plan: bool = True                    # may the profile decide what is not set?
    calibrate: bool = True
    ensemble_top_n: int = 1
    early_stopping: bool = False
    early_stopping_rounds: int = 2000         # at most
    early_stopping_patience: int = 50
    output_dir: str | None = None


@dataclass(frozen=True)
class RunOptions:
    data: DataOptions = field(default_factory=DataOptions)
    preprocess: PreprocessOptions = field(default_factory=PreprocessOptions)
    cv: SearchOptions = field(default_factory=SearchOptions)
    train: TrainOptions = field(default_factory=TrainOptions)


@dataclass
class TrainedBundle:
    task: str
    key: list[str]
    target: str
    expected: list[tuple[str, str]]
    indicators: object
    members: list[Member]
    calibrated: object | None = None
    labels_info: dict = field(default_factory=dict)
    n_classes: int | None = None

    @property
    def model_name(self) -> str:
        return "+".join(m.name for m in self.members)

    def score(self, df: DataFrame) -> DataFrame:
        """Scored frame (key, y, y_pred, proba, score) for aligned, cleaned input; y is NULL without labels."""
        d = self.indicators.transform(df)
        if len(self.members) > 1:
            return BlendModel(self.members, None, self.task).score(d, self.key)
        only = self.members[0]
        if self.calibrated is None:
            return only.score(d, self.task, self.key)
        x = only.pre.transform(d)
        x = x if "label" in x.columns else x.withColumn("label", F.lit(None).cast("double"))
        return self.calibrated.transform(x).select(*self.key, F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("y_pred"),
                                                   "proba", F.element_at("proba", 2).alias("score"))


@dataclass
class TrainResult:
    report: dict
    leaderboard: DataFrame
    oof: DataFrame
    bundle: TrainedBundle
    importances: list
    plan: TrainingPlan


def prepare_training_frame(df: DataFrame, opts: RunOptions):
    """Name trim, blank → NULL, target check, row sample, sparse / feature / ID / leak column drops."""
    dc = opts.data
    d = clean_frame(strip_column_names(df))
    if dc.target not in d.columns:
        raise ValueError(f"target column {dc.target!r} not in columns: {d.columns}")
    if dc.sample_rows:
        d = sample_rows(d, list(dc.key), dc.sample_rows, opts.cv.random_state)
    d, dropped_sparse = P.drop_sparse(d, dc.target, dc.high_na_threshold)
    feats = [c for c in d.columns if c != dc.target and c not in dc.key]
    if dc.features is not None:
        missing = set(dc.features) - set(feats)
        if missing:
            raise ValueError(f"requested feature columns not found: {sorted(missing)}")
        feats = list(dc.features)
    dropped_id = []
    if dc.drop_id_like and dc.id_patterns:
        ids = P.id_like_columns(d.select(*map(named, feats)), dc.id_patterns).where("is_id = 1").collect()
        dropped_id = [r["column"] for r in ids]
    feats = [c for c in feats if c not in dropped_id and c not in dc.leak_columns]
    nnull = d.where(named(dc.target).isNull()).count()
    if nnull:
        log.warning("dropping %d rows with NULL target", nnull)
        d = d.where(named(dc.target).isNotNull())
    info = {"dropped_sparse": dropped_sparse, "dropped_id_like": dropped_id, "null_target_rows": nnull}
    return d.select(*map(named, [*dc.key, dc.target, *feats])), feats, info


def label_column(d: DataFrame, target: str, override: str | None):
    """(frame with LABEL, task, mapping label → index or None)."""
    task = P.detect_task(d, target, override)
    numeric = isinstance(d.schema[target].dataType, P.NUMERIC_TYPES)
    if task == "regression" and numeric:
        return d.withColumn(LABEL, named(target).cast("double")), task, None
    d, m = index_labels(d, target, out=LABEL) if numeric else encode_target(d, target, out=LABEL)
    return d, "classification", {r["label"]: r["index"] for r in m.collect()}


def text_columns(d: DataFrame, feats: list[str], opts: PreprocessOptions, fold: str | None = None, folds: int = 1) -> list[str]:
    """Long texts that every preprocessor turns into frequencies: with so many values (in the training part of every fold, if
    ``fold`` is given) that a sketch settles it as ``at_least_distinct`` does. Training needs the keys of their values only."""
    types = dict(d.dtypes)
    cols = [c for c in feats if types[c] in ("string", "binary") and c not in (opts.ordinal_mappings or {})]
    if not cols or not opts.freq_encode_high_card or opts.hash_text:
        return []
    parts = [F.lit(True)] if fold is None else [F.col(fold) != f for f in range(folds)]
    r = d.agg(*[F.approx_count_distinct(F.when(p, named(c))).alias(f"d{i}_{j}") for i, c in enumerate(cols) for j, p in enumerate(parts)],
              *[F.avg(F.octet_length(named(c))).alias(f"l{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if all(r[f"d{i}_{j}"] > 2 * opts.high_card_threshold + 20 for j in range(len(parts))) and ((r[f"l{i}"] or 0) > 64 or types[c] == "binary")]


def in_folds(d: DataFrame, feats: list[str], texts: list[str], n_classes: int | None, opts: RunOptions) -> tuple[DataFrame, list[str]]:
    """The rows with their fold, whole texts replaced by the keys of their values: they are not moved or held."""
    key, cv = list(opts.data.key), opts.cv

    def dealt(texts: list[str]) -> DataFrame:
        x = d.withColumns({c: value_key(named(c)) for c in texts}) if texts else d
        return stratified_folds(x, LABEL, key, cv.folds, cv.random_state, out=FOLD) if n_classes else kfold(x, key, cv.folds, cv.random_state, out=FOLD)

    out = dealt(texts)
    if texts:
        out = out.persist(StorageLevel.MEMORY_AND_DISK)
        sure = text_columns(out, texts, opts.preprocess, FOLD, cv.folds)
        if sure != texts:
            out.unpersist()
            return in_folds(d, feats, sure, n_classes, opts)
    return out, texts


def training_rows(x: DataFrame, plan: TrainingPlan, key: list[str], seed: int) -> DataFrame:
    return smote(x, "label", key, seed=seed).drop("synthetic", "copy") if plan.resample else x


def train_system(df: DataFrame, opts: RunOptions) -> TrainResult:
    spark, t0, key = df.sparkSession, time.time(), list(opts.data.key)
    if not key:
        raise ValueError("a stable row key (data.key) is required")
    # every pass of the cleaning, labelling and profiling reads the kept rows, not the input and its joins again; they stand in
    # files row by row: a column of thousands of whole texts is more than a task may hold
    source = cut_lineage(clean_frame(strip_column_names(df)))
    d, feats, info = prepare_training_frame(source, opts)
    d, task, mapping = label_column(d, opts.data.target, opts.train.task)
    indicators = MissingIndicators(cols=feats).fit(d)
    expected = [(c, t) for c, t in d.dtypes if c in {*feats, opts.data.target, *key}]
    d = indicators.transform(d)
    feats = feats + [f"MI__{c}" for c in indicators.state["cols"]]
    profile = plan_profile(d.select(*map(named, feats)), d, LABEL, opts.preprocess.high_card_threshold)
    n_classes = len(mapping) if mapping is not None else None
    plan = make_plan(profile, opts, task, n_classes)
    dealt, texts = in_folds(d, feats, text_columns(d, feats, opts.preprocess), n_classes, opts)
    d = dealt
    # synthetic rows make the classes alike, so row weights are for runs without them
    weighted = plan.class_weight == "balanced" and not plan.resample
    if weighted:
        d = P.balanced_weights(d, LABEL, out=WEIGHT)
    # the prepared training table (clean, labels, indicators, folds, weights) is written once
    # to the shared checkpoint folder: every fold, candidate and refit reads it with a short
    # plan, and a lost executor recomputes from here instead of from the raw input
    # one partition per PARTITION_BYTES: the fits run many small jobs over it, each over the few columns that it needs
    prepared = cut_lineage(d.coalesce(max(1, -(-table_bytes(d.persist(StorageLevel.MEMORY_AND_DISK)) // PARTITION_BYTES)))).persist(StorageLevel.MEMORY_AND_DISK)
    d.unpersist()
    dealt.unpersist()
    pre_opts = replace(opts.preprocess, keyed=tuple(texts), power_transform=opts.preprocess.power_transform if plan.preprocess["power_transform"] else False)
    run = Run(opts, plan, prepared, feats, key, task, weighted, pre_opts, n_classes)
    results = run.search_all()
    best = results[0]
    chosen = results[:plan.ensemble_top_n]
    members, calibrated, importances = run.refit(chosen)
    oof = best.oof if len(chosen) == 1 else run.blend_oof(chosen)
    bundle = TrainedBundle(task, key, opts.data.target, expected, indicators, members, calibrated,
                           {"mapping": mapping, "classes": sorted(mapping, key=mapping.get) if mapping else None}, n_classes)
    board = leaderboard_frame(spark, results)
    report = {
        "task": task, "primary_metric": plan.primary_metric, "final_model": bundle.model_name,
        "best_models": [{"model": r.model, "family": r.model, "cv_primary_score": r.best_score, "params": r.best_params,
                         "metrics": oof_metrics(r.oof, task, n_classes)} for r in results],
        "metrics": oof_metrics(oof, task, n_classes), "labels_info": bundle.labels_info, "plan": plan.to_dict(), "cleaning": info,
        "resampled": plan.resample, "draws": {r.model: len(r.leaderboard) for r in results}, "early_stopping_rounds": run.rounds, "n_features_in": len(feats),
        "n_features_out": sum(len(m.pre.feature_names) for m in members), "seconds": time.time() - t0,
    }
    result = TrainResult(report, board, oof, bundle, importances, plan)
    if calibrated is not None:
        scored = bundle.score(prepared.withColumn("label", F.col(LABEL).cast("double"))).persist(StorageLevel.MEMORY_AND_DISK)
        report["calibrated_in_sample"] = quality_of_scores(scored, n_classes)
        scored.unpersist()
    prepared.unpersist()
    if opts.train.output_dir:
        write_run(spark, opts, result, expected)
    return result


@dataclass
class Run:
    """What the steps of one run share."""

    opts: RunOptions
    plan: TrainingPlan
    rows: DataFrame
    feats: list[str]
    key: list[str]
    task: str
    weighted: bool
    pre_opts: PreprocessOptions
    n_classes: int | None
    rounds: int | None = None

    @property
    def select_k(self) -> int | None:
        return self.plan.preprocess["select_k_best"] if self.opts.preprocess.select_k_best not in (None, 0) else None

    def family(self, name: str):
        return FAMILIES[self.task][name]

    def weight_of(self, name: str) -> str | None:
        return WEIGHT if self.weighted and self.family(name).weighted else None

    def needs(self, name: str) -> tuple:
        """Models with equal needs share their folds."""
        return name in (self.pre_opts.scale_for or ()), name in (self.pre_opts.one_hot_for or ()), self.weight_of(name)

    def search_all(self) -> list[SearchResult]:
        """One kind of folds at a time; its matrices go before the next kind is prepared."""
        cv, out = self.opts.cv, []
        draws = draws_made(self.task, self.plan.model_iters)
        for needs in dict.fromkeys(map(self.needs, self.plan.model_names)):
            names = [n for n in self.plan.model_names if self.needs(n) == needs]
            folds = prepare_folds(self.rows, self.key, LABEL, self.feats, names[0], self.task, cv.folds, FOLD, needs[2], self.pre_opts,
                                  self.select_k, cut=False, resample=self.plan.resample, seed=cv.random_state)
            for name in names:
                began = time.time()
                res = search(self.family(name), folds, self.task, self.key, self.plan.primary_metric, draws[name],
                             self.plan.search_strategy, cv.random_state, cv.parallelism, cv.halving_factor)
                kept = cut_lineage(res.oof if res.oof is not None else oof_predictions(self.family(name), res.best_params, folds, self.task, self.key))
                if res.oof is not None:
                    res.oof.unpersist()
                res.oof, res.seconds = kept, time.time() - began
                out.append(res)
                if self.opts.train.output_dir:
                    write_json(self.rows.sparkSession, f"{self.opts.train.output_dir.rstrip('/')}/partial/{name}",
                               {"model": name, "params": res.best_params, "cv_primary_score": res.best_score, "seconds": res.seconds})
            release(folds)
        return sorted(out, key=lambda r: -r.best_score)

    def refit(self, chosen: list[SearchResult]) -> tuple[list[Member], object | None, list]:
        """Members fitted on all rows, the calibration of a single one, importances of the first."""
        members, calibrated, importances = [], None, []
        for res in chosen:
            spec, weight = self.family(res.model), self.weight_of(res.model)
            pre = Preprocessor(self.feats, res.model, self.task, self.pre_opts, target=LABEL, select_k=self.select_k).fit(self.rows)
            x = pre.transform(self.rows).select(*self.key, F.col(LABEL).cast("double").alias("label"), FOLD, *([weight] if weight else []), "features")
            x = x.persist(StorageLevel.MEMORY_AND_DISK)
            train = training_rows(x, self.plan, self.key, self.opts.cv.random_state)
            ctx = model_context(train, self.task, len(pre.feature_names), weight)
            if self.plan.early_stopping and res.model == "gbt":
                params = {k: v for k, v in res.best_params.items() if k != "maxIter"}
                model, self.rounds = gbt_early_stop(x, self.key, self.task, max_rounds=self.opts.train.early_stopping_rounds,
                                                    patience=self.opts.train.early_stopping_patience, train_rows=train, weight=weight, **params)
            else:
                model = fit_model(spec, res.best_params, train, ctx)
            members.append(Member(res.model, pre, model))
            if not importances:
                importances = feature_importance(model, pre.feature_names)
            if len(chosen) == 1 and self.plan.do_calibration and spec.proba:
                calibrated = calibrate(spec, res.best_params, folds_of_matrix(x, FOLD, self.opts.cv.folds, self.task, len(pre.feature_names), weight), key=self.key)
            x.unpersist()
        return members, calibrated, importances

    def blend_oof(self, chosen: list[SearchResult]) -> DataFrame:
        col = "proba" if self.n_classes else "y_pred"
        mean = blend_scored([r.oof for r in chosen], self.key, None, self.task, col)
        d = mean.join(chosen[0].oof.select(*self.key, "y", "fold"), self.key)
        return cut_lineage(d.withColumn("y_pred", F.col("y_pred").cast("int")).withColumn("score", F.element_at("proba", 2)) if self.n_classes else d)


def quality_of_scores(scored: DataFrame, n_classes: int | None) -> dict:
    if (n_classes or 2) == 2:
        return {"brier": M.brier(scored, "y", "score").first()[0], "log_loss": M.log_loss_binary(scored, "y", "score").first()["log_loss"]}
    return {"log_loss": M.log_loss_multi(scored, "y", "proba").first()["log_loss"]}


def oof_metrics(oof: DataFrame, task: str, n_classes: int | None) -> dict:
    if task == "regression":
        r = M.regression_metrics(oof, "y", "y_pred").first()
        return {"rmse": r["rmse"], "mae": r["mae"], "r2": r["r2"]}
    out = {"accuracy": M.accuracy(oof).first()["accuracy"], "f1_macro": M.f1_macro(oof).first()["f1_macro"]} | quality_of_scores(oof, n_classes)
    if (n_classes or 2) == 2:
        out["roc_auc"] = M.roc_auc(oof, "y", "score").first()["roc_auc"]
        out["avg_precision"] = M.average_precision(oof, "y", "score").first()["avg_precision"]
        out["best_f1_threshold"] = M.best_threshold_f1(oof, "y", "score").first()["threshold"]
        out["youden_threshold"] = M.best_threshold_youden(oof, "y", "score").first()["threshold"]
    else:
        out["roc_auc_ovr"] = M.roc_auc_ovr(oof, "y", "proba").first()["roc_auc_ovr"]
    return out


def oof_table(oof: DataFrame, n_classes: int | None) -> DataFrame:
    """y_true, y_pred and, for classes, proba_0 .. proba_{K-1}."""
    proba = [F.element_at("proba", j + 1).alias(f"proba_{j}") for j in range(n_classes or 0)]
    return oof.select(F.col("y").alias("y_true"), "y_pred", *proba)


def write_run(spark, opts: RunOptions, result: TrainResult, expected: list[tuple[str, str]]) -> None:
    """Everything a later session needs: options, feature schema, target mapping, plan, report, leaderboard, OOF
    predictions, importances, a readme and the bundle itself; any Hadoop file system path works."""
    base, b = opts.train.output_dir.rstrip("/"), result.bundle
    write_json(spark, f"{base}/options", plain(opts))
    write_json(spark, f"{base}/target_mapping", b.labels_info)
    write_json(spark, f"{base}/plan", result.plan.to_dict())
    write_json(spark, f"{base}/report", result.report)
    write_table(feature_schema(spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in expected))).coalesce(1), f"{base}/features_schema", "json")
    write_table(result.leaderboard.coalesce(1), f"{base}/leaderboard", "json")
    write_table(oof_table(result.oof, b.n_classes), f"{base}/oof_predictions")
    if result.importances:
        write_table(spark.createDataFrame(result.importances, "feature string, importance double").coalesce(1), f"{base}/feature_importance", "json")
    lines = [f"task: {b.task}", f"target: {b.target}", f"final model: {b.model_name}", f"primary metric: {result.plan.primary_metric}",
             *(f"{k}: {v}" for k, v in result.report["metrics"].items())]
    write_table(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), f"{base}/readme", "text")
    save_bundle(spark, b, f"{base}/bundle")

