"""Fitting Spark ML estimators and normalising their predictions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.proba import softmax_array
from ..plans.registry import Family


def scored_frame(pred: DataFrame, task: str, keep: list[str], label: str = "label") -> DataFrame:
    """Uniform prediction table: keep columns, y, y_pred, and for classification
    ``proba`` (array) and ``score`` (= proba[1])."""
    cols = pred.columns
    if task == "classification":
        out = [F.col(c) for c in keep] + [F.col(label).cast("int").alias("y")]
    else:
        out = [F.col(c) for c in keep] + [F.col(label).cast("double").alias("y")]
    if task == "classification":
        if "probability" in cols:
            proba = vector_to_array(F.col("probability"))
        else:  # one-vs-rest exposes margins only: softmax of the raw scores (rank-preserving)
            proba = softmax_array(vector_to_array(F.col("rawPrediction")))
        out += [F.col("prediction").cast("int").alias("y_pred"), proba.alias("proba"),
                F.element_at(proba, 2).alias("score")]
    else:
        out += [F.col("prediction").cast("double").alias("y_pred")]
    return pred.select(*out)


def fit_model(spec: Family, params: dict, train: DataFrame, ctx: dict):
    est = spec.build(params, ctx)
    return est.fit(train)


def model_context(train: DataFrame, task: str, n_features: int, weight_col: str | None = None) -> dict:
    """Sizes a factory needs: rows, weight sum, classes, std(y)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col("label")).alias("sy"),
            F.max(F.col("label")).alias("mx")]
    if weight_col:
        aggs.append(F.sum(F.col(weight_col)).alias("w"))
    r = train.agg(*aggs).first()
    return {"n_rows": r["n"], "weight_sum": r["w"] if weight_col else r["n"], "std_y": r["sy"],
            "n_classes": int(r["mx"]) + 1 if task == "classification" and r["mx"] is not None else None,
            "n_features": n_features, "weight_col": weight_col, "task": task}


def feature_importance(model, names: list[str]) -> list[tuple[str, float]]:
    """Tree importances or mean |coefficient| per feature, sorted descending; ``f_i`` names
    when the count differs."""
    m = model
    if hasattr(m, "stages"):
        m = m.stages[-1]
    imp = None
    if hasattr(m, "featureImportances"):
        imp = list(m.featureImportances.toArray())
    elif hasattr(m, "coefficientMatrix"):
        cm = m.coefficientMatrix.toArray()
        imp = list(abs(cm).mean(axis=0))
    elif hasattr(m, "coefficients"):
        imp = [abs(v) for v in m.coefficients.toArray()]
    elif hasattr(m, "models"):  # one-vs-rest: mean of member importances
        arrs = [list(x.featureImportances.toArray()) for x in m.models if hasattr(x, "featureImportances")]
        if arrs:
            imp = [sum(col) / len(arrs) for col in zip(*arrs)]
    if imp is None:
        return []
    if len(names) != len(imp):
        names = [f"f_{i}" for i in range(len(imp))]
    return sorted(zip(names, [float(v) for v in imp]), key=lambda t: (-t[1], t[0]))
