"""Model families: for every task the builders of Spark ML estimators, their search spaces and budgets.

A builder takes (params, ctx) and returns an unfitted estimator; ``ctx`` holds the sizes that some of
them need (rows, weight sum, classes, features). Boosting is ``operators.boosting``, the rest Spark ML.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import LinearRegression, RandomForestRegressor

COLUMNS = {"featuresCol": "features", "labelCol": "label"}
SEED = 42


@dataclass(frozen=True)
class Family:
    name: str
    build: Callable[[dict, dict], Any]
    space: dict[str, list]
    share: float                 # of the search budget, relative to the other families
    weighted: bool = True        # takes row weights
    proba: bool = True           # gives class probabilities
    offered: bool = True         # a candidate unless asked for by name
    together: str | None = None  # how all folds of all candidates are fitted in one run, if they are


FAMILIES: dict[str, dict[str, Family]] = {"classification": {}, "regression": {}}


def family(task: str, name: str, space: dict[str, list], share: float, **traits):
    def add(build):
        FAMILIES[task][name] = Family(name, build, space, share, **traits)
        return build
    return add


def row_weights(ctx: dict) -> dict:
    """weightCol only where one is in use (None would reach the JVM as null)."""
    return {"weightCol": ctx["weight_col"]} if ctx.get("weight_col") else {}


# Family shares and the kinds of parameters searched are those that callers know.
FOREST = {"numTrees": [50, 100, 200], "maxDepth": [6, 10, 16], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["sqrt", "log2", "all"]}
BOOSTING = {"maxIter": [100, 200, 300], "maxDepth": [3, 5, 7], "stepSize": [0.02, 0.05, 0.1], "subsamplingRate": [0.7, 0.85, 1.0],
            "featureFraction": [0.7, 0.85, 1.0], "minGain": [0.0, 0.1, 0.2]}


@family("classification", "logistic", {"C": [1e-3, 1e-2, 1e-1, 1, 10, 100]}, share=1.0, together="logistic")
def logistic(params, ctx):
    weight = float(ctx.get("weight_sum") or ctx.get("n_rows") or 1.0)
    return LogisticRegression(**COLUMNS, **row_weights(ctx), regParam=1.0 / (float(params.get("C", 1.0)) * weight), elasticNetParam=0.0,
                              standardization=False, maxIter=int(params.get("maxIter", 2000)), tol=float(params.get("tol", 1e-4)))


@family("classification", "rf", FOREST, share=1.2, together="forest")
def forest_classifier(params, ctx):
    return RandomForestClassifier(**COLUMNS, **row_weights(ctx), seed=SEED, **params)


def boosted(classes: int | None, params, ctx):
    from ..operators.boosting import BoostedTrees
    return BoostedTrees(classes, **COLUMNS, **row_weights(ctx), seed=SEED, **params)


@family("classification", "gbt", BOOSTING, share=1.8, together="boosting")
def boosted_classifier(params, ctx):
    return boosted(max(2, int(ctx.get("n_classes") or 2)), params, ctx)


@family("classification", "mlp", {"hidden": [64, 128], "dropout": [0.0, 0.1, 0.3], "learningRate": [1e-3, 3e-3], "epochs": [25, 50]}, share=1.4, offered=False)
def perceptron(params, ctx):
    from ..operators.mlp import Perceptron
    own = {k: v for k, v in params.items() if k != "hidden"} | ({"hidden": tuple(np.atleast_1d(params["hidden"]).tolist())} if "hidden" in params else {})
    return Perceptron(max(2, int(ctx.get("n_classes") or 2)), **COLUMNS, **row_weights(ctx), seed=SEED, **own)


@family("regression", "linear", {"alpha": [1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0], "l1_ratio": [0.0, 0.2, 0.5, 0.8, 1.0]}, share=1.0, proba=False)
def elastic_net(params, ctx):
    """Spark scales the penalty's l2 part by the label's spread; alpha and l1_ratio are meant without."""
    alpha, l1 = float(params.get("alpha", 1.0)), float(params.get("l1_ratio", 0.5))
    lasso, ridge = alpha * l1, alpha * (1 - l1) * float(ctx.get("std_y") or 1.0)
    return LinearRegression(**COLUMNS, **row_weights(ctx), regParam=lasso + ridge, elasticNetParam=lasso / (lasso + ridge) if lasso + ridge else 0.0,
                            standardization=False, solver="normal", maxIter=200)


@family("regression", "rf", FOREST, share=1.2, proba=False, together="forest")
def forest_regressor(params, ctx):
    return RandomForestRegressor(**COLUMNS, **row_weights(ctx), seed=SEED, **params)


@family("regression", "gbt", BOOSTING, share=1.8, proba=False, together="boosting")
def boosted_regressor(params, ctx):
    return boosted(None, params, ctx)


def candidate_models(task: str, include_mlp: bool = False) -> list[str]:
    return [n for n, f in FAMILIES[task].items() if f.offered or include_mlp]


def space_size(space: dict[str, list]) -> int:
    return math.prod(max(1, len(v)) for v in space.values())


def draw_candidates(space: dict[str, list], n_iter: int, seed: int = 42) -> list[dict]:
    """Seeded distinct draw of parameter combinations from the grid (md5 order)."""
    if not space:
        return [{}]
    names = sorted(space)
    combos = [dict(zip(names, values, strict=True)) for values in itertools.product(*(space[n] for n in names))]
    return sorted(combos, key=lambda c: hashlib.md5(f"{seed}|{sorted(c.items())}".encode()).hexdigest())[:max(1, n_iter)]


def split_budget(task: str, models: list[str], total: int, least: int = 3) -> dict[str, int]:
    """``total`` draws dealt out by the families' shares with the largest-remainder method; a family gets
    ``least`` draws at any rate, paid by the largest others, as far as the total reaches."""
    shares = [FAMILIES[task][m].share if m in FAMILIES[task] else 1.0 for m in models]
    exact = [total * s / sum(shares) for s in shares]
    draws = [math.floor(x) for x in exact]
    by_remainder = sorted(range(len(models)), key=lambda i: (draws[i] - exact[i], i))
    for i in by_remainder[:total - sum(draws)]:
        draws[i] += 1
    floor = max(1, min(least, total // max(1, len(models))))
    for i in range(len(models)):
        while draws[i] < floor and max(draws) > floor:
            draws[draws.index(max(draws))] -= 1
            draws[i] += 1
    return {m: max(1, d) for m, d in zip(models, draws, strict=True)}


def draws_made(task: str, planned: dict[str, int]) -> dict[str, int]:
    """The planned draws as far as each family's space holds them; what a family cannot use goes to the others by their
    planned draws, so that all of them are made unless every space is used up."""
    size = {m: space_size(FAMILIES[task][m].space) for m in planned}
    made = {m: min(n, size[m]) for m, n in planned.items()}
    spare = sum(planned.values()) - sum(made.values())
    while spare > 0 and (open_ := [m for m in planned if made[m] < size[m]]):
        whole = sum(planned[m] for m in open_)
        for m in open_:
            more = min(size[m] - made[m], max(1, spare * planned[m] // whole), spare - (sum(made.values()) - (sum(planned.values()) - spare)))
            made[m] += max(0, more)
        spare = sum(planned.values()) - sum(made.values())
    return made
