"""Truncated SVD (uncentred) of a feature-vector column.

The d×d Gram matrix XᵀX is assembled from JVM-side statistics — Pearson
correlations (``ml.stat.Correlation``), per-column means and sample standard
deviations (``ml.stat.Summarizer``): XᵀX = (n−1)·D·R·D + n·μμᵀ. Its
eigen-decomposition on the driver (d×d, bounded by the feature count) gives V and
the singular values; projection x·V_k is one matrix product per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import functions as F

from .features import _Fitted


def gram_matrix(df, col: str) -> tuple[np.ndarray, int]:
    s = df.select(Summarizer.metrics("mean", "std", "count").summary(F.col(col)).alias("s")).first()["s"]
    n = int(s["count"])
    mu = s["mean"].toArray()
    sd = s["std"].toArray()
    r = Correlation.corr(df.select(col), col).first()[0].toArray()
    r = np.nan_to_num(r, nan=0.0)
    np.fill_diagonal(r, 1.0)
    d = np.diag(sd)
    return (n - 1) * d @ r @ d + n * np.outer(mu, mu), n


class TruncatedSVD(Estimator):
    """k = clamp(k, 1, d − 1) components, no centring."""

    def __init__(self, k: int = 256, inputCol: str = "features", outputCol: str = "svd"):
        super().__init__()
        self.k, self.inputCol, self.outputCol = int(k), inputCol, outputCol

    def _fit(self, df):
        g, _ = gram_matrix(df, self.inputCol)
        d = g.shape[0]
        k = max(1, min(self.k, d - 1)) if d > 1 else 1
        w, v = np.linalg.eigh(g)
        order = np.argsort(w)[::-1][:k]
        w, v = np.clip(w[order], 0.0, None), v[:, order]
        # deterministic sign: largest-magnitude loading of each component is positive
        signs = np.sign(v[np.argmax(np.abs(v), axis=0), range(v.shape[1])])
        v = v * np.where(signs == 0, 1.0, signs)
        comps = [[float(x) for x in v[:, j]] for j in range(v.shape[1])]
        return TruncatedSVDModel({"components": comps, "singular_values": [float(np.sqrt(x)) for x in w],
                                  "inputCol": self.inputCol, "outputCol": self.outputCol})


class TruncatedSVDModel(_Fitted):
    @property
    def k(self):
        return len(self.state["components"])

    def _transform(self, df):
        v = np.array(self.state["components"]).T

        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(list(np.stack(x.to_numpy()) @ v)) if len(x) else pd.Series([], dtype=object)

        out = F.pandas_udf(project, "array<double>")(vector_to_array(F.col(self.state["inputCol"])))
        return df.withColumn(self.state["outputCol"], array_to_vector(out))
