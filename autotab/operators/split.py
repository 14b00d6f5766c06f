"""Folds, train/validation splits and exact-size samples.

Every assignment hangs on ``md5(key#seed)``; ranks inside a class come from
``hash_rank`` (hash-range buckets + offsets), so even a class holding most of
the rows is ranked by many tasks, and the result is reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import row_hash
from ..functions.ranking import hash_rank


def _ranked(df: DataFrame, key: list[str], seed: int, by: list[str] | None, size_col: str | None = None):
    d = df.withColumn("__h", row_hash(*key, seed=seed))
    return hash_rank(d, "__h", key, by=by, out="__rank", size_col=size_col)


def stratified_folds(df: DataFrame, label: str, key: list[str], k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """fold = (rank within class by md5(key#seed)) mod k: class counts per fold differ by ≤ 1."""
    r = _ranked(df, key, seed, [label])
    return r.withColumn(out, (F.col("__rank") % k).cast("int")).drop("__h", "__rank")


def kfold(df: DataFrame, key: list[str], k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """fold = (global rank by md5(key#seed)) mod k: fold sizes differ by ≤ 1."""
    r = _ranked(df, key, seed, None)
    return r.withColumn(out, (F.col("__rank") % k).cast("int")).drop("__h", "__rank")


def stratified_split(df: DataFrame, label: str, key: list[str], valid_frac: float = 0.2, seed: int = 42,
                     out: str = "is_valid") -> DataFrame:
    """Per class, the first ceil(valid_frac·n_class) rows in md5 order are validation rows."""
    r = _ranked(df, key, seed, [label], size_col="__n")
    return (r.withColumn(out, (F.col("__rank") < F.ceil(F.col("__n") * F.lit(float(valid_frac)))).cast("int"))
             .drop("__h", "__rank", "__n"))


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows: the first n by md5(key#seed). Spark plans it as a top-n, so each task
    passes on n rows at most."""
    return df.withColumn("__h", row_hash(*key, seed=seed)).orderBy("__h", *key).limit(n).drop("__h")
