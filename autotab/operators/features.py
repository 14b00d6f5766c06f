"""Feature transforms as Spark ML Estimator / Model pairs.

Fitting is Spark aggregation; only fitted parameters (medians, λ, means,
category lists bounded by the high-cardinality threshold) reach the driver.
Large lookups (frequency maps, keep-sets) stay DataFrames and are joined with a
size-checked broadcast. Transforms are Column expressions, so they stay inside
whole-stage codegen and keep column names for explanations.
"""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..functions.cleaning import named, quoted
from ..functions.lookup import max_broadcast_bytes, null_safe_join, table_bytes
from ..session import cut_lineage
from ..functions.quantiles import medians, modes, multi_quantiles
from ..functions.ranking import range_rank
from .profile import at_least_distinct, categorical_columns, null_counts, numeric_columns

OTHER = "__OTHER__"
NA_TOKEN = "__NA__"


def _small(table: DataFrame, state: dict) -> bool:
    """Whether a fitted lookup may be broadcast: its size in bytes, taken once at fit time, is within bound."""
    return state.get("table_bytes", 1 << 62) <= max_broadcast_bytes(table.sparkSession)


def value_key(c: Column) -> Column:
    """Fixed-width key of a value's text (16 bytes, NULL stays NULL): lookups never move or hold whole texts."""
    return F.unhex(F.md5(c.cast("string")))


def key_of(df: DataFrame, c: str, keyed=()) -> Column:
    """The value key of a column; one of ``keyed`` that is binary holds such keys in place of its values."""
    return named(c) if c in keyed and df.schema[c].dataType == BinaryType() else value_key(named(c))


def value_rows(df: DataFrame, cols: list[str], keyed=()) -> DataFrame:
    """(column, value key) of every cell."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), key_of(df, c, keyed).alias("value")) for c in cols])).alias("e")).select("e.*")


class _Fitted(Model):
    """Model base: fitted state is plain Python data in ``state`` (JSON-serialisable)
    plus optional lookup DataFrames in ``tables``."""

    def __init__(self, state: dict | None = None, tables: dict | None = None):
        super().__init__()
        self.state = state or {}
        self.tables = tables or {}


# --- P10 missing indicators -------------------------------------------------

class MissingIndicatorsModel(_Fitted):
    def _transform(self, df):
        return df.select("*", *[named(c).isNull().cast("int").alias(f"MI__{c}") for c in self.state["cols"]
                                if c in df.columns])


class MissingIndicators(Estimator):
    """Adds ``MI__<c>`` (0/1) for every column that has NULLs in the training data."""

    def __init__(self, cols=None, exclude=()):
        super().__init__()
        self.cols, self.exclude = cols, tuple(exclude)

    def _fit(self, df):
        cols = [c for c in (self.cols or df.columns) if c not in self.exclude]
        nc = null_counts(df, cols).where("n_null > 0").collect()
        have = {r["column"] for r in nc}
        return MissingIndicatorsModel({"cols": [c for c in cols if c in have]})


# --- T1 ordinal mapping -----------------------------------------------------

class OrdinalMapper(_Fitted):
    """Per-column value → int lookups from configuration; unmapped values → NULL."""

    def __init__(self, mappings: dict | None = None):
        super().__init__({"mappings": {c: {str(k): int(v) for k, v in m.items()}
                                       for c, m in (mappings or {}).items()}})

    def _transform(self, df):
        out = df
        for c, m in self.state["mappings"].items():
            if c in df.columns and m:
                lut = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
                out = out.withColumn(c, lut[named(c).cast("string")])
        return out


# --- T2 frequency encoding --------------------------------------------------

class FrequencyEncoderModel(_Fitted):
    def _transform(self, df):
        out = df
        freq = self.tables.get("freq")
        for c in self.state["cols"]:
            if c not in df.columns:
                continue
            m = freq.where(F.col("column") == c).select(F.col("value").alias("__fv"), F.col("freq").alias("__ff"))
            out = null_safe_join(out.withColumn("__fv", key_of(out, c, self.state.get("keyed", ()))), m, ["__fv"], how="left", broadcast=_small(m, self.state))
            out = out.withColumn(c, F.coalesce("__ff", F.lit(0.0))).drop("__fv", "__ff")
        return out


class FrequencyEncoder(Estimator):
    """String columns with ≥ ``threshold`` distinct non-null values → relative frequency
    of their value in the training data (NULL counted as a value; unseen → 0.0). Columns of ``keyed`` may
    hold value keys in the training data and values or keys later."""

    def __init__(self, threshold: int = 40, exclude=(), cols=None, keyed=()):
        super().__init__()
        self.threshold, self.exclude, self.cols, self.keyed = threshold, tuple(exclude), cols, tuple(keyed)

    def _fit(self, df):
        cand = self.cols or [f.name for f in df.schema.fields
                             if (isinstance(f.dataType, StringType) or f.name in self.keyed) and f.name not in self.exclude]
        if not cand:
            return FrequencyEncoderModel({"cols": []}, {})
        many = at_least_distinct(df, cand, int(self.threshold))
        cols = [c for c in cand if many[c]]
        if not cols:
            return FrequencyEncoderModel({"cols": []}, {})
        n = df.count()
        long = value_rows(df, cols, self.keyed)
        # the fitted map is written to the shared checkpoint folder: scoring plans no
        # longer carry the training lineage, and a lost executor does not re-run the fit
        freq = cut_lineage(long.groupBy("column", "value").agg((F.count(F.lit(1)) / F.lit(float(n))).alias("freq")))
        return FrequencyEncoderModel({"cols": cols, "n": n, "table_bytes": table_bytes(freq), "keyed": list(self.keyed)}, {"freq": freq})


# --- T3 / T4 rare categories ------------------------------------------------

class RareCategoryGrouperModel(_Fitted):
    def _transform(self, df):
        out = df
        keep = self.tables["keep"]
        for c in self.state["cols"]:
            if c not in df.columns:
                continue
            k = keep.where(F.col("column") == c).select(F.col("value").alias("__kv"), F.lit(1).alias("__kk"))
            out = null_safe_join(out.withColumn("__kv", value_key(named(c))), k, ["__kv"], how="left", broadcast=_small(k, self.state))
            out = out.withColumn(c, F.when(F.col("__kk").isNull(), F.lit(OTHER)).otherwise(named(c))).drop("__kv", "__kk")
        return out


class RareCategoryGrouper(Estimator):
    """Keep a category when its count ≥ min_freq·n (min_freq < 1) or ≥ int(min_freq);
    everything else (NULL included, unless NULL itself is frequent) → ``__OTHER__``."""

    def __init__(self, min_freq: float = 0.01, cols=None):
        super().__init__()
        self.min_freq, self.cols = float(min_freq), cols

    def _fit(self, df):
        cols = self.cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
        n = df.count()
        bound = self.min_freq * n if self.min_freq < 1.0 else int(self.min_freq)
        long = value_rows(df, cols)
        keep = cut_lineage(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
                           .where(F.col("cnt") >= F.lit(bound)).select("column", "value"))
        return RareCategoryGrouperModel({"cols": cols, "bound": bound, "table_bytes": table_bytes(keep)}, {"keep": keep})


def collapse_rare_categories(df: DataFrame, col: str, min_freq: float = 0.01, min_count: int | None = None,
                             other_label: str = OTHER, out: str | None = None) -> DataFrame:
    """Values rarer than min_freq (or with count < min_count) → ``other_label``; NULLs stay NULL."""
    out = out or col
    n = df.count()
    vc = df.groupBy(F.col(col).cast("string").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    rare = (F.col("__c") < F.lit(min_count)) if min_count is not None else (F.col("__c") / F.lit(max(1, n)) < F.lit(min_freq))
    r = vc.where(rare & F.col("__v").isNotNull()).select("__v", F.lit(1).alias("__rare"))
    j = null_safe_join(df.withColumn("__v", F.col(col).cast("string")), r, ["__v"], how="left")
    return j.withColumn(out, F.when(F.col("__rare") == 1, F.lit(other_label)).otherwise(F.col(col))).drop("__v", "__rare")


# --- T5 / T6 hashing ----------------------------------------------------------

def auto_hash_columns(df: DataFrame, cols=None, min_len: float = 20.0, min_ratio: float = 0.5) -> DataFrame:
    """(column, avg_len, unique_ratio, hashed): text-like (mean length ≥ min_len, NULLs
    ignored) or near-unique (distinct share ≥ min_ratio) string columns."""
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)])
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs += [F.avg(F.length(named(c))).alias(f"__l{i}"), F.count_distinct(named(c)).alias(f"__d{i}")]
    a = df.agg(*aggs)
    long = a.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__l{i}").alias("avg_len"),
                                                        F.col(f"__d{i}").alias("nd")) for i, c in enumerate(cols)])).alias("e"))
    ur = F.col("e.nd") / F.greatest(F.col("__n"), F.lit(1))
    hashed = (F.coalesce(F.col("e.avg_len") >= F.lit(min_len), F.lit(False)) | (ur >= F.lit(min_ratio))).cast("int")
    return long.select("e.column", "e.avg_len", ur.alias("unique_ratio"), hashed.alias("hashed"))


class HashingEncoder(Estimator):
    """Hashing trick on ``column=value`` tokens (NULL → ``__NA__``) into ``n_features``
    unsigned buckets, with Spark's FeatureHasher (JVM-side)."""

    def __init__(self, cols=None, n_features: int = 512, output: str = "hash_features"):
        super().__init__()
        self.cols, self.n_features, self.output = cols, int(n_features), output

    def _fit(self, df):
        cols = self.cols
        if cols is None:
            cols = [r["column"] for r in auto_hash_columns(df).where("hashed = 1").collect()]
        return HashingEncoderModel({"cols": list(cols), "n_features": self.n_features, "output": self.output})


class HashingEncoderModel(_Fitted):
    def _transform(self, df):
        cols = self.state["cols"]
        if not cols:
            return df
        tmp = df.select("*", *[F.coalesce(named(c).cast("string"), F.lit(NA_TOKEN)).alias(f"__h_{c}") for c in cols])
        fh = FeatureHasher(inputCols=[f"__h_{c}" for c in cols], outputCol=self.state["output"],
                           numFeatures=self.state["n_features"])
        # FeatureHasher names tokens by input column; rename back so tokens read column=value
        out = fh.transform(tmp.select(*map(named, df.columns), *[named(f"__h_{c}") for c in cols]))
        return out.drop(*[f"__h_{c}" for c in cols])


# --- T8 / T9 imputation -----------------------------------------------------

class NumericImputer(Estimator):
    """Fill NULLs of numeric columns with the exact median (or mean / most_frequent / constant)."""

    def __init__(self, cols=None, strategy: str = "median", fill_value: float = 0.0):
        super().__init__()
        self.cols, self.strategy, self.fill_value = cols, strategy, fill_value

    def _fit(self, df):
        cols = list(self.cols if self.cols is not None else numeric_columns(df))
        if self.strategy == "median":
            vals = medians(df, cols) if cols else {}
        elif self.strategy == "mean":
            r = df.agg(*[F.avg(named(c).cast("double")).alias(c) for c in cols]).first() if cols else {}
            vals = {c: r[c] for c in cols}
        elif self.strategy == "most_frequent":
            vals = modes(df, cols)
        elif self.strategy == "constant":
            vals = {c: self.fill_value for c in cols}
        else:
            raise ValueError(f"unknown strategy {self.strategy}")
        return ImputerModel({"values": {c: (None if v is None else float(v)) for c, v in vals.items()},
                             "cast": "double"})


class CategoricalImputer(Estimator):
    """Fill NULLs of categorical columns with the most frequent value (ties → smallest)
    or a constant (``Missing``)."""

    def __init__(self, cols=None, strategy: str = "most_frequent", fill_value: str = "Missing"):
        super().__init__()
        self.cols, self.strategy, self.fill_value = cols, strategy, fill_value

    def _fit(self, df):
        cols = list(self.cols if self.cols is not None else categorical_columns(df))
        if self.strategy == "most_frequent":
            vals = modes(df, cols)
        else:
            vals = {c: self.fill_value for c in cols}
        return ImputerModel({"values": {c: (None if v is None else str(v)) for c, v in vals.items()},
                             "cast": "string"})


class ImputerModel(_Fitted):
    def _transform(self, df):
        t = self.state["cast"]
        repl = {}
        for c, v in self.state["values"].items():
            if c in df.columns:
                base = named(c).cast(t)
                repl[c] = base if v is None else F.coalesce(base, F.lit(v).cast(t))
        return df.withColumns(repl) if repl else df


# --- T10 Yeo-Johnson ----------------------------------------------------------

def yeo_johnson_expr(x, lam):
    """ψ_λ(x) as a Column expression; ``lam`` is a float or a Column.

    (1+x)^λ is written exp(λ·ln(1+x)) so that ln(1+|x|) is one common subexpression
    shared by every λ of a grid (Spark evaluates it once per row)."""
    lp = F.log1p(x)          # x >= 0 branch
    ln = F.log1p(-x)         # x < 0 branch
    if isinstance(lam, (int, float)):
        lam = float(lam)
        pos = lp if abs(lam) < 1e-12 else (F.exp(lp * F.lit(lam)) - 1) / F.lit(lam)
        neg = -ln if abs(lam - 2) < 1e-12 else -(F.exp(ln * F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    else:
        pos = F.when(F.abs(lam) < 1e-12, lp).otherwise((F.exp(lp * lam) - 1) / lam)
        neg = F.when(F.abs(lam - 2) < 1e-12, -ln).otherwise(-(F.exp(ln * (2 - lam)) - 1) / (2 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_sql(x: str, lam: float) -> str:
    """``yeo_johnson_expr`` of a number as SQL text: a grid is one text, not thousands of calls into the JVM."""
    lp, ln = f"log1p({x})", f"log1p(-({x}))"
    pos = lp if abs(lam) < 1e-12 else f"(exp({lp} * {lam!r}D) - 1) / {lam!r}D"
    neg = f"-{ln}" if abs(lam - 2) < 1e-12 else f"(-(exp({ln} * {2 - lam!r}D) - 1)) / {2 - lam!r}D"
    return f"CASE WHEN {x} >= 0 THEN {pos} ELSE {neg} END"


def default_lambda_grid(step: float = 0.1, lo: float = -2.0, hi: float = 2.0) -> list[float]:
    k = int(round((hi - lo) / step))
    return [round(lo + i * step, 10) for i in range(k + 1)]


def yeo_johnson_loglik(df: DataFrame, cols: list[str], grid) -> DataFrame:
    """(column, lambda, loglik) for every λ on the grid, see ``yeo_johnson_logliks``."""
    return df.sparkSession.createDataFrame(yeo_johnson_logliks(df, cols, grid), "column string, lambda double, loglik double")


def yeo_johnson_logliks(df: DataFrame, cols: list[str], grid) -> list[tuple[str, float, float | None]]:
    """(column, lambda, loglik) for every λ on the grid:
    −n/2·ln(var_pop(ψ_λ)) + (λ−1)·Σ sign(x)·ln(1+|x|).

    Per row, ψ_λ(x) for the whole grid is one vector of generated expressions (sharing
    ln(1+|x|)); the per-λ variances come from ``Summarizer`` over that vector in a single
    pass, so rows are not multiplied by the grid size. ``grid`` is one list for all
    columns or a dict column → list."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    per_col = grid if isinstance(grid, dict) else {c: grid for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        x = named(c).cast("double")
        ok = x.isNotNull() & ~F.isnan(x)
        psi = F.when(ok, array_to_vector(F.expr(f"array({', '.join(yeo_johnson_sql(f'CAST({quoted(c)} AS DOUBLE)', float(v)) for v in per_col[c])})")))
        aggs += [Summarizer.metrics("variance", "count").summary(psi).alias(f"__m{i}"),
                 F.sum(F.when(ok, F.signum(x) * F.log1p(F.abs(x)))).alias(f"__s{i}")]
    r = df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(cols):
        m = r[f"__m{i}"]
        n = int(m["count"]) if m is not None else 0
        var = m["variance"].toArray() if m is not None and n > 0 else []
        ssum = r[f"__s{i}"] or 0.0
        for j, lam in enumerate(per_col[c]):
            v = float(var[j]) * (n - 1) / n if n > 1 else 0.0   # sample → population variance
            ll = (-n / 2 * math.log(v) + (lam - 1) * ssum) if v > 0 else None
            rows.append((c, float(lam), ll))
    return rows


def best_lambdas(logliks: list[tuple[str, float, float | None]]) -> dict[str, float]:
    """λ of the greatest likelihood (ties: the greater λ) of every column that has one."""
    best: dict[str, tuple[float, float]] = {}
    for c, lam, ll in logliks:
        if ll is not None:
            best[c] = max(best.get(c, (-math.inf, -math.inf)), (ll, lam))
    return {c: lam for c, (_, lam) in best.items()}


class YeoJohnson(Estimator):
    """Per-column Yeo-Johnson λ by maximum likelihood over a grid (optionally refined once
    around the best point), then standardisation with population std. Constant → λ = 1."""

    def __init__(self, cols=None, grid=None, refine: bool = True, standardize: bool = True):
        super().__init__()
        self.cols, self.grid, self.refine, self.standardize = cols, grid, refine, standardize

    def _fit(self, df):
        cols = list(self.cols if self.cols is not None else numeric_columns(df))
        grid = self.grid or default_lambda_grid()
        lams = {}
        if cols:
            lams = {c: 1.0 for c in cols} | best_lambdas(yeo_johnson_logliks(df, cols, grid))
            if self.refine:
                step = (grid[1] - grid[0]) if len(grid) > 1 else 0.1
                fine = {c: [lams[c] + step * (k - 10) / 10 for k in range(21)] for c in cols}
                lams |= best_lambdas(yeo_johnson_logliks(df, cols, fine))
        stats = {}
        if self.standardize and cols:
            r = df.agg(*[x for i, c in enumerate(cols) for x in (
                F.avg(yeo_johnson_expr(named(c).cast("double"), lams[c])).alias(f"m{i}"),
                F.stddev_pop(yeo_johnson_expr(named(c).cast("double"), lams[c])).alias(f"s{i}"))]).first()
            stats = {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)}
        return YeoJohnsonModel({"lambdas": lams, "stats": stats})


class YeoJohnsonModel(_Fitted):
    def _transform(self, df):
        repl = {}
        for c, lam in self.state["lambdas"].items():
            if c not in df.columns:
                continue
            e = yeo_johnson_expr(named(c).cast("double"), lam)
            if c in self.state["stats"]:
                m, s = self.state["stats"][c]
                s = 1.0 if not s else s
                e = (e - F.lit(m if m is not None else 0.0)) / F.lit(s)
            repl[c] = e
        return df.withColumns(repl) if repl else df


# --- T11 / T12 scaling and variance ------------------------------------------

class StandardScalerPop(Estimator):
    """(x − mean) / population std; zero variance divides by 1."""

    def __init__(self, cols=None):
        super().__init__()
        self.cols = cols

    def _fit(self, df):
        cols = list(self.cols if self.cols is not None else numeric_columns(df))
        if not cols:
            return ScalerModel({"stats": {}})
        r = df.agg(*[x for i, c in enumerate(cols) for x in (F.avg(named(c).cast("double")).alias(f"m{i}"),
                                                               F.stddev_pop(named(c).cast("double")).alias(f"s{i}"))]).first()
        return ScalerModel({"stats": {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)}})


class ScalerModel(_Fitted):
    def _transform(self, df):
        repl = {}
        for c, (m, s) in self.state["stats"].items():
            if c in df.columns:
                repl[c] = (named(c).cast("double") - F.lit(m if m is not None else 0.0)) / F.lit(s if s else 1.0)
        return df.withColumns(repl) if repl else df


def column_variances(df: DataFrame, cols: list[str]) -> dict[str, float]:
    r = df.agg(*[F.var_pop(named(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return {c: r[f"v{i}"] for i, c in enumerate(cols)}


class VarianceFilter(Estimator):
    """Keep numeric columns whose population variance is > threshold."""

    def __init__(self, cols=None, threshold: float = 0.0):
        super().__init__()
        self.cols, self.threshold = cols, threshold

    def _fit(self, df):
        cols = list(self.cols if self.cols is not None else numeric_columns(df))
        v = column_variances(df, cols) if cols else {}
        drop = [c for c in cols if v[c] is None or not v[c] > self.threshold]
        return DropColumnsModel({"drop": drop, "variances": v})


class DropColumnsModel(_Fitted):
    def _transform(self, df):
        return df.drop(*[c for c in self.state["drop"] if c in df.columns])


# --- T13 / T14 categorical encodings ------------------------------------------

def _categories(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column: one name per output column, as many as there are."""
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value"))
                                         for c in cols])).alias("e")).select("e.*").where(F.col("value").isNotNull())
    rows = long.groupBy("column").agg(F.array_sort(F.collect_set("value")).alias("vals")).collect()
    out = {r["column"]: list(r["vals"]) for r in rows}
    return {c: out.get(c, []) for c in cols}


class OneHot(Estimator):
    """One 0/1 column ``<c>=<value>`` per sorted training category; unknown → all zeros."""

    def __init__(self, cols=None):
        super().__init__()
        self.cols = cols

    def _fit(self, df):
        cols = list(self.cols if self.cols is not None else categorical_columns(df))
        return OneHotModel({"categories": _categories(df, cols)})


class OneHotModel(_Fitted):
    def output_columns(self):
        return [f"{c}={v}" for c, vs in self.state["categories"].items() for v in vs]

    def _transform(self, df):
        cats = self.state["categories"]
        # as SQL text: one call into the JVM, not ten a category; values stand in it by their bytes
        new = [f"coalesce(CAST(CAST({quoted(c)} AS STRING) = CAST(X'{v.encode().hex()}' AS STRING) AS DOUBLE), 0.0D) AS {quoted(f'{c}={v}')}" for c, vs in cats.items() for v in vs]
        return df.selectExpr(*[quoted(c) for c in df.columns if c not in cats], *new)


def category_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value key, code): training categories of every column in sorted order as 0 .. K-1, ranked by many tasks."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("text")) for c in cols])).alias("e")).select("e.*")
    ranked = range_rank(long.where(F.col("text").isNotNull()).distinct(), ["column"], ["text"], out="code")
    return cut_lineage(ranked.select("column", value_key(F.col("text")).alias("value"), F.col("code").cast("double").alias("code")))


class SparseOneHot(Estimator):
    """One-hot of columns with any number of categories: the category index is a table, every row gets one sparse vector a
    column (``<c>__onehot``); unknown and NULL → all zeros. Nothing but the number of categories reaches the driver."""

    def __init__(self, cols=None):
        super().__init__()
        self.cols = cols

    def _fit(self, df):
        cols = list(self.cols if self.cols is not None else categorical_columns(df))
        if not cols:
            return SparseOneHotModel({"cols": [], "sizes": []})
        codes = category_codes(df, cols)
        sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        return SparseOneHotModel({"cols": cols, "sizes": [int(sizes.get(c, 0)) for c in cols], "table_bytes": table_bytes(codes)}, {"codes": codes})


class SparseOneHotModel(_Fitted):
    def output_columns(self) -> list[str]:
        return [f"{c}__onehot" for c in self.state["cols"]]

    def feature_names(self) -> list[str]:
        """``<c>[slot]`` by sorted category."""
        return [f"{c}[{i}]" for c, n in zip(self.state["cols"], self.state["sizes"], strict=True) for i in range(n)]

    def _transform(self, df):
        out = df
        for c, n, vec in zip(self.state["cols"], self.state["sizes"], self.output_columns(), strict=True):
            m = self.tables["codes"].where(F.col("column") == c).select(F.col("value").alias("__ov"), F.col("code").alias("__oc"))
            out = null_safe_join(out.withColumn("__ov", value_key(named(c))), m, ["__ov"], how="left", broadcast=_small(m, self.state))
            # one slot more for what is unknown; the encoder drops the last one
            out = out.withColumn("__oc", F.coalesce("__oc", F.lit(float(n))))
            encoder = OneHotEncoder(inputCols=["__oc"], outputCols=[vec], dropLast=True).fit(df.sparkSession.createDataFrame([(float(max(n, 1)),)], "__oc double"))
            out = encoder.transform(out).drop("__ov", "__oc")
        return out.drop(*[c for c in self.state["cols"] if c in df.columns])


class OrdinalEncode(Estimator):
    """Sorted training categories → 0..K-1 (as double); unknown → −1. The codes are a fitted table."""

    def __init__(self, cols=None):
        super().__init__()
        self.cols = cols

    def _fit(self, df):
        cols = list(self.cols if self.cols is not None else categorical_columns(df))
        if not cols:
            return OrdinalEncodeModel({"cols": []})
        codes = category_codes(df, cols)
        return OrdinalEncodeModel({"cols": cols, "table_bytes": table_bytes(codes)}, {"codes": codes})


class OrdinalEncodeModel(_Fitted):
    def _transform(self, df):
        out = df
        for c in self.state["cols"]:
            if c not in df.columns:
                continue
            m = self.tables["codes"].where(F.col("column") == c).select(F.col("value").alias("__ov"), F.col("code").alias("__oc"))
            out = null_safe_join(out.withColumn("__ov", value_key(named(c))), m, ["__ov"], how="left", broadcast=_small(m, self.state))
            out = out.withColumn(c, F.coalesce("__oc", F.lit(-1.0))).drop("__ov", "__oc")
        return out


# --- T16 mutual information ---------------------------------------------------

def bin_expressions(df: DataFrame, cols: list[str], n_bins: int = 10) -> dict:
    """MI bin per column: the value itself (as text) for non-numeric columns or ≤ n_bins
    distinct values, else the number of inner decile edges strictly below the value.
    Distinct counts and all decile edges come from shared scans."""
    nums = [c for c in numeric_columns(df) if c in set(cols)]
    wide = at_least_distinct(df, nums, n_bins + 1)
    cont = [c for c in cols if wide.get(c)]
    edges = multi_quantiles(df, cont, [i / n_bins for i in range(1, n_bins)]) if cont else {}
    out = {}
    for c in cols:
        if c not in edges:
            out[c] = named(c).cast("string")
            continue
        x = named(c).cast("double")
        b = sum((F.when(x > F.lit(e), 1).otherwise(0) for e in edges[c]), F.lit(0))
        out[c] = F.when(x.isNull(), F.lit(None).cast("string")).otherwise(b.cast("string"))
    return out


def mutual_information(df: DataFrame, features: list[str], target: str, task: str = "classification",
                       n_bins: int = 10) -> DataFrame:
    """(feature, mi): Σ p_xy·ln(p_xy / (p_x·p_y)) over (bin, target) cells, all features in
    one unpivot + aggregate. Continuous features (and a regression target) use decile bins."""
    exprs = bin_expressions(df, features + ([target] if task != "classification" else []), n_bins)
    ty = F.col(target).cast("string") if task == "classification" else exprs[target]
    base = df.select(ty.alias("__y"), *[exprs[c].alias(f"__b_{i}") for i, c in enumerate(features)])
    long = base.select("__y", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__b_{i}").alias("b"))
                                                   for i, c in enumerate(features)])).alias("e")).select("e.feature", "e.b", "__y")
    n = df.count()
    cell = long.groupBy("feature", "b", "__y").agg(F.count(F.lit(1)).alias("nxy"))
    px = cell.groupBy("feature", "b").agg(F.sum("nxy").alias("nx"))
    py = cell.where(F.col("feature") == features[0]).groupBy("__y").agg(F.sum("nxy").alias("ny"))
    j = null_safe_join(null_safe_join(cell, px, ["feature", "b"], how="inner"), py, ["__y"], how="inner")
    term = F.col("nxy") / F.lit(float(n)) * F.log(F.col("nxy") * F.lit(float(n)) / (F.col("nx") * F.col("ny")))
    return j.groupBy("feature").agg(F.sum(term).alias("mi"))


def select_k_best_mi(df: DataFrame, features: list[str], target: str, k: int, task: str = "classification", estimator: str = "binned") -> DataFrame:
    """Top-k features by mutual information (ties by name): (feature, mi, rank). ``estimator``: "binned", or "knn" (nearest
    neighbours; numeric features and classes)."""
    if estimator == "knn" and task == "classification":
        from .mutual import mutual_information_knn
        mi = mutual_information_knn(df, features, target)
    else:
        mi = mutual_information(df, features, target, task)
    # one row per feature: the ranking window runs over d rows
    w = Window.orderBy(F.col("mi").desc(), F.col("feature"))
    return mi.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def auto_k(n_features: int, rounding: str = "trunc", least: int = 10, most: int = 80) -> int:
    """0.6·d (truncated or rounded half to even) within [least, most]."""
    if n_features <= 0:
        return least
    v = n_features * 0.6
    v = int(v) if rounding == "trunc" else int(round(v))
    return min(max(least, v), most)


def clamp_k(k: int, d: int) -> int:
    return max(1, d - 1) if k >= d else k


def assemble(df: DataFrame, cols: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=output, handleInvalid="keep").transform(df)
