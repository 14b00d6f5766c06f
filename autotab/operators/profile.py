"""Dataset profiling: NULLs, cardinality, roles, skew, correlation, imbalance, weights.

Every statistic over many columns is computed in one aggregate over the table
(one scan), then reshaped; only the small per-column result reaches the driver.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DateType, DecimalType, DoubleType, FloatType,
                               IntegerType, LongType, ShortType, StringType,
                               TimestampNTZType, TimestampType)

from ..functions.cleaning import named
from ..functions.lookup import null_safe_join
from ..functions.ranking import top_n_per_group

# Default name patterns of ID-like columns and name hints of group-like columns.
ID_PATTERNS = ["id", "folio", "uuid", "guid", "numero", "account", "cuenta", "no_", "no.",
               "número", "id_", "_id"]
GROUP_HINTS = ["group", "segment", "categoria", "category", "cluster", "tipo", "type"]

NUMERIC_TYPES = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric (not boolean) columns, as the reference's np.number test."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    nums = set(numeric_columns(df))
    return [c for c in df.columns if c not in nums and c not in exclude]


def _long(row, cols, prefix):
    return {c: row[f"{prefix}{i}"] for i, c in enumerate(cols)}


def _small_frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- NULL profile -----------------------------------------------------------

def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """(column, n_null, null_frac) for every column, from one aggregate."""
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(named(c).isNull().cast("long")).alias(f"__c{i}") for i, c in enumerate(cols)])
    long = agg.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                          F.col(f"__c{i}").alias("n_null"))
                                                 for i, c in enumerate(cols)])).alias("e"))
    return long.select("e.column", F.col("e.n_null").cast("long").alias("n_null"),
                       F.when(F.col("__n") == 0, F.lit(None).cast("double"))
                        .otherwise(F.col("e.n_null") / F.col("__n")).alias("null_frac"))


def profile_nulls(df: DataFrame, topn: int = 10) -> DataFrame:
    """Top-n columns by NULL count (only columns with NULLs; ties by name)."""
    return (null_counts(df).where(F.col("n_null") > 0)
            .orderBy(F.col("n_null").desc(), F.col("column")).limit(topn))


def sparse_columns(df: DataFrame, target: str | None = None, threshold: float = 0.95) -> DataFrame:
    """NULL fraction per non-target column and whether it exceeds ``threshold`` (→ dropped)."""
    cols = [c for c in df.columns if c != target]
    return null_counts(df, cols).select("column", "null_frac",
                                        (F.col("null_frac") > F.lit(threshold)).cast("int").alias("dropped"))


def drop_sparse(df: DataFrame, target: str | None = None, threshold: float = 0.95):
    drop = [r["column"] for r in sparse_columns(df, target, threshold).where("dropped = 1").collect()]
    return df.drop(*drop), drop


# --- values -------------------------------------------------------------------

def value_counts(df: DataFrame, cols: list[str], dropna: bool = True) -> DataFrame:
    """(column, value, count) with values rendered as text; combined map-side per value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                  named(c).cast("string").alias("value"))
                                         for c in cols])).alias("e")).select("e.*")
    if dropna:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def profile_top_values(df: DataFrame, cols=None, topn: int = 10) -> DataFrame:
    """Top-n most frequent non-null values per column (ties by value)."""
    cols = list(cols or df.columns)
    vc = value_counts(df, cols)
    return top_n_per_group(vc, ["column"], [F.col("count").desc(), F.col("value")], topn,
                           spread_col="value")


def distinct_counts(df: DataFrame, cols: list[str], with_null: bool = False) -> DataFrame:
    """(column, n_distinct[, has_null]) from one aggregate."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs.append(F.count_distinct(named(c)).alias(f"__d{i}"))
        aggs.append(F.max(named(c).isNull().cast("int")).alias(f"__z{i}"))
    a = df.agg(*aggs)
    long = a.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                        F.col(f"__d{i}").alias("nd"),
                                                        F.col(f"__z{i}").alias("z"))
                                               for i, c in enumerate(cols)])).alias("e"))
    nd = F.col("e.nd") + (F.coalesce(F.col("e.z"), F.lit(0)) if with_null else F.lit(0))
    return long.select("e.column", nd.cast("long").alias("n_distinct"), F.col("__n").alias("n_rows"))


def at_least_distinct(df: DataFrame, cols: list[str], threshold: int, with_null: bool = False) -> dict[str, bool]:
    """Whether each column has ``threshold`` distinct values or more. One sketch aggregate settles the columns
    far from the threshold without shuffling a value; only those near it are counted, and they have few values."""
    if not cols:
        return {}
    r = df.agg(*[F.approx_count_distinct(named(c)).alias(f"d{i}") for i, c in enumerate(cols)],
               *[F.max(named(c).isNull().cast("int")).alias(f"z{i}") for i, c in enumerate(cols)]).first()
    need = {c: threshold - (int(r[f"z{i}"] or 0) if with_null else 0) for i, c in enumerate(cols)}
    out = {c: r[f"d{i}"] > 2 * threshold + 20 for i, c in enumerate(cols)}
    near = [c for c in cols if not out[c]]
    if near:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value")) for c in near])).alias("e")).select("e.*")
        n = {x["column"]: x["n"] for x in long.where(F.col("value").isNotNull()).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        out.update({c: n.get(c, 0) >= need[c] for c in near})
    return out


def id_like_columns(df: DataFrame, patterns=None, ratio: float = 0.9) -> DataFrame:
    """Columns whose name matches a pattern (case-insensitive search) and whose
    distinct share exceeds ``ratio``: (column, n_distinct, unique_ratio, is_id)."""
    patterns = ID_PATTERNS if patterns is None else patterns
    spark = df.sparkSession
    if not patterns:
        return _small_frame(spark, [], "column string, n_distinct long, unique_ratio double, is_id int")
    rx = re.compile("|".join(re.escape(p) for p in patterns), re.IGNORECASE)
    matched = [c for c in df.columns if rx.search(c)]
    if not matched:
        return _small_frame(spark, [], "column string, n_distinct long, unique_ratio double, is_id int")
    d = distinct_counts(df, matched)
    ur = F.col("n_distinct") / F.greatest(F.col("n_rows"), F.lit(1))
    return d.select("column", "n_distinct", ur.alias("unique_ratio"), (ur > F.lit(ratio)).cast("int").alias("is_id"))


def column_roles(df: DataFrame, exclude=()) -> DataFrame:
    """(column, kind, role): numeric columns are 'binary' (prefix MI__ or ≤2 distinct
    non-null values) or 'continuous'; everything else is 'categorical'."""
    spark = df.sparkSession
    nums = numeric_columns(df, exclude)
    cats = categorical_columns(df, exclude)
    rows = [(c, "categorical", "categorical") for c in cats]
    if nums:
        wide = at_least_distinct(df, nums, 3)
        for c in nums:
            rows.append((c, "numeric", "binary" if c.startswith("MI__") or not wide[c] else "continuous"))
    return _small_frame(spark, rows, "column string, kind string, role string")


# Fixed value: ISO-like date/time text accepted by the date detector.
DATE_TEXT = r"^\s*\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"
CLOCK = r"([ T]\d{1,2}:\d{2}(:\d{2})?)?$"
#: Date grammars: name, shape of the trimmed text, pattern of its day (None: a number of seconds or milliseconds).
DATE_GRAMMARS = [
    ("y-m-d", r"^\d{4}-\d{1,2}-\d{1,2}" + CLOCK, "y-M-d"), ("y/m/d", r"^\d{4}/\d{1,2}/\d{1,2}" + CLOCK, "y/M/d"), ("y.m.d", r"^\d{4}\.\d{1,2}\.\d{1,2}" + CLOCK, "y.M.d"),
    ("d/m/y", r"^\d{1,2}/\d{1,2}/\d{4}" + CLOCK, "d/M/y"), ("m/d/y", r"^\d{1,2}/\d{1,2}/\d{4}" + CLOCK, "M/d/y"),
    ("d-m-y", r"^\d{1,2}-\d{1,2}-\d{4}" + CLOCK, "d-M-y"), ("m-d-y", r"^\d{1,2}-\d{1,2}-\d{4}" + CLOCK, "M-d-y"), ("d.m.y", r"^\d{1,2}\.\d{1,2}\.\d{4}" + CLOCK, "d.M.y"),
    ("d mon y", r"^\d{1,2}[ -][A-Z][a-z]{2}[ -]\d{4}" + CLOCK, "d MMM y"), ("d month y", r"^\d{1,2} [A-Z][a-z]{3,8} \d{4}" + CLOCK, "d MMMM y"),
    ("mon d, y", r"^[A-Z][a-z]{2} \d{1,2},? \d{4}" + CLOCK, "MMM d y"), ("month d, y", r"^[A-Z][a-z]{3,8} \d{1,2},? \d{4}" + CLOCK, "MMMM d y"),
    ("ymd", r"^(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$", "yyyyMMdd"), ("epoch s", r"^[1-9]\d{8,9}$", None), ("epoch ms", r"^[1-9]\d{11,12}$", None)]


def _parses(c: Column, shape: str, pattern: str | None) -> Column:
    text = F.trim(c)
    if pattern is None:
        return text.rlike(shape)
    # the clock is checked by its shape and range, the day by the calendar
    day = F.regexp_replace(F.regexp_replace(text, r"[ T]\d{1,2}:\d{2}(:\d{2})?$", ""), r"(?<=[A-Za-z])-|-(?=[A-Za-z])|, ?", " ")
    clock = F.regexp_extract(text, r"[ T](\d{1,2}):(\d{2})(:(\d{2}))?$", 1)
    return text.rlike(shape) & F.try_to_timestamp(day, F.lit(pattern)).isNotNull() & ((clock == "") | (clock.try_cast("int") < 24))


def date_formats(df: DataFrame, cols=None) -> DataFrame:
    """(column, format, parsed_frac): the grammar that parses the largest share of a text column's non-null values (ties to
    the earlier one); one aggregate for all columns and grammars."""
    texts = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)])
    grammars = [("iso", lambda c: c.rlike(DATE_TEXT) & F.try_to_timestamp(F.trim(c)).isNotNull())]
    grammars += [(name, lambda c, shape=shape, pattern=pattern: _parses(c, shape, pattern)) for name, shape, pattern in DATE_GRAMMARS]
    rows = []
    if texts:
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), named(c).alias("v")) for i, c in enumerate(texts)])).alias("e")).select("e.*").where(F.col("v").isNotNull())
        for r in cells.groupBy("i").agg(*[F.avg(F.coalesce(ok(F.col("v")), F.lit(False)).cast("double")).alias(f"p{j}") for j, (_, ok) in enumerate(grammars)]).orderBy("i").collect():
            shares = [r[f"p{j}"] for j in range(len(grammars))]
            j = max(range(len(shares)), key=lambda j: (shares[j], -j))
            rows.append((texts[r["i"]], grammars[j][0], float(shares[j])))
    return _small_frame(df.sparkSession, rows, "column string, format string, parsed_frac double")


def date_columns(df: DataFrame, share: float = 0.8) -> DataFrame:
    """(column, parsed_frac, is_date): timestamp/date columns, or string columns where one date grammar parses more than
    ``share`` of all non-null values."""
    kinds = (TimestampType, TimestampNTZType, DateType)
    rows = [(f.name, 1.0, 1) for f in df.schema.fields if isinstance(f.dataType, kinds)]
    rows += [(r["column"], r["parsed_frac"], int(r["parsed_frac"] > share)) for r in date_formats(df).collect()]
    return _small_frame(df.sparkSession, rows, "column string, parsed_frac double, is_date int")


def group_like_columns(df: DataFrame, hints=None, max_ratio: float = 0.5) -> DataFrame:
    """(column, unique_ratio, is_group): distinct share ≤ max_ratio and a hint in the name."""
    hints = GROUP_HINTS if hints is None else hints
    d = distinct_counts(df, df.columns)
    ur = F.col("n_distinct") / F.col("n_rows")
    hinted = F.lit(False)
    for h in hints:
        hinted = hinted | F.lower(F.col("column")).contains(h)
    return d.where(F.col("n_rows") > 0).select(
        "column", ur.alias("unique_ratio"), ((ur <= F.lit(max_ratio)) & hinted).cast("int").alias("is_group"))


# --- target -------------------------------------------------------------------

def detect_task(df: DataFrame, target: str, override: str | None = None, max_classes: int = 20) -> str:
    """classification iff the target has ≤ max_classes distinct non-null values."""
    if override in ("classification", "regression"):
        return override
    return "regression" if at_least_distinct(df, [target], max_classes + 1)[target] else "classification"


def detect_task_relative(df: DataFrame, target: str, override: str | None = None) -> str:
    """Non-numeric → classification; numeric → classification iff distinct ≤ max(20, int(0.05·n))."""
    if override in ("classification", "regression"):
        return override
    f = df.schema[target]
    if not isinstance(f.dataType, NUMERIC_TYPES):
        return "classification"
    r = df.agg(F.count_distinct(named(target)).alias("d"), F.count(F.lit(1)).alias("n")).first()
    return "classification" if r["d"] <= max(20, int(0.05 * r["n"])) else "regression"


def task_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_distinct, n_rows, task, task_relative) for several candidate targets, one scan."""
    d = distinct_counts(df, cols)
    types = {f.name: isinstance(f.dataType, NUMERIC_TYPES) for f in df.schema.fields}
    numeric = F.col("column").isin(*[c for c in cols if types[c]]) if any(types[c] for c in cols) else F.lit(False)
    rel = F.when(~numeric, "classification").when(
        F.col("n_distinct") <= F.greatest(F.lit(20), F.floor(F.col("n_rows") * 0.05)), "classification"
    ).otherwise("regression")
    return d.select("column", "n_distinct", "n_rows",
                    F.when(F.col("n_distinct") <= 20, "classification").otherwise("regression").alias("task"),
                    rel.alias("task_relative"))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(label, n) with NULL counted as its own class."""
    return df.groupBy(named(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """(n_classes, ratio, pos_rate): ratio = largest / smallest class; pos_rate is the
    minority share for two classes, the majority share otherwise (one class: 1.0, 1.0)."""
    c = class_counts(df, target)
    a = c.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("mx"), F.min("n").alias("mn"),
              F.sum("n").alias("tot"))
    ratio = F.when(F.col("k") < 2, 1.0).otherwise(F.col("mx") / F.col("mn"))
    pos = (F.when(F.col("k") < 2, 1.0).when(F.col("k") == 2, F.col("mn") / F.col("tot"))
            .otherwise(F.col("mx") / F.col("tot")))
    return a.select(F.col("k").cast("long").alias("n_classes"), ratio.alias("ratio"), pos.alias("pos_rate"))


def balanced_weights(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """Per-row weight n / (K · n_class) joined from the (small) class-count table."""
    c = class_counts(df, target)
    tot = c.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("K")).first()
    w = c.select(F.col("label").alias(target), (F.lit(float(tot["N"])) / (F.lit(float(tot["K"])) * F.col("n"))).alias(out))
    return null_safe_join(df, w, [target], how="left")


# --- numeric shape ------------------------------------------------------------

def skewness(df: DataFrame, cols=None, threshold: float = 1.0) -> DataFrame:
    """(column, skew, skewed): bias-adjusted sample skewness (pandas/DuckDB definition);
    constant columns give 0; fewer than 3 values give NULL."""
    cols = list(cols or numeric_columns(df))
    aggs = []
    for i, c in enumerate(cols):
        x = named(c).cast("double")
        aggs += [F.skewness(x).alias(f"__s{i}"), F.count(x).alias(f"__n{i}"), F.var_pop(x).alias(f"__v{i}")]
    a = df.agg(*aggs)
    long = a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__s{i}").alias("g"),
                                                 F.col(f"__n{i}").cast("double").alias("n"),
                                                 F.col(f"__v{i}").alias("v"))
                                        for i, c in enumerate(cols)])).alias("e")).select("e.*")
    adj = F.col("g") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2)
    sk = (F.when(F.col("n") < 3, F.lit(None).cast("double")).when(F.col("v") == 0, F.lit(0.0))
           .otherwise(adj))
    return long.select("column", sk.alias("skew"),
                       (sk.isNotNull() & (F.abs(sk) >= F.lit(threshold))).cast("int").alias("skewed"))


def high_card_columns(df: DataFrame, cols=None, threshold: int = 50) -> DataFrame:
    """(column, n_distinct, high_card): distinct values counting NULL as one, ≥ threshold."""
    cols = list(cols or categorical_columns(df))
    d = distinct_counts(df, cols, with_null=True)
    return d.select("column", "n_distinct", (F.col("n_distinct") >= F.lit(threshold)).cast("int").alias("high_card"))


#: Columns of a block of the correlation matrix.
CORR_BLOCK = 128


def correlation_matrix(df: DataFrame, cols=None) -> DataFrame:
    """Pairwise-complete Pearson correlations (col_a, col_b, corr) of numeric columns; NULL where fewer than two rows hold both
    or one of them does not vary. The plan does not grow with the columns: rows become arrays, tasks add up products of column
    blocks with their NULL masks, block pairs are added up by key and finished where they meet."""
    cols = list(cols or numeric_columns(df))
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    d, size, schema = len(cols), CORR_BLOCK, "i int, j int, v binary"
    rows = df.select(F.array(*[F.coalesce(named(c).cast("double"), F.lit(math.nan)) for c in cols]).alias("x"))
    # values are moved by their column's mean, so that sums of squares keep their digits
    some = rows.select(F.posexplode("x").alias("i", "v")).where(~F.isnan("v")).groupBy("i").agg(F.avg("v").alias("m"))
    middle = np.zeros(d)
    for r in some.collect():
        middle[r["i"]] = r["m"]
    starts = range(0, d, size)

    def add(batches):
        sums = {}
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - middle
            m = np.isfinite(x).astype(float)
            x = np.where(m > 0, x, 0.0)
            for i in starts:
                for j in starts:
                    if j >= i:
                        a, n, c, o = x[:, i:i + size], m[:, i:i + size], x[:, j:j + size], m[:, j:j + size]
                        v = np.stack([n.T @ o, a.T @ o, n.T @ c, a.T @ c, (a * a).T @ o, n.T @ (c * c)])
                        sums[i, j] = sums[i, j] + v if (i, j) in sums else v
        for (i, j), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([v.tobytes()])], names=["i", "j", "v"])

    def finish(batches):
        sums = {}
        for b in batches:
            for r in b.to_pylist():
                v = np.frombuffer(r["v"])
                key = r["i"], r["j"]
                sums[key] = sums[key] + v if key in sums else v
        for (i, j), v in sums.items():
            n, sa, sc, ac, aa, cc = v.reshape(6, min(size, d - i), -1)
            with np.errstate(divide="ignore", invalid="ignore"):
                va, vc = aa - sa * sa / n, cc - sc * sc / n
                corr = (ac - sa * sc / n) / np.sqrt(va * vc)
            corr = np.where((n > 1) & (va > 1e-12 * (aa + 1e-300)) & (vc > 1e-12 * (cc + 1e-300)), np.clip(corr, -1, 1), np.nan)
            p, q = (z.ravel() for z in np.indices(corr.shape))
            value = np.where(i + p == j + q, 1.0, corr.ravel())
            off = np.flatnonzero(i + p != j + q) if i == j else np.arange(len(p))
            # a diagonal block holds both halves already
            ia, ib, vv = (i + p, j + q, value) if i == j else (np.r_[i + p, (j + q)[off]], np.r_[j + q, (i + p)[off]], np.r_[value, value[off]])
            yield pa.RecordBatch.from_arrays([pa.array(ia, pa.int32()), pa.array(ib, pa.int32()), pa.array(vv, mask=np.isnan(vv))], names=["a", "b", "corr"])

    pairs = len(starts) * (len(starts) + 1) // 2
    got = rows.mapInArrow(add, schema).repartition(min(pairs, 200), "i", "j").mapInArrow(finish, "a int, b int, corr double")
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "at int, name string")
    one, two = (names.select(F.col("at").alias(k), F.col("name").alias(f"col_{k}")) for k in ("a", "b"))
    return got.join(F.broadcast(one), "a").join(F.broadcast(two), "b").select("col_a", "col_b", "corr")


def correlation_filter(df: DataFrame, cols=None, threshold: float = 0.98) -> DataFrame:
    """(column, dropped): a column is dropped when some earlier column (in column order)
    has |corr| > threshold with it."""
    cols = list(cols or numeric_columns(df))
    order = {c: i for i, c in enumerate(cols)}
    cm = correlation_matrix(df, cols)
    pos = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(order[c]))])
    hit = (cm.where(pos[F.col("col_a")] < pos[F.col("col_b")])
             .where(F.abs(F.col("corr")) > F.lit(threshold))
             .select(F.col("col_b").alias("column")).distinct().withColumn("dropped", F.lit(1)))
    base = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return base.join(hit, "column", "left").select("column", F.coalesce("dropped", F.lit(0)).alias("dropped"))


def rare_categories(df: DataFrame, cols=None, min_freq: float = 0.01, min_count: int | None = None) -> DataFrame:
    """(column, value, count, freq) of values rarer than min_freq (or min_count); NULL counts as a value."""
    cols = list(cols or categorical_columns(df))
    n = df.count()
    vc = value_counts(df, cols, dropna=False)
    freq = F.col("count") / F.lit(max(1, n))
    rare = (F.col("count") < F.lit(min_count)) if min_count is not None else (freq < F.lit(min_freq))
    return vc.where(rare).select("column", "value", "count", freq.alias("freq"))


def dtype_counts(df: DataFrame) -> dict[str, int]:
    """Columns per type name."""
    out: dict[str, int] = {}
    for _, t in df.dtypes:
        out[t] = out.get(t, 0) + 1
    return out
