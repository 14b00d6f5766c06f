"""Readers for parquet / CSV inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import NULL_TOKENS, blank_to_null, named, token_to_null

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def strip_column_names(df: DataFrame) -> DataFrame:
    """Trim whitespace around column names; fail if two names collide."""
    names = [c.strip() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide after trimming: {names}")
    return df.toDF(*names)


def infer_types(df: DataFrame) -> DataFrame:
    """Cast string columns whose non-null values all parse as integer → bigint, else as
    number → double (one aggregate for all columns); other columns stay strings."""
    str_cols = [c for c, t in df.dtypes if t == "string"]
    if not str_cols:
        return df
    aggs = []
    for c in str_cols:
        aggs += [F.count(named(c)).alias(f"n__{c}"),
                 F.count(F.expr(f"try_cast(trim(`{c}`) AS BIGINT)")).alias(f"i__{c}"),
                 F.count(F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)")).alias(f"d__{c}")]
    st = df.agg(*aggs).first()
    out = []
    for c, t in df.dtypes:
        if t != "string":
            out.append(named(c))
            continue
        n, ni, nd = st[f"n__{c}"], st[f"i__{c}"], st[f"d__{c}"]
        if n > 0 and ni == n:
            out.append(F.expr(f"try_cast(trim(`{c}`) AS BIGINT)").alias(c))
        elif n > 0 and nd == n:
            out.append(F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)").alias(c))
        else:
            out.append(named(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema=None, infer: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV with header. Quoted cells may hold separators, doubled quotes and, with ``multi_line``, line
    breaks (a file is then read by one task; without, large files are split). All cells are read as
    text, pandas' missing tokens and blank/whitespace cells become NULL, then numeric types are
    inferred (or an explicit ``schema`` is applied)."""
    raw = (spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line)
           .option("quote", '"').option("escape", '"').option("nullValue", None).option("emptyValue", "").csv(path))
    raw = strip_column_names(raw)
    raw = raw.select(*[token_to_null(blank_to_null(named(c))).alias(c) for c in raw.columns])
    if schema is not None:
        return raw.select(*[named(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return infer_types(raw) if infer else raw


__all__ = ["TABLES", "read_table", "read_csv", "infer_types", "strip_column_names", "NULL_TOKENS"]
