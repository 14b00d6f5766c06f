"""Modelling tables derived from the driver's test tables.

These only shape the given tables into the schema a modelling job expects
(key, target, features, or a scored table). All modelling work happens in the
operators. The SQL twins used by the DuckDB oracle live in ``autotab.catalog``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import unit_uniform
from .tables import read_table

LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                "l_extendedprice"]


def orders_ml(spark: SparkSession, d: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation; targets o_orderstatus (3 classes) and urgent (0/1)."""
    o = read_table(spark, d, "orders")
    c = read_table(spark, d, "customer")
    n = read_table(spark, d, "nation")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
                     F.year("o_orderdate").alias("o_year"), "c_acctbal", "c_mktsegment", "n_name",
                     F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("urgent")))


def orders_reg(spark: SparkSession, d: str) -> DataFrame:
    """orders_ml plus a stand-in prediction of o_totalprice (truth times 0.9..1.1)."""
    df = orders_ml(spark, d)
    return df.withColumn("pred", F.col("o_totalprice") * (F.lit(0.9) + F.lit(0.2) * unit_uniform("o_orderkey", seed=7)))


def docs_ml(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    lab = read_table(spark, d, "labels")
    return docs.join(lab, "doc_id").select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


def docs_nulls(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    lab = read_table(spark, d, "labels")
    return docs.join(lab, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars",
                                                   "quality", "toxic")


def events_cat(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select("event_id", "ts", F.col("user_id").cast("string").alias("user_id"), "event_type",
                    "value", "props", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"))


def vec_ml(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a binary scored table: integer grade q in 1..100, score q/100, label y, pred."""
    li = read_table(spark, d, "lineitem")
    q = (F.round(F.col("l_discount") * 100).cast("bigint") * 5 + F.col("l_quantity").cast("bigint"))
    return (li.select(*LINEITEM_KEY, q.alias("q"))
              .select(*LINEITEM_KEY, "q", (F.col("q") / F.lit(100.0)).alias("score"),
                      ((F.col("q") + F.col("l_partkey") % 100 - 50) >= 60).cast("int").alias("y"),
                      (F.col("q") >= 50).cast("int").alias("y_pred")))


def scored_multi(spark: SparkSession, d: str) -> DataFrame:
    """orders as a 3-class scored table: y = index of o_orderstatus among sorted statuses,
    proba = normalised md5 draws with a bonus of 0.5 on the true class."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    # Class order of o_orderstatus.
    y = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    df = o.withColumn("y", y.cast("int"))
    raws = [unit_uniform("o_orderkey", seed=100 + j) + F.when(F.col("y") == j, 0.5).otherwise(0.0)
            for j in range(3)]
    df = df.withColumn("raw", F.array(*raws))
    tot = F.aggregate("raw", F.lit(0.0), lambda a, b: a + b)
    df = df.withColumn("proba", F.transform("raw", lambda v: v / tot))
    pmax = F.array_max("proba")
    df = df.withColumn("y_pred", (F.array_position("proba", pmax) - 1).cast("int"))
    return df.select("o_orderkey", "y", "proba", "y_pred")


def scored_multi_b(spark: SparkSession, d: str) -> DataFrame:
    """A second 3-class member on orders: md5 draws (seeds 200..202), bonus 0.2 on the true class."""
    base = scored_multi(spark, d).select("o_orderkey", "y")
    raws = [unit_uniform("o_orderkey", seed=200 + j) + F.when(F.col("y") == j, 0.2).otherwise(0.0) for j in range(3)]
    df = base.withColumn("raw", F.array(*raws))
    tot = F.aggregate("raw", F.lit(0.0), lambda a, b: a + b)
    return df.withColumn("proba", F.transform("raw", lambda v: v / tot)).select("o_orderkey", "y", "proba")
