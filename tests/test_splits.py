"""Fold / split / sample properties."""

from pyspark.sql import functions as F

from autotab.operators import split as SP
from paths import SF001


def test_stratified_folds_balanced(spark):
    from autotab.sources import fixtures as fx
    df = SP.stratified_folds(fx.docs_ml(spark, SF001), "quality", ["doc_id"], k=5)
    c = df.groupBy("quality", "fold").count().collect()
    by = {}
    for r in c:
        by.setdefault(r["quality"], []).append(r["count"])
    for counts in by.values():
        assert max(counts) - min(counts) <= 1
    assert df.select("doc_id").distinct().count() == df.count()


def test_hash_rank_bucketed_is_permutation(spark):
    from autotab.functions.keys import row_hash
    from autotab.functions.ranking import hash_rank
    df = spark.range(5000).withColumn("h", row_hash("id"))
    r = hash_rank(df, "h", ["id"], bits=6)
    ranks = sorted(x[0] for x in r.select("rank").collect())
    assert ranks == list(range(5000))
    rows = r.orderBy("rank").select("h").collect()
    hs = [x[0] for x in rows]
    assert hs == sorted(hs)


def test_sample_rows_exact_and_deterministic(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = SP.sample_rows(df, ["k"], 37)
    b = SP.sample_rows(df, ["k"], 37)
    assert a.count() == 37
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())


def test_stratified_split_share(spark):
    df = spark.range(100).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    s = SP.stratified_split(df, "y", ["id"], 0.2)
    got = {r["y"]: r["v"] for r in s.groupBy("y").agg(F.sum("is_valid").alias("v")).collect()}
    assert got == {0: 15, 1: 5}
