"""Re-paired columns against a plain sort of the key hashes."""

from hashlib import md5

import pytest
from pyspark.sql import functions as F

from autotab.operators import explain as EX


def by_hand(rows, seed):
    def order(side):
        return sorted(rows, key=lambda r: (int(md5(f"{'' if r[0] is None else r[0]}#{seed}-{side}".encode()).hexdigest()[:15], 16), r[0] is not None, r[0]))
    return sorted(((a[0], b[1], a[2]) for a, b in zip(order("a"), order("b"), strict=True)), key=str)


@pytest.mark.parametrize("block", [7, 40, 50_000])
def test_permuted_column_equals_a_sort_by_hash(spark, monkeypatch, block):
    monkeypatch.setattr(EX, "BLOCK_ROWS", block)
    monkeypatch.setattr(EX, "CHUNK_ROWS", 60)
    rows = [(i if i != 5 else None, float(i) if i % 9 else None, f"t{i}") for i in range(333)]
    df = spark.createDataFrame(rows, "k long, v double, t string").repartition(3)
    out = EX.permute_column(df, "v", ["k"], "1-v-0")
    assert out.schema == df.schema
    assert sorted(map(tuple, out.collect()), key=str) == by_hand(rows, "1-v-0")


def test_repeated_keys_keep_every_row(spark, monkeypatch):
    monkeypatch.setattr(EX, "BLOCK_ROWS", 4)
    df = spark.createDataFrame([(i % 10, i) for i in range(60)], "k long, v long")
    out = EX.permute_column(df, "v", ["k"], "s").collect()
    assert sorted(r["v"] for r in out) == list(range(60)) and sorted(r["k"] for r in out) == sorted(i % 10 for i in range(60))


def test_a_permutation_moves_rows_once(spark):
    """One shuffle of packed blocks; ranking both sides by windows and joining the ranks took six."""
    plan = EX.permute_column(spark.range(100).withColumn("v", F.col("id") * 2), "v", ["id"], "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
