import math
from collections import Counter

import duckdb
import numpy as np

from autotab.llm import mixing


def water_fill(sizes):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        over = [s for s in open_ if left * w[s] / sum(w[x] for x in open_) >= 2 * sizes[s]]
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= set(over)
    return target


def rows_of():
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 90)), f"s{int(rng.integers(0, 6)) // 2}") for i in range(900)]
    return rows + [(1, "twin words here", "s0")] * 3 + [(None, "a b", None), (None, None, None), (5000, "  ", "zero"), (5001, "x" * 9000 + " y", "\U0001F600")]


def test_targets_and_draws(spark, docs_of):
    rows = rows_of()
    df = docs_of(rows).selectExpr("*", "'q' AS epoch", "7 AS w", "1 AS block")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = water_fill(dict(sizes))
    got = {r.source: r.target for r in mixing.source_targets(df.withColumn("size", mixing.size_of(mixing.whole_text()))).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    out = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r.source or "", r.position, r.epoch, r.block, r.shard, r.size)
    assert sorted(map(key, out)) == sorted(map(key, again))
    taken = Counter()
    for r in out:
        taken[r.source] += r.size
    for s, n in sizes.items():
        assert abs(taken[s] - want[s]) <= max(len((t or "").split()) for _, t, x in rows if x == s) / 2
    assert max(Counter((r.source, r.position) for r in out).values()) <= 2
    assert {"w", "lang", "n_chars", "text"} <= set(out[0].asDict()) and out[0].w == 7
    assert mixing.mix(df.limit(0)).count() == 0


def test_splitting_tree_is_exact_and_random():
    quota = np.array([700, 20, 0, 301])
    leaves = np.array([mixing.leaf_quota(quota, 16, s) for s in range(16)])
    assert (leaves.sum(0) == quota).all() and leaves.min() >= 0
    assert set(leaves.sum(1)) <= {63, 64}
    shares = np.array([mixing.leaf_quota(quota, 2, 0, seed) for seed in range(400)])
    p = quota / quota.sum()
    assert np.allclose(shares.mean(0), 510 * p, atol=1.0)
    spread = 510 * p * (1 - p) * (quota.sum() - 510) / (quota.sum() - 1)
    assert np.allclose(shares.var(0), spread, rtol=0.35, atol=0.5)


def test_halves_of_very_many_blocks():
    quota = np.array([3 * 10**12, 10**9, 0, 7])
    leaf = mixing.leaf_quota(quota, 1 << 32, 12345)
    assert 0 <= leaf.min() and abs(int(leaf.sum()) - quota.sum() / 2**32) < 2
    small = np.array([5, 3, 1])
    draws = Counter(tuple(mixing.half_of(np.random.default_rng(s), small)) for s in range(6000))
    for d, n in draws.items():
        assert sum(d) == 4
        p = math.prod(math.comb(c, x) for c, x in zip(small.tolist(), d, strict=True)) / math.comb(9, 4)
        assert abs(n / 6000 - p) < 5 * (p / 6000) ** 0.5
    assert sorted(mixing.subset(np.random.default_rng(1), 6, 6)) == list(range(6))


def test_query_with_nulls_repeats_and_an_empty_table(spark, docs_of, tmp_path):
    for name, rows in [("full", rows_of()), ("empty", rows_of()[:1])]:
        folder = tmp_path / name
        docs = docs_of(rows) if name == "full" else docs_of(rows).limit(0)
        docs.write.parquet(f"{folder}/documents.parquet")
        got = [tuple(r) for r in mixing.op10_mixing(spark, str(folder)).collect()]
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        want = con.execute(mixing.OP10_SQL).fetchall()
        show = lambda rows: sorted((str(i), a, b, round(c, 6), t) for i, a, b, c, t in rows)
        assert len(got) == (len(rows) if name == "full" else 0) and show(got) == show(want)


def test_every_shard_of_the_query_holds_its_quota(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 8)
    rows = mixing.keyed(docs_of(rows_of()))
    taken = mixing.draws(rows).groupBy("source_key", "shard").agg(mixing.F.count_distinct("block").alias("n")).collect()
    keys = sorted({r.source_key for r in taken})
    quota = np.array([sum(r.n for r in taken if r.source_key == k) for k in keys])
    shards = 1 << (max(r.shard for r in taken)).bit_length()
    by = {(r.source_key, r.shard): r.n for r in taken}
    for s in range(shards):
        assert [by.get((k, s), 0) for k in keys] == mixing.leaf_quota(quota, shards, s).tolist()


def test_blocks_are_disjoint_and_fill_the_quota(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 8)
    out = mixing.mix(docs_of(rows_of())).collect()
    shard_of, blocks = {}, {}
    for r in out:
        assert shard_of.setdefault((r.source_key, r.block), r.shard) == r.shard
        blocks.setdefault(r.source_key, set()).add(r.block)
    quota = np.array([len(blocks[k]) for k in sorted(blocks)])
    shards = max(shard_of.values()) + 1
    n = 1 << (shards - 1).bit_length()
    for s in range(n):
        want = mixing.leaf_quota(quota, n, s)
        assert [sum(v == s and k[0] == key for k, v in shard_of.items()) for key in sorted(blocks)] == want.tolist()


def test_shards_are_shuffled(spark, docs_of):
    out = mixing.shuffled(mixing.mix(docs_of(rows_of()))).collect()
    by = [r.position for r in out if r.shard == 0 and r.source == "s0"]
    assert by != sorted(by)
