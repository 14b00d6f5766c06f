import math
import random

import numpy as np
import pytest

from autotab.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in {r for r in ok if r[0] % 50 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a[2], c[2], strict=False)), c[0], c[1]) for c in ok if c[0] != a[0])
        for s, pid, _ in [t for t in scored if t[2] == a[1]][:5]:
            fit = [t for t in scored if t[2] != a[1] and 50 * -s <= 100 * -t[0] <= 95 * -s]
            out += [(a[0], pid, r + 1, nid, -s, -n) for r, (n, nid, _) in enumerate(fit[:3])]
    return sorted(out)


def run(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "1 AS curve", "2 AS v", "3 AS tile").write.parquet(f"{path}/embeddings.parquet")
    got = negatives.op11_negatives(spark, str(path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def clustered(n, dim, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    return [(i, [x + rng.gauss(0, 0.3) for x in centres[rng.randrange(8)]], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"BLOCK_BYTES": 700, "GROUP_BYTES": 200, "TILE": 3}])
def test_equals_brute_force(spark, monkeypatch, tmp_path, settings):
    for k, v in settings.items():
        monkeypatch.setattr(negatives, k, v)
    rows = clustered(600, 7)
    want = brute(rows)
    assert len(want) > 50 and run(spark, rows, tmp_path) == want


def test_nulls_odd_vectors_ties_and_repeats(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [*clustered(160, 4), (None, [1.0, 1.0], 1), (50, None, 1), (200, [1.0, 2.0], None), (250, [1.0, None], 2), (300, [nan, 1.0], 2), (350, [inf], 1),
            (400, [], 3), (450, [0.0, 0.0, 0.0, 0.0], 2), (501, [9.0], 1), (550, [1e5, -1e5, 1e5, 1e5], 1), (-50, [2.0, 1.0, 5.0, 5.0, 6.0], 2)]
    rows += [(1, [1.0, 1.0, 1.0, 1.0], 1)] * 9 + [(100, [1.0, 1.0, 1.0, 1.0], 1)] * 3 + [(100, [1.0, 1.0, 1.0, 2.0], 1)] + [(7 * k, [1.0, 1.0, 1.0, 1.0], 0) for k in range(5)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_few_and_no_rows(spark, tmp_path):
    for i, rows in enumerate([[], [(50, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 1)], [(50, None, 1)], [(50, [], 1), (51, [], 1)]]):
        assert run(spark, rows, tmp_path / str(i)) == []


def test_curve_steps_from_cell_to_neighbouring_cell():
    for dim, bits in ((2, 3), (3, 2), (1, 4)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij"), -1).reshape(-1, dim)
        place = negatives.hilbert(grid, bits)
        path = grid[np.argsort(place)]
        assert sorted(place.tolist()) == list(range(len(grid))) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_intervals_hold_every_product_and_zone_maps_skip_blocks():
    rng = np.random.default_rng(5)
    a, c = rng.integers(-50, 50, (20, 6)).astype(float), rng.integers(-50, 50, (40, 6)).astype(float)
    low, high = negatives.intervals(a, c.min(0)[None], c.max(0)[None])
    assert (a @ c.T >= low).all() and (a @ c.T <= high).all()
    near, far = np.full((5, 6), 40.0), np.full((5, 6), -40.0)
    low, high = negatives.intervals(np.full((1, 6), 10.0), np.stack([near.min(0), far.min(0)]), np.stack([near.max(0), far.max(0)]))
    assert high[0, 0] > 2000 > high[0, 1]
