import math
import random

import numpy as np

from autotab.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i)[:k]
            out += [(i, r + 1, j, -p) for r, (p, j) in enumerate(s)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    v = topk.quantised(df.selectExpr("*", "'x' AS id", "1 AS length"))
    return sorted(map(tuple, topk.search(v, v.where(topk.F.col("id") % 20 == 0)).collect()))


def some_vectors(n, dim, spread):
    random.seed(n)
    return [(i, [random.gauss(0, 1) * math.exp(spread * (i % 7)) for _ in range(dim)]) for i in range(n)]


def test_equals_brute_force_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 37)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "TILE", 2)
    for spread in (0.0, 0.7):
        rows = some_vectors(400, 8, spread)
        assert run(spark, rows) == brute(rows)


def test_ties_nulls_odd_vectors_and_few_rows(spark):
    rows = [(i, [0.5, -0.25, 0.1]) for i in range(60)] + [(20, [0.5, -0.25, 0.1]), (100, None), (120, [1.0, None, 2.0]), (140, [1.0, float("nan"), 0.0]),
            (160, [float("inf"), 0.0, 0.0]), (180, []), (200, [0.0, 0.0, 0.0]), (220, [3.0]), (None, [1.0, 1.0, 1.0]), (-40, [-1.0, 2.0, 5.0, 7.0]), (240, [1e4, -1e4, 1e4])]
    assert run(spark, rows[60:]) == brute(rows[60:])
    got = run(spark, rows)
    # ids that stand twice are candidates each; compare scores and ids as lists
    assert [(a, b, c, d) for a, b, c, d in got if a not in (20,)] == [x for x in brute(rows) if x[0] not in (20,)]
    assert run(spark, [(1, [1.0])]) == [] and run(spark, []) == [] and run(spark, [(20, [1.0])]) == []


def test_pruning_by_coordinates_keeps_the_best():
    random.seed(8)
    c = np.array([[random.randrange(-60, 61) for _ in range(6)] for _ in range(500)], dtype=float)
    c = c[np.argsort(-(c * c).sum(1), kind="stable")]
    ids = np.arange(1000, 1500)
    q = c[::25] + 1
    scores = (q @ c.T).astype(int)
    bounds = np.sort(scores, axis=1)[:, -5].astype(float)
    for own, i, s in topk.search_block(np.arange(len(q)), q, bounds, ids, c, 5):
        order = np.lexsort((ids, -scores[own]))[:5]
        assert i.tolist() == ids[order].tolist() and s.tolist() == scores[own][order].tolist()
