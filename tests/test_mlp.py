"""The perceptron against finite differences and on a target that needs a hidden layer."""

import numpy as np
from pyspark.ml.linalg import Vectors

from autotab.operators import matrix as MX
from autotab.operators import mlp as N


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(4)
    for k in (1, 3):
        x, y, w = rng.normal(size=(9, 4)), rng.integers(0, max(2, k), 9).astype(float), rng.random(9)
        weights = N.start_weights([4, 6, 5, k], 1)
        weights = [v + rng.normal(size=v.shape) * 0.1 for v in weights]
        masks = N.masks_of(np.arange(9), N.MlpOptions(hidden=(6, 5), dropout=0.4), 3)
        _, g = N.loss_and_gradient(weights, x, y, w, masks)
        for i, v in enumerate(weights):
            for at in np.ndindex(v.shape):
                moved = [[u.copy() for u in weights] for _ in range(2)]
                moved[0][i][at] += 1e-6
                moved[1][i][at] -= 1e-6
                up, down = (N.loss_and_gradient(m, x, y, w, masks)[0] for m in moved)
                assert abs((up - down) / 2e-6 - g[i][at]) < 1e-5


def test_batches_part_the_rows_and_masks_drop_their_share():
    o, uid = N.MlpOptions(dropout=0.25, hidden=(40,)), np.arange(500)
    turns = np.floor(N.mixed(uid, o.seed * 1_009 + 2) * 7)
    assert set(turns) == set(range(7))
    m = N.masks_of(uid, o, 5)[0]
    assert abs((m == 0).mean() - 0.25) < 0.02 and set(np.unique(m)) == {0.0, 1 / 0.75} and not (m == N.masks_of(uid, o, 6)[0]).all()


def test_adam_follows_its_definition():
    a = N.Adam([np.array([[1.0, 2.0]])], 0.1)
    a.step(np.array([0.0, 2.0, 4.0, -2.0]))
    assert np.abs(a.weights[0] - [[1 - 0.1, 2 + 0.1]]).max() < 1e-6


def frame(spark, n=300):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    return spark.createDataFrame([(i, float(c), Vectors.dense(v)) for i, (c, v) in enumerate(zip(y, x, strict=True))], ["id", "label", "features"])


def test_learns_what_no_line_can_split_and_reloads(spark, tmp_path):
    from autotab.sources.sinks import load_model, save_model
    df = frame(spark)
    m = N.Perceptron(2, key=["id"], hidden=(16,), dropout=0.05, epochs=60, batchSize=50, learningRate=0.02).fit(df)
    got = {r.id: (r.prediction, r.probability[1]) for r in m.transform(df).collect()}
    right = sum(got[r.id][0] == r.label for r in df.collect())
    assert right > 270 and m.losses[-1] < 0.5 * m.losses[0]
    save_model(spark, m, str(tmp_path / "m"))
    assert {r.id: (r.prediction, r.probability[1]) for r in load_model(spark, str(tmp_path / "m")).transform(df).collect()} == got


def test_many_blocks_give_the_same_steps(spark, monkeypatch):
    df = frame(spark, 60)
    options = {"hidden": (4,), "epochs": 2, "batchSize": 30, "key": ["id"]}
    one = N.Perceptron(2, **options).fit(df)
    monkeypatch.setattr(MX, "BLOCK_BYTES", 200)
    monkeypatch.setattr(N, "MERGE", 2)
    many = N.Perceptron(2, **options).fit(df)
    assert all(np.abs(np.array(a) - np.array(b)).max() < 1e-9 for a, b in zip(one.state["weights"], many.state["weights"], strict=True))


def test_loss_falls_on_the_embeddings(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    x = e.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))
    m = N.Perceptron(10, key=["vec_id"], hidden=(32,), epochs=40, batchSize=64, learningRate=5e-3).fit(x)
    assert m.losses[-1] < 0.7 * m.losses[0] and all(b < a for a, b in zip(m.losses[::10], m.losses[10::10], strict=False))
    p = m.transform(x).select("probability").first()[0]
    assert len(p) == 10 and abs(sum(p) - 1) < 1e-9


def test_jobs_follow_the_bytes_not_the_steps(spark, monkeypatch):
    df = frame(spark, 120)
    options = {"hidden": (4,), "epochs": 2, "batchSize": 4, "key": ["id"]}
    one = N.Perceptron(2, **options).fit(df)
    monkeypatch.setattr(MX, "BLOCK_BYTES", 1000)
    calls = []
    monkeypatch.setattr(type(df), "collect", lambda self, f=type(df).collect: calls.append(1) or f(self))
    many = N.Perceptron(2, **options).fit(df)
    # 30 steps an epoch out of 2 blocks
    assert len(calls) < 10
    assert all(np.abs(np.array(a) - np.array(b)).max() < 1e-9 for a, b in zip(one.state["weights"], many.state["weights"], strict=True))
    assert np.abs(np.array(one.losses) - many.losses).max() < 1e-9


def test_one_task_makes_the_epochs_of_a_matrix_that_it_can_hold(spark, monkeypatch):
    df = frame(spark, 120)
    options = {"hidden": (4,), "epochs": 7, "batchSize": 4, "key": ["id"]}
    monkeypatch.setattr(MX, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(N, "EPOCHS", 4)
    calls = []
    monkeypatch.setattr(type(df), "collect", lambda self, f=type(df).collect: calls.append(1) or f(self))
    held = N.Perceptron(2, **options).fit(df)
    # jobs follow the epochs in tens (here fours), not the runs of mini-batches
    assert len(calls) < 6
    monkeypatch.setattr(N, "HELD_BYTES", 0)
    dealt = N.Perceptron(2, **options).fit(df)
    assert all(np.abs(np.array(a) - np.array(b)).max() < 1e-9 for a, b in zip(held.state["weights"], dealt.state["weights"], strict=True))
    assert len(held.losses) == 7 and np.abs(np.array(held.losses) - dealt.losses).max() < 1e-9
