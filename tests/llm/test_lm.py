import math
import zlib
from collections import Counter

import numpy as np
import pytest

from autotab.llm import lm
from autotab.llm.common import words_of
from autotab.llm.eliasfano import EliasFano, Trie


def test_sequences():
    rng = np.random.default_rng(1)
    for n, top in [(0, 5), (1, 1), (1, 100), (10, 1000), (1000, 10**6), (1000, 1500), (5000, 10**12), (300, 2**40)]:
        x = np.unique(rng.integers(0, top, n))
        e = EliasFano.build(x, top)
        assert (e.access(np.arange(len(x))) == x).all()
        q = np.r_[x, rng.integers(0, 2 * top, 500)]
        at = {int(v): i for i, v in enumerate(x)}
        assert e.find(q).tolist() == [at.get(int(v), -1) for v in q]
        y = np.sort(rng.integers(0, 50, 40))
        assert (EliasFano.build(y, 50).access(np.arange(40)) == y).all()


def test_compact():
    x = np.sort(np.random.default_rng(2).integers(0, 10**9, 100_000))
    e = EliasFano.build(x, 10**9)
    assert 8 * (e.low.nbytes + e.high.nbytes) / len(x) < 2.2 + math.log2(10**9 / len(x))


def test_trie_from_its_file(tmp_path):
    rng = np.random.default_rng(3)
    grams = Counter(map(tuple, rng.integers(2, 40, (3000, 3)).tolist()))
    rows = sorted(grams, key=lambda g: (g[1], g[0], g[2]))
    u, v, w = (np.array(c) for c in zip(*rows, strict=True))
    Trie.build(u, v, w, np.array([grams[r] for r in rows]), 2, 20.0).save(tmp_path / "t")
    t = Trie.load(tmp_path / "t")
    assert isinstance(t.probabilities.base, np.ndarray)
    pairs = Counter()
    for g, n in grams.items():
        pairs[g[:2]] += n
    ask = sorted({*rows, *map(tuple, rng.integers(2, 60, (2000, 3)).tolist())}, key=lambda g: (g[1], g[0], g[2]))
    from autotab.llm.eliasfano import decode
    c, p = (decode(x) for x in t.look_up(*(np.array(x) for x in zip(*ask, strict=True))))
    for g, a, b in zip(ask, c, p, strict=True):
        assert a == pytest.approx(pairs.get(g[:2], 0), rel=5e-4)
        assert b == pytest.approx(grams[g] / (pairs[g[:2]] + 20) if g in grams and g[2] != 2 else 0, rel=5e-4)


def model(rows):
    """Brute-force scores: the same chain from plain dictionaries, unquantised."""
    uni, two, three = Counter(), Counter(), Counter()
    texts = [([*words_of(t)], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in rows]
    for ws, held in texts:
        if not held:
            s = [b" <", b" <", *ws, b" >"]
            uni.update([*ws, b" >", b" <"])
            two.update(zip(s[1:], s[2:], strict=False))
            two[(b" <", b" <")] += 1
            three.update(zip(s, s[1:], s[2:], strict=False))
    n, v = sum(c for w, c in uni.items() if w != b" <"), len([w for w in uni if w != b" <"])
    out = []
    for (i, _), (ws, held) in zip(rows, texts, strict=True):
        s, base, own, known = [b" <", b" <", *ws, b" >"], 0.0, 0.0, 0
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            p = (uni[c] + 1) / (n + v + 1)
            base += math.log10(p)
            known += uni[c] > 0
            p = (two[(b, c)] + lm.PRIOR * p) / (uni[b] + lm.PRIOR)
            own += math.log10((three[(a, b, c)] + lm.PRIOR * p) / (two[(a, b)] + lm.PRIOR))
        out.append((i, held, len(ws) + 1, known, n, base, own))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_brute_force(spark, docs_of, monkeypatch, small):
    if small:  # many blocks and shards
        monkeypatch.setattr(lm, "BLOCK_CHARS", 2000)
        monkeypatch.setattr(lm, "SHARD_TOKENS", 3000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()]
    rows += [(None, "some words without id"), (None, None), (900, ""), (901, None), (902, "End end END"), (902, "End end END"), (-7, "negative id"), (903, "word " * 3000)]
    df = docs_of(rows)
    held = lm.F.crc32(lm.F.coalesce(df.doc_id.cast("string"), lm.F.lit("")).cast("binary")) % lm.FOLDS == lm.HELD
    got = sorted(map(tuple, lm.score(df.withColumn("held_out", held)).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[5], r[6]))
    want = sorted(model(rows), key=lambda r: (r[0] is None, r[0] or 0, r[5], r[6]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert g[6] == pytest.approx(w[6], abs=1e-3 * w[2])


def test_text_of_very_many_distinct_words(spark, docs_of):
    rows = [(1, " ".join(f"{i:x}" for i in range(1_100_000))), (2, "1 2 3 4 zz"), (3, "a b c a b c")]
    df = docs_of(rows)
    held = lm.F.crc32(df.doc_id.cast("string").cast("binary")) % lm.FOLDS == lm.HELD
    got = sorted(map(tuple, lm.score(df.withColumn("held_out", held)).collect()))
    for g, w in zip(got, sorted(model(rows)), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], abs=1e-3 * w[2])


def test_empty_table(spark, docs_of):
    assert lm.score(docs_of([(1, "x")]).limit(0).withColumn("held_out", lm.F.lit(False))).count() == 0


def test_held_out_text_is_better_predicted(spark):
    r = lm.op1_lm(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert r[0] > r[1]
