import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from autotab.llm import suffix


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    where = defaultdict(list)
    for i, t in enumerate(raw):
        for s in range(len(t) - length + 1):
            where[t[s:s + length]].append((i, s))
    marks = [bytearray(len(t)) for t in raw]
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                marks[i][s:s + length] = b"\1" * length
    out = []
    for t, m in zip(raw, marks, strict=True):
        kept = bytes(c for c, x in zip(t, m, strict=True) if not x)
        out.append((len(t), sum(m), len(bytes(m).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_order():
    random.seed(4)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 50, 301]:
        for k in (1, 2, 5):
            s = np.array([random.randrange(k) + 1 for _ in range(n)], dtype=np.int64)
            got = suffix.suffix_array(s).tolist()
            assert got == sorted(range(n), key=lambda i: s[i:].tolist())


def test_rows_equal_brute_force(spark, docs_of):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdeéñ") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", "x" * 199, "x" * 700, "ab" * 150, passage, passage, passage + "!", passage[:230], passage[:200], passage[:199]]
    texts += [" ".join(word() for _ in range(random.randrange(200))) + passage[random.randrange(100):random.randrange(200, 400)] + " ".join(word() for _ in range(30)) for _ in range(60)]
    rows = [(i % 50, t) for i, t in enumerate(texts)]
    got = suffix.dedup(docs_of(rows)).collect()
    want = Counter((i, *b) for (i, _), b in zip(rows, brute(texts), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert suffix.dedup(docs_of([(1, "x")]).limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows]), strict=True))
    got = suffix.op8_suffix_dedup(spark, d).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_anchors_of_long_texts(monkeypatch):
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 400).astype(np.uint8).tobytes()
    noise = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (300, 5000, 700)]
    monkeypatch.setattr(suffix, "PLACE_BITS", 10)  # places from 1024 on do not fit
    monkeypatch.setattr(suffix, "PIECE", 500)
    data, starts, h, at, anchor = suffix.windows([noise[0] + passage, noise[1] + passage + noise[2]])
    top = h >> np.uint64(10)
    assert anchor.tolist() == [s + int(np.argmin(top[s:s + suffix.REACH + 1])) for s in at.tolist()]
    place = dict(zip(at.tolist(), anchor.tolist(), strict=True))
    near, far = 300, int(starts[1]) + 5000
    for k in range(201):  # equal windows have one key, wherever they stand
        assert h[place[near + k]] == h[place[far + k]]


def test_hot_grams_are_split(spark, docs_of, monkeypatch):
    random.seed(3)
    noise = lambda n: "".join(random.choice("abcdeéñ ") for _ in range(n))
    passage, most = noise(500), 3000
    texts = [noise(random.randrange(150, 400)) + passage + noise(random.randrange(150, 400)) for _ in range(60)]
    texts += [noise(100) + " " * random.randrange(100, 2000) + noise(100) for _ in range(20)] + ["x" * 700, "ab" * 1500, noise(90) + "ab" * 900 + "!", passage, None, ""]
    rows = list(enumerate(texts))
    sort = suffix.repeated_windows

    def bounded(parts, weights):
        assert sum(map(len, parts)) <= 2 * most, "a run is not bounded"
        return sort(parts, weights)

    monkeypatch.setattr(suffix, "RUN_BYTES", most)
    monkeypatch.setattr(suffix, "repeated_windows", bounded)
    got = suffix.dedup(docs_of(rows)).collect()
    want = Counter((i, *b) for (i, _), b in zip(rows, brute(texts), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
