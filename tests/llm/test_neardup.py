import random
from collections import Counter, defaultdict

import numpy as np

from autotab.llm import neardup
from autotab.llm.common import words_of


def bag(text):
    w = words_of(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    """Smallest id of each row's class, by comparing all pairs of texts that share a shingle."""
    texts = sorted({t or "" for _, t in rows})
    bags, where = [bag(t) for t in texts], defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            where[s].append(i)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in {(a, b) for v in where.values() for a in v for b in v if a < b}:
        both = sum((bags[x] & bags[y]).values())
        if both >= 0.8 * sum((bags[x] | bags[y]).values()):
            root[max(find(x), find(y))] = min(find(x), find(y))
    at = {t: i for i, t in enumerate(texts)}
    low = {}
    for i, t in rows:
        r = find(at[t or ""])
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    return [low[find(at[t or ""])] for _, t in rows]


def test_signature_agreement_is_the_weighted_similarity():
    random.seed(3)
    words = [f"w{random.randrange(300)}" for _ in range(400)]
    pairs = []
    for keep in (0.99, 0.95, 0.85):
        for _ in range(12):
            pairs.append((" ".join(words), " ".join(w if random.random() < keep else f"x{random.random()}" for w in words)))
    error = []
    for a, b in pairs:
        x, y = bag(a), bag(b)
        _, s = neardup.signatures([a.encode(), b.encode()])
        error.append((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(error)) < 0.02 and np.max(np.abs(error)) < 0.2


def test_repeated_shingles_weigh():
    line = "one two three four five six seven"
    a, b = " ".join([line] * 40), " ".join([line] * 8)
    _, s = neardup.signatures([a.encode(), b.encode(), a.encode()])
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - 0.2) < 0.15


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in neardup.op4_dartminhash(spark, "/root/testdata/sf0.01").collect()}
    want = brute_classes(rows)
    assert [got[i] for i, _ in rows] == want


def hard_rows():
    random.seed(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(w if random.random() > 0.02 else f"q{i}x{k}" for k, w in enumerate(base))) for i in range(60)]
    rows += [(1000 + i, rows[i % 3][1].upper()) for i in range(9)]
    return rows + [(2000, None), (2001, ""), (2002, "  \n"), (2003, "short one"), (2004, "Short  one"), (None, "short one"),
                   (2005, "lone words of its own here"), (2005, "lone words of its own here"), (None, "nameless text with some seven words")]


def test_chunks_ties_nulls_and_repeats(spark, docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 8)
    rows = hard_rows()
    got = neardup.classes(docs_of(rows)).collect()
    assert len(got) == len(rows)
    count = Counter((i, c) for (i, _), c in zip(rows, brute_classes(rows), strict=True))
    assert Counter((r.doc_id, r.class_id) for r in got) == count
    assert neardup.classes(docs_of([(1, "x")]).limit(0)).count() == 0


def test_one_of_each_class_stays(spark, docs_of):
    rows = hard_rows()
    docs = docs_of(rows).selectExpr("*", "'extra' AS label", "1 AS hub")
    kept = neardup.first_of_class(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in brute_classes(rows) if c is not None})
    assert ids.count(None) == 1
