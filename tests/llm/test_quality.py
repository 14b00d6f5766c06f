import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from autotab.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
           "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}
    return out | {"base_failed": len(words) < 20 or 100 * len(inside) > 30 * len(words)}


def test_counts_equal_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = quality.op3_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute_counts(docs[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert not (r.base_failed and r.kept)


def test_odd_texts():
    texts = ["", " ", "a b c d e f g h " * 2, "a b c d e f g h i\n" * 3 + "\n\n \n", "x" * 50_000, "ä ö ü\x1c\x85 ß\t#|", "w " * 20_000, "same line\nsame line\n same line"]
    for t, got in zip(texts, quality.measure(texts), strict=True):
        want = brute_counts(t)
        assert dict(zip(quality.COUNTS, got, strict=True)) | want == dict(zip(quality.COUNTS, got, strict=True)) | {"base_failed": want["base_failed"]}


def test_binomial_tail_is_exact():
    for n, k, p in [(10, 0, 0.1), (50, 3, 0.05), (2000, 20, 0.02), (5, 5, 0.3)]:
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))


def kinds_of(rows):
    """bins, good, weight of (bins of the signals, good, number) rows."""
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def test_cutoffs_need_evidence_and_gain():
    last = len(quality.GRID)
    some = kinds_of([((2, last), False, 300), ((5, last), True, 1), ((5, last), False, 100), ((last, last), True, 5000), ((last, 3), False, 100), ((last, 3), True, 4)])
    assert quality.propose(*some) == [5, 3]
    assert quality.certify(*some, [5, 3], 0.0125, 0.02) == [5, 3]
    assert quality.certify(*some, [5, None], 0.0125, 0.02) == [5, None]
    few = kinds_of([((5, last), True, 1), ((last, last), True, 215)])
    assert quality.certify(*few, [5, 3], 0.0125, 0.02) == [None, None]  # 0.98 ** 216 > 0.0125 > 0.98 ** 217
    enough = kinds_of([((5, 9), True, 1), ((last, last), True, 216)])
    assert quality.certify(*enough, [5, 3], 0.0125, 0.02) == [4, 3]
    joint = kinds_of([((5, last), True, 40), ((last, 4), True, 40), ((last, last), True, 5000)])
    assert quality.certify(*joint, [5, 4], 0.0125, 0.02) == [4, 4]  # 80 of 5080 are certain, 40 of 80 at each signal
    alike = kinds_of([((2, last), True, 200), ((2, last), False, 20), ((last, last), True, 5000), ((last, last), False, 500)])
    assert quality.propose(*alike) == [None, None]


def test_kept_equals_brute_force(spark):
    """The verdicts at sf0.1 from single rows: every text once, proposals of one part, certified on the other."""
    got = quality.op3_quality(spark, "/root/testdata/sf0.1").toPandas()
    assert list(got.columns) == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "n_bangs"]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr(
        "doc_id", "lang", "md5(coalesce(text, '')) AS h", "pmod(xxhash64(unhex(md5(coalesce(text, '')))), 4) = 0 AS proposing").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality IN (0, 1)").select("doc_id", "quality").toPandas()
    d = got.merge(docs, on="doc_id")
    words = d.n_words.clip(lower=1)
    signals = {"symbols": d.n_symbols / words, "bangs": d.n_bangs / words, "upper": d.n_upper / d.word_chars.clip(lower=1),
               "dup_lines": d.n_dup_lines / d.n_lines.clip(lower=1), "repeats": d.n_repeat_words / words}
    d = d.assign(**signals)
    seen = d[~d.base_failed].merge(labels, on="doc_id").groupby(["lang", "h"]).agg({**{s: "first" for s in signals}, "quality": "max", "proposing": "first"}).reset_index()
    level, rejected, ruled = quality.DELTA / seen.lang.nunique(), pd.Series(False, index=d.index), 0
    for lang, rows in seen.groupby("lang"):
        one, two, aims = rows[rows.proposing], rows[~rows.proposing], {}
        good, bad = one[one.quality == 1], one[one.quality == 0]
        for s in signals:
            gains = [(bad[s] > c).sum() / max(1, len(bad)) - 10 * (good[s] > c).sum() / max(1, len(good)) for c in quality.GRID]
            if max(gains) > quality.MIN_GAIN:
                aims[s] = quality.GRID[gains.index(max(gains))]
        good, held = two[two.quality == 1], {}
        for c in quality.GRID:
            cuts = {s: max(c, a) for s, a in aims.items()}
            k, n = int(sum((good[s] > x for s, x in cuts.items()), start=pd.Series(False, index=good.index)).astype(bool).sum()), len(good)
            if not aims or sum(math.comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1)) > level:
                break
            held = cuts
        ruled += bool(held)
        for s, x in held.items():
            rejected |= (d.lang == lang) & (d[s] > x)
    assert ruled > 1
    assert (d.kept == (~d.base_failed & ~rejected)).all()


def test_false_rejections_stay_below_alpha(spark):
    r = quality.op3_quality(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    j = r.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(quality.F.avg(quality.F.col("kept").cast("int")).alias("k"))
    share = {x.quality: x.k for x in j.collect()}
    assert share[1] >= 1 - quality.ALPHA and share[0] < share[1]


def test_nulls_repeats_and_extra_columns(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "plain words " * 15), (3, " ".join(f"w{i}" for i in range(40))), (3, " ".join(f"w{i}" for i in range(40)))]
    docs = docs_of(rows).selectExpr("*", "1 AS stratum", "'x' AS signal", "'k' AS text_key")
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    kept = quality.filter_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 3]
    assert quality.filter_documents(docs.limit(0), labels.limit(0)).count() == 0
