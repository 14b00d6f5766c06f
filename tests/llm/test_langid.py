import math
import random
import zlib

import numpy as np
import pytest

from autotab.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_profile(text):
    """Gram by gram, straight from the definition."""
    v, low = np.zeros(langid.DIM), (text or "").lower()
    padded = [c if c.isalpha() else " " for c in f" {low} "]
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        if b != " ":
            x, y, z = (langid.vector_of(ord(k)).astype(float) for k in (a, b, c))
            v += np.roll(x, 2) * np.roll(y, 1) * z
    return v


def brute(rows):
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 4 == 2 for r in rows]
    sums = {}
    for r, h in zip(rows, held, strict=True):
        if not h and r[2] is not None and r[1] is not None and brute_profile(r[1]).any():
            sums[r[2]] = sums.get(r[2], 0) + brute_profile(r[1])
    out = []
    for r, h in zip(rows, held, strict=True):
        v = brute_profile(r[1])
        best = ("und", 0.0)
        if v.any() and sums:
            scored = [(-round(float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)), 9), lang) for lang, p in sums.items()]
            low, lang = min(scored)
            best = (lang, max(-low, 0.0))
        out.append((r[0], h, *best))
    return out


def run(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cosine", "'x' AS lang_pred", "2 AS score", "3 AS profile").write.parquet(f"{path}/documents.parquet")
    got = langid.op13_langid(spark, str(path))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    return sorted(((r[0], r[1], r[2], round(r[3], 7)) for r in got.collect()), key=repr)


def same(got, rows):
    assert got == sorted(((a, b, c, round(d, 7)) for a, b, c, d in brute(rows)), key=repr)


def invented(lang, n, rng):
    parts = {"aa": ["ban", "mo", "tik", "ra"], "bb": ["sch", "eun", "gel", "mo"], "cc": ["éa", "ñu", "ol", "ra"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def some_rows(n):
    rng = random.Random(n)
    return [(i, invented(lang := ("aa", "bb", "cc")[i % 3], rng.randint(1, 60), rng).title() + ".\n42", lang, "s", 1) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"PIECE": 1, "TEXTS": 3, "GRAMS": 5, "CHARS": 40, "COUNTERS": 10}])
def test_equals_brute_force(spark, monkeypatch, tmp_path, settings):
    for k, v in settings.items():
        monkeypatch.setattr(langid, k, v)
    rows = some_rows(60)
    same(run(spark, rows, tmp_path), rows)


def test_nulls_blanks_repeats_and_long_texts(spark, tmp_path):
    rng = random.Random(1)
    rows = some_rows(30) + [(None, None, None, None, None), (None, "ban mo", "aa", None, 1), (7, "", "aa", "s", 0), (8, "12 ;; \n", "aa", "s", 0), (9, "語語 ü", None, "s", 1),
                            (1, "schgel", "bb", "s", 1), (1, "schgel", "bb", "s", 1), (40, "X", "zz", "s", 1), (41, invented("aa", 4000, rng), "aa", "s", 1), (42, "İ Σas ΑΣ", "cc", "s", 1)]
    same(run(spark, rows, tmp_path), rows)


def test_nothing_learned_and_no_rows(spark, tmp_path):
    rows = [(1, "abc", None, "s", 1), (2, None, "en", "s", 1), (3, "17", "en", "s", 1)]
    assert {r[2] for r in run(spark, rows, tmp_path / "some")} == {"und"}
    assert run(spark, [], tmp_path / "none") == []


def test_long_texts_are_cut_where_no_gram_stands(monkeypatch):
    text = "abc defghijklmno pq\nr" * 30 + "x" * 200 + " end"
    whole = langid.profiles(langid.Letters(), [text])
    monkeypatch.setattr(langid, "CHARS", 7)
    assert (langid.profiles(langid.Letters(), [text]) == whole).all() and (whole[0] == brute_profile(text)).all()


def test_held_out_documents_get_their_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op13_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").toPandas()
    words = got[got.text.str.split().str.len() >= 20]
    assert len(words) > 100 and (words.lang == words.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all() and math.isfinite(got.score.sum())
