import re
import time

import pytest

from autotab.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if tuple(words[i:i + len(p)]) == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = licenses.op5_licenses(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


@pytest.mark.parametrize("text", ["", "UNDER the MIT\n-license!", "under the mit license under the mit license", "cc by nc by cc-by-nc 4.0", "xunder the mit license",
                                  "under the mit licensé", "Apache License, Version 2.0", "cc by ncé cc\x00by\x7fnc", "Σ under the MIT license Σ " * 500, "underthe mit license"])
def test_places(text):
    assert licenses.scan_text(text)[:5] == brute(text)


@pytest.mark.parametrize(("expression", "postfix"), [
    ("MIT", ["mit"]), ("MIT OR Apache-2.0", ["mit", "apache-2.0", "or"]), ("a or b and c", ["a", "b", "c", "and", "or"]),
    ("(a OR b) AND c", ["a", "b", "or", "c", "and"]), ("GPL-2.0+ WITH Classpath-exception-2.0 OR mit", ["gpl-2.0+", "classpath-exception-2.0", "with", "mit", "or"]),
    ("a or b or c", ["a", "b", "or", "c", "or"]), ("MIT and then prose", None), ("(a or b", None), ("or a", None), ("a and", None), ("a ) b", None), ("", None), ("MIT see file", ["mit"])])
def test_shunting_yard(expression, postfix):
    want = ["mit", "then", "and"] if expression == "MIT and then prose" else postfix
    assert licenses.to_postfix(expression) == want


def test_expressions_give_labels_and_a_score():
    one = licenses.scan_text("// SPDX-License-Identifier: (GPL-3.0-only OR MIT) AND CC-BY-NC-4.0\ncode")
    assert one[5] == "cc-by-nc,cc-by-nc-4.0,gpl-3.0-only,mit" and one[6] == licenses.OPENNESS["cc-by-nc"]
    assert licenses.scan_text("SPDX-License-Identifier: GPL-2.0 OR MIT")[6] == 1.0
    assert licenses.scan_text("nothing here")[5:] == ("", 0.0)
    both = licenses.scan_text("Released under the MIT License. GNU General Public License, version 3.")
    assert both[4] == "mit" and set(both[5].split(",")) == {"mit", "gpl", "gpl-3"} and both[6] == licenses.OPENNESS["gpl"]


def test_nulls_repeats_and_clashing_names(spark, docs_of):
    df = docs_of([(1, None), (2, "under the MIT license"), (2, "under the MIT license"), (None, "")]).selectExpr("*", "'x' AS labels", "1 AS n_words")
    out = licenses.scan(df)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", *dict(licenses.COLUMNS)]
    assert sorted((r.doc_id or 0, r.n_words, r.labels) for r in out.collect()) == [(0, 0, ""), (1, 0, ""), (2, 4, "mit"), (2, 4, "mit")]
    assert licenses.scan(df.limit(0)).count() == 0


def test_many_notices_in_one_text_stay_linear():
    parts = ["under the mit license", "cc by nc", "filler"]
    words, want = [], []
    for i in range(150_000):
        if i % 3 < 2:
            want.append(len(words))
        words += parts[i % 3].split()
    start = time.monotonic()
    got = licenses.scan_text(" ".join(words))
    assert time.monotonic() - start < 5
    assert got[:4] == (len(words), len(want), want[0], want[-1])
