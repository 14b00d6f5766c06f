"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags, a
shunting-yard parser evaluates and/or/with expressions behind the tags.

A text is lower-cased (A-Z) and cut to words; the automaton runs over the words joined by
single blanks, so a phrase stands wherever its words stand consecutively, across any
punctuation or line break, overlaps included. Every expression and every phrase has an
openness from 0 (nothing known) to 1 (permissive): ``or`` takes the better side, ``and`` the
worse one, ``with`` raises its left side half of the way to 1. The score of a document is the
least openness of what it holds, as all its notices bind together.

Cases: a NULL text is empty (no words, no places, empty labels, score 0); an empty table gives
an empty table; repeated rows are scanned each; other columns pass through, except those called
like a result, which are replaced. An expression with
unbalanced brackets or missing operands gives no label.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import map_texts, table

#: The phrases and labels every scan must count.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases.
PHRASES = {
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3", "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl", "mozilla public license": "mpl", "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0 1 0": "cc0",
    "dedicated to the public domain": "public-domain", "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Openness by the start of a label, the longest start counts; other identifiers have UNKNOWN.
OPENNESS = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0, "cc-by": 0.9,
            "cc-by-sa": 0.6, "mpl": 0.7, "lgpl": 0.6, "epl": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.3, "cc-by-nc": 0.2,
            "all-rights-reserved": 0.05}
UNKNOWN = 0.1
COLUMNS = [("n_words", LongType()), ("n_base", LongType()), ("first_word", LongType()), ("last_word", LongType()),
           ("base_labels", StringType()), ("labels", StringType()), ("score", DoubleType())]

#: Lower case for A-Z, a blank for every ASCII character that stands in no word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
EXPRESSION = re.compile(r"spdx-license-identifier[:\x20\t]+([^\n\r]*)", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:_-]+")
STRENGTH = {"or": 1, "and": 2, "with": 3}


def openness(label: str) -> float:
    return next((OPENNESS[label[:n]] for n in range(len(label), 0, -1) if label[:n] in OPENNESS), UNKNOWN)


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order; None if the expression is malformed.
    Reading ends where two operands follow each other, as prose may follow a tag on its line."""
    out, ops, operand = [], [], False
    for t in TOKEN.findall(expression):
        low = t.lower().strip(".:") if t not in "()" else t
        if low in STRENGTH:
            if not operand:
                return None
            while ops and ops[-1] != "(" and STRENGTH[ops[-1]] >= STRENGTH[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = False
        elif low == "(":
            if operand:
                break
            ops.append(low)
        elif low == ")":
            if not operand or "(" not in ops:
                return None
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif low:
            if operand:
                break
            out.append(low)
            operand = True
    if not operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Identifiers of an expression and its openness."""
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    stack: list[tuple[set[str], float]] = []
    for t in postfix:
        if t not in STRENGTH:
            stack.append(({t}, openness(t)))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        stack.append((a | b, {"or": max(x, y), "and": min(x, y), "with": x + (1 - x) / 2}[t]))
    return stack[0]


@lru_cache(maxsize=1)
def automaton():
    a = ahocorasick.Automaton()
    for phrase, label in {**PHRASES, **BASE, TAG: ""}.items():
        a.add_word(f" {phrase} ", (phrase, label))
    a.make_automaton()
    return a


def scan_text(text: str) -> tuple:
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    base, labels, places, worst, tagged = set(), set(), [], [], False
    seen = at = 0
    for end, (phrase, label) in automaton().iter(line):
        if phrase == TAG:
            tagged = True
            continue
        labels.add(label)
        worst.append(openness(label))
        if phrase in BASE:
            base.add(label)
            seen, at = seen + line.count(" ", at, end), end  # matches come by their ends, so every blank is counted once
            places.append(seen - 1 - phrase.count(" "))
    if tagged:
        for m in EXPRESSION.finditer(text):
            found = evaluate(m[1])
            if found:
                labels |= found[0]
                worst.append(found[1])
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), min(worst, default=0.0))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the columns of ``COLUMNS``."""
    rest = [c for c in docs.columns if c != text and c not in dict(COLUMNS)]
    src = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(text), F.lit("")).alias(text))
    schema = StructType([*src.drop(text).schema, *(StructField(n, t) for n, t in COLUMNS)])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = zip(*map(scan_text, b.column(b.num_columns - 1).to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v, t) for v, t in zip(found, kinds, strict=True))],
                                          names=[*b.schema.names[:-1], *(n for n, _ in COLUMNS)])

    return map_texts(src, run, schema, text)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
