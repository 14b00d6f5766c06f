from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline as cp
from autotab.llm import bpe, mixing, secret_scan
from autotab.llm.common import table
from test_neardup import brute_classes
from test_quality import brute_counts

D = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = table(spark, D, "documents")
    stages = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "tokens"]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]

    good = stages["quality"](spark, docs, D)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    # sf0.001 has too few labels for any rule but the base one
    assert kept == {i for i, t, _ in rows if not brute_counts(t)["base_failed"]}

    good = spark.createDataFrame(good.collect(), docs.schema)
    one = stages["near_duplicates"](spark, good, D)
    assert one.columns == docs.columns
    left = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(brute_classes(left)))

    one = spark.createDataFrame(one.collect(), docs.schema)
    clean = stages["secrets"](spark, one, D)
    assert clean.columns == docs.columns
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (one, clean))
    assert before.keys() == after.keys()
    found = {r.doc_id: r.findings for r in secret_scan.findings_of(one, secret_scan.update_ledger(one, secret_scan.fresh_ledger(spark))).collect()}
    for i, t in before.items():
        marks = sorted({c for s in found[i] for c in range(s.start, s.end)})
        rest = "".join(c if k not in set(marks) else "\0" for k, c in enumerate(t))
        assert after[i].replace(secret_scan.MARK, "") == rest.replace("\0", "")
    again = secret_scan.findings_of(clean, secret_scan.update_ledger(clean, secret_scan.fresh_ledger(spark)))
    assert again.where("size(findings) > 0").count() == 0

    clean = spark.createDataFrame(clean.collect(), docs.schema)
    mixed = stages["mixing"](spark, clean, D)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    size = {r.doc_id: len(r.text.encode().split()) for r in clean.collect()}
    goal = {r.source: r.target for r in mixing.source_targets(clean.withColumn("size", mixing.size_of(clean.text))).collect()}
    source = {r.doc_id: r.source for r in clean.collect()}
    for s, target in goal.items():
        words = sum(n * size[i] for i, n in times.items() if source[i] == s)
        assert abs(words - target) <= max(size[i] for i in size if source[i] == s) / 2
    assert max(times.values()) <= 2

    mixed = spark.createDataFrame(mixed.collect(), docs.schema)
    tokens = stages["tokens"](spark, mixed, D)
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    out = tokens.collect()
    assert Counter(r.doc_id for r in out) == times
    assert all(r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in out)


def test_run_is_the_chain_of_stages(spark):
    out = cp.run(spark, D)
    assert out.columns == [c for c in table(spark, D, "documents").columns if c != "text"] + ["ids", "n_tokens"]
    again = cp.run(spark, D)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
