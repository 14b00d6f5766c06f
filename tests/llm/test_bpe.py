import hashlib
import random

from tokenizers import Tokenizer

from autotab.llm import bpe

PATH = bpe.vocabulary_path()


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    random.seed(7)
    pick = [lambda: random.randrange(32, 127), lambda: random.randrange(0, 0xD800), lambda: random.randrange(0x10000, 0x1FFFF), lambda: 32, lambda: 10]
    return (["", " ", "a" * 3000, "ab" * 2000, "<|endoftext|>x <|endoftext|>", " \n\n  x\t\x1c\x85\xa0 y", "don't I'LL we're", "zß 　 東京"]
            + ["".join(chr(random.choice(pick)()) for _ in range(200)) for _ in range(50)])


def test_ids_and_text_equal_the_library():
    t, m, texts = library(), bpe.MergeTable(PATH), odd_texts()
    ids, counts = m.encode(texts)
    want = t.encode_batch(texts, add_special_tokens=False)
    assert counts.tolist() == [len(e.ids) for e in want]
    assert ids.tolist() == [i for e in want for i in e.ids]
    assert m.decode(ids, counts) == [t.decode(e.ids, skip_special_tokens=False) for e in want] == texts


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    m = bpe.MergeTable(PATH)
    first = m.encode(["one two three four five six seven", "one two"])[0].tolist()
    m.encode(["other words come in here now"])
    assert m.encode(["one two three four five six seven", "one two"])[0].tolist() == first


def test_frame_with_nulls_repeats_and_clashing_names(spark):
    t = library()
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, None, None), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.words or "", r.ids, r.decoded) for r in got) == sorted(
        (a or 0, c or "", t.encode(b or "", add_special_tokens=False).ids, b or "") for a, b, c in rows)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_query_against_the_library(spark):
    d = "/root/testdata/sf0.001"
    t = library()
    got = {r.doc_id: r for r in bpe.op7_bpe(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)]
        assert [got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256] == [len(ids), *sha]
