import hashlib
import zlib

import pytest

from autotab.llm import merkle
from autotab.llm.merkle import F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def hash_row(i, text, lang, source, n):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def up(nodes):
    return [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]


def steps(nodes, i):
    """[(left siblings, right siblings)] and the root, level by level."""
    out = []
    while len(nodes) > 1:
        first = i - i % 3
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + 3])))
        nodes, i = up(nodes), i // 3
    return out, nodes[0]


def brute(rows):
    chains = {}
    for r in rows:
        chains.setdefault(r[3], []).append(r)
    order = sorted(chains, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(chains[s], key=lambda r: (r[0] is not None, r[0] or 0, hash_row(*r))) for s in order}
    subroots = [steps([hash_row(*r) for r in leaves[s]], 0)[1] for s in order]
    out = []
    for k, s in enumerate(order):
        digests = [hash_row(*r) for r in leaves[s]]
        top, root = steps(subroots, k)
        for j, r in enumerate(leaves[s]):
            path = steps(digests, j)[0] + top
            odd = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2
            node = digests[j] if odd or r[1] is None else hash_row(r[0], r[1].replace("\n", ""), *r[2:])
            for left, right in path:
                node = sha(left + node + right)
            out.append((r[0], digests[j], subroots[k], root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def run(spark, rows, tmp_path, extra="'x' AS chain, 7 AS digest, 1 AS position, 'y' AS id"):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", *extra.split(", ")).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


def some_rows(n):
    return [(i * 7 % n, f"text {i}\nline" if i % 3 else f"flat {i}", "en", None if i % 11 == 0 else f"s{min(i % 13, 3)}", i) for i in range(n)]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_equals_brute_force_with_many_layers(spark, monkeypatch, tmp_path, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 40)
    rows = some_rows(230)
    assert run(spark, rows, tmp_path) == sorted(brute(rows), key=repr)


def test_nulls_ties_repeats_and_odd_texts(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "a\nb", "en", None, 3), (5, "", "en", "ä", 0), (5, "", "en", "ä", 0), (5, "z", "en", "ä", 1),
            (6, "\n\n", None, "z", None), (-3, "é\n" * 50_000, "fr", "z", 100_000), (8, "x\n", "en", "", 2), (9, None, "en", "z", 0)]
    assert run(spark, rows, tmp_path) == sorted(brute(rows), key=repr)


def test_one_row_and_no_rows(spark, tmp_path):
    one = [(3, "a", "en", "s", 1)]
    assert run(spark, one, tmp_path / "one") == brute(one)
    assert run(spark, [], tmp_path / "none") == []


def test_addresses_follow_from_sizes():
    for n in range(1, 60):
        height = merkle.height_of(n)
        leaves = [sha(str(i)).encode() for i in range(n)]
        log, level, l = merkle.build_log(leaves, height), leaves, 0
        while True:
            assert [log[merkle.address(l, i, n)] for i in range(len(level))] == level
            if len(level) == 1:
                break
            level, l = [x.encode() for x in up([x.decode() for x in level])], l + 1
        assert len(set(range(len(log)))) == merkle.address(height, 0, n) + 1


def test_a_raised_segment_keeps_single_runs():
    log = merkle.build_log([b"a" * 64], 3)
    assert len(log) == 4 and log[merkle.address(3, 0, 1)] == log[-1] == merkle.hashed(merkle.hashed(merkle.hashed(b"a" * 64)))


def test_manifest_keeps_the_logs(spark):
    d = spark.createDataFrame(some_rows(50), SCHEMA)
    _, trees, over = merkle.manifest(d, merkle.leaf())
    n = {r.chain: len(r.ids) for r in trees[0].collect()}
    assert sum(n.values()) == 50 and over[-1].count() == 1 and trees[0].where(F.length("log") % 64 != 0).count() == 0
