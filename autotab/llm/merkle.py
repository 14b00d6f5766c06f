"""Merkle manifest of a dataset as postorder append logs.

Every row is a leaf. The leaves of a chain (here: a source) stand in order; while a level has several nodes, every
``FAN`` consecutive ones become one node of the next, the last run as it is. A chain is cut into segments of
``FAN ** HEIGHT`` leaves, aligned, so that each segment is a whole subtree: one builder reads its leaves once
and appends every node in the order in which it is completed, children before their parent. Nodes of the levels above
come from the same builders over the segments' roots, layer by layer, until a chain has one root; the chains' roots
make a last chain. Where a node stands in its segment's log follows from the sizes of the full subtrees before it:
the node of level l whose last leaf is leaf e-1 of the segment stands at sum_m floor((e-1) / FAN^m) + l (``address``). A proof
is read from the logs at such places, without a search and without building anything again.

Leaves are hashed by Spark's own functions, so texts never move. Positions in a chain come from range partitions and
their counts, so a source that holds a third of all rows is ordered and built by many tasks. A segment is one row
of about 70 kB. Segments are joined to the layer above them, one row each; documents are not shuffled again.

Cases: NULLs in any column hash as ``-``; a NULL id comes first in its source and counts as the empty text where the
crc decides; rows with equal ids stand in the order of their leaves, equal rows are leaves each; a source of
one row is its own root; an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table

FAN, HEIGHT = 3, 6
#: Hexadecimal digits of a digest.
WIDE = 64
#: Rows that a range partition should hold.
RANGE_ROWS = 20_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
SEGMENT = "chain string, seg long, height int, ids array<long>, presented array<string>, log string, root string"


def hashed(parts: bytes) -> bytes:
    return hashlib.sha256(parts).hexdigest().encode()


def field(value: Column) -> Column:
    """``-`` for NULL, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in COLUMNS]), 256)


def height_of(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while FAN ** h < n:
        h += 1
    return h


def build_log(leaves: list[bytes], height: int) -> list[bytes]:
    """All nodes of one segment in the order of completion; the last is its root, ``height`` levels up."""
    log, open_runs = [], [[] for _ in range(height + 1)]

    def complete(level: int, node: bytes) -> None:
        log.append(node)
        open_runs[level].append(node)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        complete(level + 1, hashed(b"".join(run)))

    for node in leaves:
        complete(0, node)
        level = 0
        while level < height and len(open_runs[level]) == FAN:
            close(level)
            level += 1
    for level in range(height):
        if open_runs[level]:
            close(level)
    return log


def address(level: int, index: int, n: int) -> int:
    """Place of a node in the log of a segment of n leaves."""
    before, place = min((index + 1) * FAN ** level, n) - 1, level
    while before:
        place += before
        before //= FAN
    return place


def siblings(log: str | bytes, n: int, height: int, index: int) -> list[tuple]:
    """(left, right) siblings of a leaf, level by level."""
    out = []
    for level in range(height):
        first, nodes = index - index % FAN, -(-n // FAN ** level)
        at = [address(level, i, n) * WIDE for i in range(first, min(first + FAN, nodes)) if i != index]
        left = index - first
        out.append((log[:0].join(log[a:a + WIDE] for a in at[:left]), log[:0].join(log[a:a + WIDE] for a in at[left:])))
        index //= FAN
    return out


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    return reduce(lambda x, step: hashed(step[0] + x + step[1]), path, node)


def numbered(df: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """``df`` with the 0-based ``position`` of each row in its chain and the ``size`` of the chain (chains may be NULL)."""
    n = df.count()
    parts = max(1, -(-n // RANGE_ROWS))
    by = [F.col(c).asc_nulls_first() for c in (chain, *order)]
    ranged = cut_lineage(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(chain, "__part").agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy(chain).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col(chain).alias("__chain"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__first"),
                           F.sum("__n").over(Window.partitionBy(chain)).alias("size"))
    inside = Window.partitionBy(chain, "__part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    d = ranged.withColumn("position", F.row_number().over(inside) - 1)
    d = d.join(firsts, F.col(chain).eqNullSafe(F.col("__chain")) & (F.col("__part") == F.col("__p")))
    return d.withColumn("position", (F.col("position") + F.col("__first")).cast("long")).drop("__part", "__p", "__chain", "__first")


def segments(items: DataFrame) -> DataFrame:
    """Built segments of items (chain, position, size, digest, id, presented)."""
    whole = FAN ** HEIGHT

    def build(group: pa.Table) -> pa.Table:
        rows = group.sort_by("position").to_pydict()
        height = HEIGHT if rows["size"][0] > whole else height_of(rows["size"][0])
        log = build_log([d.encode() for d in rows["digest"]], height)
        out = {"chain": rows["chain"][:1], "seg": [rows["position"][0] // whole], "height": [height], "ids": [rows["id"]],
               "presented": [rows["presented"]], "log": [b"".join(log).decode()], "root": [log[-1].decode()]}
        return pa.table(out, pa.schema([("chain", pa.string()), ("seg", pa.int64()), ("height", pa.int32()), ("ids", pa.list_(pa.int64())),
                                        ("presented", pa.list_(pa.string())), ("log", pa.string()), ("root", pa.string())]))

    d = items.withColumn("seg", F.floor(F.col("position") / whole).cast("long"))
    return cut_lineage(d.select("chain", "seg", "position", "size", "digest", "id", "presented").groupBy("chain", "seg").applyInArrow(build, SEGMENT))


def layers(items: DataFrame) -> list[DataFrame]:
    """Segments of the items, of their roots, of those roots' roots, until every chain has one."""
    out = [segments(items)]
    while out[-1].agg(F.max("seg")).first()[0]:
        size = F.count(F.lit(1)).over(Window.partitionBy("chain"))
        out.append(segments(out[-1].select("chain", F.col("seg").alias("position"), size.alias("size"), F.col("root").alias("digest"),
                                           F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("presented"))))
    return out


def item_paths(segs: DataFrame) -> DataFrame:
    """(chain, position, path, top) of every item of a layer whose segments carry ``above``, their own path, and ``top``."""
    whole = FAN ** HEIGHT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = len(r["ids"])
                paths = [[{"left": x, "right": y} for x, y in siblings(r["log"], n, r["height"], i)] + r["above"] for i in range(n)]
                yield pa.RecordBatch.from_pylist([{"chain": r["chain"], "position": r["seg"] * whole + i, "path": p, "top": r["top"]} for i, p in enumerate(paths)],
                                                 pa.schema([("chain", pa.string()), ("position", pa.int64()), ("top", pa.string()),
                                                            ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))]))

    return segs.select("chain", "seg", "height", "ids", "log", "above", "top").mapInArrow(run, f"chain string, position long, top string, path {PATH}")


def with_paths(tree: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The lowest layer with ``above``: siblings from a segment's root upwards, through all layers and ``roots`` (chain, path)."""
    top = roots.select(F.col("chain").alias("__chain"), F.col("path").alias("above"), "top")
    segs = tree[-1].join(top, F.col("chain").eqNullSafe(F.col("__chain"))).drop("__chain")
    for lower in reversed(tree[:-1]):
        up = item_paths(segs).select(F.col("chain").alias("__chain"), F.col("position").alias("__seg"), F.col("path").alias("above"), "top")
        segs = lower.join(up, F.col("chain").eqNullSafe(F.col("__chain")) & (F.col("seg") == F.col("__seg"))).drop("__chain", "__seg")
    return segs


def proofs(segs: DataFrame) -> DataFrame:
    """Per leaf: id, leaf, subroot, root, proof_sha256, folded_root, verified; siblings come from the logs."""
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = pa.schema([("id", pa.int64()), *[(n, pa.string()) for n in names[1:]], ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                log, n, root = r["log"].encode(), len(r["ids"]), r["top"].encode()
                above = [(s["left"].encode(), s["right"].encode()) for s in r["above"]]
                rest = b"".join(x + y for x, y in above)
                out = []
                for i, (key, shown) in enumerate(zip(r["ids"], r["presented"], strict=True)):
                    own = siblings(log, n, r["height"], i)
                    a = address(0, i, n) * WIDE
                    folded = fold(shown.encode(), own + above)
                    out.append((key, log[a:a + WIDE], r["subroot"], root, hashed(b"".join(x + y for x, y in own) + rest), folded, folded == root))
                columns = [[x.decode() if isinstance(x, bytes) else x for x in c] for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return segs.select("height", "ids", "presented", "log", "above", "top", "subroot").mapInArrow(
        run, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, presented: Column) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(leaf segments with their paths to the root, layers of the sources' trees, layers of the tree above).

    ``presented``: the leaf that each row shows to the check; the trees hold the rows as they are."""
    rows = cut_lineage(docs.select(F.col("source").alias("chain"), F.col("doc_id").cast("long").alias("id"), leaf().alias("digest"), presented.alias("presented")))
    trees = layers(numbered(rows, "chain", ["id", "digest"]))
    subroots = trees[-1].select("chain", F.col("root").alias("subroot"))
    none = F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("presented")
    ordered = cut_lineage(numbered(subroots.withColumn("all", F.lit("")), "all", ["chain"]))
    over = layers(ordered.select(F.col("all").alias("chain"), "position", "size", F.col("subroot").alias("digest"), *none))
    root = over[-1].select("chain", F.array().cast(PATH).alias("path"), F.col("root").alias("top"))
    paths = item_paths(with_paths(over, root)).select(F.col("position").alias("__position"), "path", "top")
    roots = ordered.join(paths, F.col("position") == F.col("__position")).select("chain", "path", "top", "subroot")
    segs = with_paths(trees, roots)
    mine = subroots.select(F.col("chain").alias("__chain"), "subroot")
    return segs.join(mine, F.col("chain").eqNullSafe(F.col("__chain"))).drop("__chain"), trees, over


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    presented = F.when(crc % 2 == 0, leaf(text=F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(leaf())
    return proofs(manifest(table(spark, sf_dir, "documents"), presented)[0]).withColumnRenamed("id", "doc_id")


#: crc32 of the decimal digits, bit by bit, its lowest bit inverted at the end; levels by recursion.
OP12_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS k,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: c <> ''), lambda c: CAST(ascii(c) AS BIGINT))),
                     lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                              lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) % 2 AS low
  FROM documents),
f AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
             replace(text, chr(10), '') AS bare FROM d),
h AS (SELECT k, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN low = 1 THEN sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS shown FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM h),
s AS (SELECT source, 0 AS lvl, pos AS i, n, leaf AS digest FROM p
      UNION ALL
      SELECT source, lvl + 1, i // 3, CAST(ceil(n / 3.0) AS BIGINT), sha256(string_agg(digest, '' ORDER BY i)) FROM s WHERE n > 1 GROUP BY source, lvl, i // 3, n),
tops AS (SELECT source, digest AS subroot, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM s WHERE n = 1),
t AS (SELECT 0 AS lvl, pos AS i, n, subroot AS digest FROM tops
      UNION ALL
      SELECT lvl + 1, i // 3, CAST(ceil(n / 3.0) AS BIGINT), sha256(string_agg(digest, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lvl, i // 3, n),
x AS (SELECT k, 0 AS lvl, height, p.source, p.pos AS i, tops.pos AS j, shown AS node, '' AS proof FROM p JOIN tops ON p.source IS NOT DISTINCT FROM tops.source
      UNION ALL
      SELECT x.k, x.lvl + 1, x.height, x.source, CASE WHEN x.lvl < x.height THEN x.i // 3 ELSE 0 END, CASE WHEN x.lvl < x.height THEN x.j ELSE x.j // 3 END,
             sha256(string_agg(CASE WHEN e.i = x.i THEN x.node ELSE e.digest END, '' ORDER BY e.i)),
             x.proof || coalesce(string_agg(CASE WHEN e.i <> x.i THEN e.digest END, '' ORDER BY e.i), '')
      FROM (SELECT k, lvl, height, source, j, node, proof, CASE WHEN lvl < height THEN i ELSE j END AS i, CASE WHEN lvl < height THEN lvl ELSE lvl - height END AS at FROM x) x
      JOIN (SELECT source, lvl, i, n, digest, true AS inside FROM s UNION ALL SELECT NULL, lvl, i, n, digest, false FROM t) e
        ON e.inside = (x.lvl < x.height) AND (NOT e.inside OR e.source IS NOT DISTINCT FROM x.source) AND e.lvl = x.at AND e.i // 3 = x.i // 3 AND e.n > 1
      GROUP BY x.k, x.lvl, x.height, x.source, x.i, x.j, x.node, x.proof),
done AS (SELECT k, node AS folded_root, sha256(proof) AS proof_sha256 FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY lvl DESC) = 1)
SELECT p.doc_id, p.leaf, tops.subroot, r.digest AS root, done.proof_sha256, done.folded_root, done.folded_root = r.digest AS verified
FROM p JOIN tops ON p.source IS NOT DISTINCT FROM tops.source JOIN done USING (k) CROSS JOIN (SELECT digest FROM t WHERE n = 1) r
"""
