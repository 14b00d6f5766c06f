"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every historical version of a file is content-addressed (SHA-256 of its text). The ledger has
one record per scan of a blob: the rule versions that were run and what they found. A scan looks
only at (blob, rule version) pairs that no record holds, once for each blob however many paths
and versions share it; findings then join back to all paths by the blob's address.

Places come from pairing the matches of a rule (``regexp_extract_all``) with the text between
them (``split`` by the same pattern): both go through the text leftmost and non-overlapping, so
running lengths give start and end in code points, in time linear in the text. Matches that fail a rule's length test are
dropped after matching, so they still use up their characters.

Cases: a NULL text is empty and has no findings; empty tables give empty tables; repeated paths
are reported each; an empty ledger is a ledger never written. Columns of ``versions`` beside the
text pass through; one called ``blob`` or ``findings`` is replaced in ``findings_of``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import carried, restored, table, whole_text


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The first three are fixed; equal starts are ordered as listed. {16,} after AKIA and {32,} find exactly
#: the long enough ones of all maximal runs, so their length test is part of the pattern.
RULES = (
    Rule("assign", ASSIGN, 8, 2),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")
MARK = "[SECRET]"
#: Items appended to one array at a time; code points of a piece of text that is being redacted.
BLOCK, PIECE = 256, 1024
SPAN = "struct<start:int,rule:int,kind:string,end:int>"
LEDGER = f"blob binary, rules array<string>, findings array<{SPAN}>"


def address(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Array of what ``step`` (state, item) -> (state, emitted) gives out for every item, in order. Appending to
    an array copies it, so BLOCK items fill an array of their own and only blocks are appended to the result."""
    empty = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        state, emitted = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(emitted)).alias("out"))

    def over(xs: Column) -> Column:
        def block(acc: Column, b: Column) -> Column:
            done = F.aggregate(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["state"].alias("state"), empty.alias("out")), one)
            return bound(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["blocks"], F.array(d["out"])).alias("blocks")))

        blocks = F.sequence(F.lit(0), F.floor(F.size(xs) / BLOCK).cast("int"))
        return F.aggregate(blocks, F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("blocks")), block, lambda a: F.flatten(a["blocks"]))

    return bound(items, over)


def spans_of(text: Column, order: int, rule: Rule) -> Column:
    """array<SPAN> of one rule in ``text``; the pairing work is done only where the rule matches at all."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    steps = F.filter(F.arrays_zip(hits.alias("hit"), F.split(text, rule.pattern, -1).alias("gap")), lambda s: s["hit"].isNotNull())
    ok = lambda h: F.length(F.regexp_extract(h, rule.pattern, rule.group) if rule.group else h) >= rule.least

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        start = at + F.length(s["gap"])
        end = start + F.length(s["hit"])
        span = F.struct(start.alias("start"), F.lit(order).alias("rule"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return end, F.when(ok(s["hit"]), span)

    found = F.filter(running(steps, F.lit(0), step, SPAN), lambda s: s.isNotNull())
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def each_once(spans: Column) -> Column:
    """``spans`` sorted, equal ones once."""
    return bound(F.array_sort(spans), lambda xs: F.filter(xs, lambda s, i: (i == 0) | (s != F.get(xs, i - 1))))


def scan(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger records for the blobs of ``versions`` that some rule version has not seen."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    # one row per blob: copies meet only after every task has merged its own
    blobs = versions.select(whole_text(text).alias("text")).select(address(F.col("text")).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    todo = (blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))))
            .where(F.size("rules") > 0))
    found = [F.when(F.array_contains("rules", r.key), spans_of(F.col("text"), i, r)).otherwise(F.array().cast(f"array<{SPAN}>")) for i, r in enumerate(rules)]
    return todo.select("blob", "rules", F.array_sort(F.concat(*found)).alias("findings"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All records of a ledger folder; empty if nothing was written to it yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scans what the ledger at ``path`` lacks, appends the records and returns the whole ledger.
    Records are sets of scanned pairs, so a repeated update adds nothing."""
    spark = versions.sparkSession
    scan(versions, read_ledger(spark, path), rules, text).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings_of(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Every path with the findings of its blob under the current rule versions (an array, empty if none)."""
    addressed = versions.withColumn("blob", address(whole_text(text)))
    addressed = addressed if keep_text else addressed.drop(text)
    kinds = [r.kind for r in rules]
    # records of older rule versions are left out: a finding counts if its record ran the current version
    current = F.array(*[F.lit(r.key) for r in rules])
    record = ledger.where(F.size("findings") > 0).select(
        "blob", F.filter("findings", lambda s: F.array_contains(F.transform(F.array_intersect("rules", current), lambda k: F.split(k, "@")[0]), s["kind"])).alias("f"))
    merged = record.groupBy("blob").agg(each_once(F.flatten(F.collect_list("f"))).alias("findings"))
    out = addressed.join(merged, "blob", "left").drop("blob")
    return out.withColumn("findings", F.filter(F.coalesce("findings", F.array().cast(f"array<{SPAN}>")), lambda s: s["kind"].isin(kinds)))


def redacted(text: Column, findings: Column) -> Column:
    """``text`` with every stretch covered by findings replaced by MARK. Pieces of PIECE code points are cut once; what
    stands between two findings is put together from those it touches, so no finding walks through the whole text."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    gap = "struct<from:int,to:int>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.struct(at.alias("from"), s["start"].alias("to")))

    def between(ps: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        joined = F.array_join(F.slice(ps, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.when(b > a, F.substring(joined, a % PIECE + 1, b - a)).otherwise("")

    def whole(ps: Column) -> Column:
        gaps = F.filter(running(findings, F.lit(0), step, gap), lambda g: g.isNotNull())
        marked = F.array_join(F.transform(gaps, lambda g: F.concat(between(ps, g["from"], g["to"]), F.lit(MARK))), "")
        return F.concat(marked, between(ps, F.array_max(F.transform(findings, lambda s: s["end"])), F.length(text)))

    return F.when(F.size(findings) > 0, bound(pieces, whole)).otherwise(text)


def fresh_ledger(spark: SparkSession) -> str:
    """A new, empty ledger folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4()}"


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in their texts marked out."""
    ledger = update_ledger(docs, fresh_ledger(docs.sparkSession))
    found = findings_of(carried(docs, "text"), ledger, keep_text=True)
    return restored(found.withColumn("text", redacted(F.col("text"), F.col("findings"))), docs.columns)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings_of(docs, update_ledger(docs, fresh_ledger(spark)))
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("findings")).alias("spans"))


def _matches(i: int, r: Rule) -> str:
    p = r.pattern.replace("'", "''")
    ok = f"len(regexp_extract(h, '{p}', {r.group})) >= {r.least}" if r.group else "TRUE"
    return (f"SELECT doc, {i} AS rule, '{r.kind}' AS kind, s AS start, s + len(h) AS stop FROM (SELECT doc, hits[i] AS h, "
            "CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s "
            f"FROM (SELECT doc, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM d))) WHERE {ok}")


OP2_SQL = ("WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents), m AS ("
           + " UNION ALL ".join(_matches(i, r) for i, r in enumerate(RULES)) + "), "
           "g AS (SELECT doc, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, "
           "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) FILTER (rule < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) AS spans FROM m GROUP BY doc) "
           "SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans "
           "FROM d LEFT JOIN g USING (doc)")
