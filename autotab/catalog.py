"""Registered queries (Spark) and their DuckDB oracle SQL.

Each query takes (spark, sf_dir) and returns a DataFrame; computed columns carry
the same aliases as the oracle SQL. Doubles are rounded to 6 decimals on both
sides so the value hashes compare the math, not the summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ROUND = 6


def rounded(df: DataFrame, digits: int = ROUND) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# ---------------------------------------------------------------------------
# SQL twins of the fixtures (DuckDB dialect)
# ---------------------------------------------------------------------------

def U(expr: str, seed: int) -> str:
    """DuckDB twin of keys.unit_uniform for one integer key column."""
    return (f"(CAST(CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR) || '#{seed}'), 1, 15)) AS BIGINT)"
            f" AS DOUBLE) / 1.152921504606846976e18)")


def H(expr: str, seed: int) -> str:
    """DuckDB twin of keys.row_hash for one integer key column."""
    return f"CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR) || '#{seed}'), 1, 15)) AS BIGINT)"


SCORED = """
scored AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, q,
         CAST(q AS DOUBLE) / 100.0 AS score,
         CAST((q + l_partkey % 100 - 50) >= 60 AS INTEGER) AS y,
         CAST(q >= 50 AS INTEGER) AS y_pred
  FROM (SELECT *, CAST(ROUND(l_discount * 100) AS BIGINT) * 5 + CAST(l_quantity AS BIGINT) AS q
        FROM lineitem) t)
"""

SCORED_MULTI = f"""
sm0 AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y FROM orders),
sm1 AS (
  SELECT o_orderkey, y,
         {U('o_orderkey', 100)} + CASE WHEN y = 0 THEN 0.5 ELSE 0.0 END AS r0,
         {U('o_orderkey', 101)} + CASE WHEN y = 1 THEN 0.5 ELSE 0.0 END AS r1,
         {U('o_orderkey', 102)} + CASE WHEN y = 2 THEN 0.5 ELSE 0.0 END AS r2
  FROM sm0),
scored_multi AS (
  SELECT o_orderkey, y, r0 / (r0 + r1 + r2) AS p0, r1 / (r0 + r1 + r2) AS p1, r2 / (r0 + r1 + r2) AS p2
  FROM sm1),
scored_multi_p AS (
  SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS y_pred
  FROM scored_multi)
"""

ORDERS_ML = """
orders_ml AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
         CAST(year(o_orderdate) AS INTEGER) AS o_year, c_acctbal, c_mktsegment, n_name,
         CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS urgent
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""

ORDERS_REG = ORDERS_ML + f""",
orders_reg AS (
  SELECT *, o_totalprice * (CAST(0.9 AS DOUBLE) + CAST(0.2 AS DOUBLE) * {U('o_orderkey', 7)}) AS pred
  FROM orders_ml)
"""

DOCS_ML = """
docs_ml AS (
  SELECT d.doc_id, text, lang, source, n_chars, quality, toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""

DOCS_NULLS = """
docs_nulls AS (
  SELECT d.doc_id, text, lang, source, n_chars, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""

EVENTS_CAT = """
events_cat AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type, value, props,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text
  FROM events)
"""


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


# ---------------------------------------------------------------------------
# Metrics (2.11)
# ---------------------------------------------------------------------------
from .operators import metrics as M  # noqa: E402

SCORE_GROUPS = """
g AS (SELECT score AS s, CAST(SUM(y) AS DOUBLE) AS p, CAST(COUNT(*) - SUM(y) AS DOUBLE) AS n
      FROM scored GROUP BY score)
"""


@query("metric_roc_auc", W(SCORED, SCORE_GROUPS, """
c AS (SELECT *, SUM(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS nb FROM g)""")
       + "SELECT ROUND(SUM(p * (nb + 0.5 * n)) / (SUM(p) * SUM(n)), 6) AS roc_auc FROM c")
def q_roc_auc(spark, d):
    return rounded(M.roc_auc(fx.scored(spark, d)))


@query("metric_avg_precision", W(SCORED, SCORE_GROUPS, """
c AS (SELECT *, SUM(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             SUM(p + n) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM g)""")
       + "SELECT ROUND(SUM(p * tp / a) / SUM(p), 6) AS avg_precision FROM c")
def q_avg_precision(spark, d):
    return rounded(M.average_precision(fx.scored(spark, d)))


@query("metric_log_loss", W(SCORED) + """
SELECT ROUND(AVG(-LN(LEAST(GREATEST(CASE WHEN y = 1 THEN score ELSE 1 - score END,
                                    2.220446049250313e-16), 1 - 2.220446049250313e-16))), 6) AS log_loss
FROM scored""")
def q_log_loss(spark, d):
    return rounded(M.log_loss_binary(fx.scored(spark, d)))


@query("metric_log_loss_multi", W(SCORED_MULTI) + """
SELECT ROUND(AVG(-LN(LEAST(GREATEST(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END,
                                    2.220446049250313e-16), 1 - 2.220446049250313e-16))), 6) AS log_loss
FROM scored_multi""")
def q_log_loss_multi(spark, d):
    return rounded(M.log_loss_multi(fx.scored_multi(spark, d)))


@query("metric_brier", W(SCORED) + "SELECT ROUND(AVG((score - y) * (score - y)), 6) AS brier FROM scored")
def q_brier(spark, d):
    return rounded(M.brier(fx.scored(spark, d)))


@query("metric_accuracy", W(SCORED) + "SELECT ROUND(AVG(CAST(y = y_pred AS DOUBLE)), 6) AS accuracy FROM scored")
def q_accuracy(spark, d):
    return rounded(M.accuracy(fx.scored(spark, d)))


F1_MACRO_SQL = """
lab AS (SELECT CAST(y AS VARCHAR) AS label, CAST(y = y_pred AS BIGINT) AS tp, 1 AS nt, 0 AS np FROM {t}
        UNION ALL SELECT CAST(y_pred AS VARCHAR), 0, 0, 1 FROM {t}),
per AS (SELECT label, SUM(tp) AS tp, SUM(nt) AS nt, SUM(np) AS np FROM lab GROUP BY label)
"""


@query("metric_f1_macro", W(SCORED_MULTI, F1_MACRO_SQL.format(t="scored_multi_p"))
       + "SELECT ROUND(AVG(CASE WHEN nt + np = 0 THEN 0.0 ELSE 2.0 * tp / (nt + np) END), 6) AS f1_macro FROM per")
def q_f1_macro(spark, d):
    return rounded(M.f1_macro(fx.scored_multi(spark, d)))


@query("metric_roc_auc_ovr", W(SCORED_MULTI, """
ex AS (SELECT 0 AS cls, CAST(y = 0 AS INTEGER) AS yb, p0 AS s FROM scored_multi
       UNION ALL SELECT 1, CAST(y = 1 AS INTEGER), p1 FROM scored_multi
       UNION ALL SELECT 2, CAST(y = 2 AS INTEGER), p2 FROM scored_multi),
g AS (SELECT cls, s, CAST(SUM(yb) AS DOUBLE) AS p, CAST(COUNT(*) - SUM(yb) AS DOUBLE) AS n FROM ex GROUP BY cls, s),
c AS (SELECT *, SUM(n) OVER (PARTITION BY cls ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS nb
      FROM g),
a AS (SELECT cls, SUM(p * (nb + 0.5 * n)) / (SUM(p) * SUM(n)) AS auc FROM c GROUP BY cls)""")
       + "SELECT ROUND(AVG(auc), 6) AS roc_auc_ovr FROM a")
def q_roc_auc_ovr(spark, d):
    return rounded(M.roc_auc_ovr(fx.scored_multi(spark, d)))


@query("confusion_matrix", W(SCORED, """
lab AS (SELECT DISTINCT l FROM (SELECT CAST(y AS VARCHAR) AS l FROM scored UNION ALL
                                SELECT CAST(y_pred AS VARCHAR) FROM scored) t),
cnt AS (SELECT CAST(y AS VARCHAR) AS y_true, CAST(y_pred AS VARCHAR) AS y_pred, COUNT(*) AS n
        FROM scored GROUP BY 1, 2)""") + """
SELECT a.l AS y_true, b.l AS y_pred, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n
FROM lab a JOIN lab b ON TRUE LEFT JOIN cnt ON cnt.y_true = a.l AND cnt.y_pred = b.l""")
def q_confusion(spark, d):
    return M.confusion_matrix(fx.scored(spark, d))


@query("roc_curve", W(SCORED, SCORE_GROUPS, """
c AS (SELECT s, SUM(p) OVER w AS tp, SUM(n) OVER w AS fp, SUM(p) OVER () AS pp, SUM(n) OVER () AS nn
      FROM g WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
       + "SELECT ROUND(s, 6) AS threshold, ROUND(fp / nn, 6) AS fpr, ROUND(tp / pp, 6) AS tpr FROM c")
def q_roc_curve(spark, d):
    return rounded(M.roc_curve(fx.scored(spark, d)))


@query("pr_curve", W(SCORED, SCORE_GROUPS, """
c AS (SELECT s, SUM(p) OVER w AS tp, SUM(n) OVER w AS fp, SUM(p) OVER () AS pp
      FROM g WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
       + "SELECT ROUND(s, 6) AS threshold, ROUND(tp / (tp + fp), 6) AS precision, ROUND(tp / pp, 6) AS recall FROM c")
def q_pr_curve(spark, d):
    return rounded(M.pr_curve(fx.scored(spark, d)))


THRESH_GRID = """
grid AS (SELECT i, CASE WHEN i = 100 THEN 1.0 ELSE CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE) END AS t
         FROM range(0, 101) r(i)),
tot AS (SELECT CAST(SUM(y) AS DOUBLE) AS pp FROM scored),
f AS (SELECT grid.i, grid.t,
             CAST(SUM(CASE WHEN scored.score >= grid.t THEN scored.y ELSE 0 END) AS DOUBLE) AS tp,
             CAST(SUM(CASE WHEN scored.score >= grid.t THEN 1 ELSE 0 END) AS DOUBLE) AS pred
      FROM grid, scored GROUP BY grid.i, grid.t),
f1 AS (SELECT f.i, f.t, CASE WHEN pred + pp = 0 THEN 0.0 ELSE 2 * tp / (pred + pp) END AS f1 FROM f, tot)
"""


@query("best_threshold_f1", W(SCORED, THRESH_GRID)
       + "SELECT ROUND(t, 6) AS threshold, ROUND(f1, 6) AS f1 FROM f1 ORDER BY f1 DESC, i ASC LIMIT 1")
def q_best_f1(spark, d):
    return rounded(M.best_threshold_f1(fx.scored(spark, d)))


@query("best_threshold_youden", W(SCORED, SCORE_GROUPS, """
c AS (SELECT s, SUM(p) OVER w / SUM(p) OVER () - SUM(n) OVER w / SUM(n) OVER () AS j
      FROM g WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT * FROM c ORDER BY j DESC, s DESC LIMIT 1)""")
       + "SELECT ROUND(CASE WHEN j <= 0 THEN 1.0 ELSE LEAST(GREATEST(s, 0.0), 1.0) END, 6) AS threshold FROM b")
def q_youden(spark, d):
    return rounded(M.best_threshold_youden(fx.scored(spark, d)))


@query("best_threshold_pr", W(SCORED, SCORE_GROUPS, """
c AS (SELECT s, SUM(p) OVER w / (SUM(p) OVER w + SUM(n) OVER w) AS pr, SUM(p) OVER w / SUM(p) OVER () AS rc
      FROM g WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT s, 2 * pr * rc / (pr + rc + 1e-12) AS f1 FROM c)""")
       + "SELECT ROUND(s, 6) AS threshold, ROUND(f1, 6) AS f1 FROM f ORDER BY f1 DESC, s ASC LIMIT 1")
def q_best_pr(spark, d):
    return rounded(M.best_threshold_pr(fx.scored(spark, d)))


@query("apply_threshold", W(SCORED) + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, y,
       CAST(LEAST(GREATEST(score, 0.0), 1.0) >= 0.41 AS INTEGER) AS y_pred
FROM scored""")
def q_apply_threshold(spark, d):
    s = fx.scored(spark, d)
    return M.apply_threshold(s, 0.41).select(*fx.LINEITEM_KEY, "y", "y_pred")


@query("calibration_curve", W(SCORED, """
e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS qs FROM scored),
b AS (SELECT scored.*, (CASE WHEN score > qs[1] THEN 1 ELSE 0 END + CASE WHEN score > qs[2] THEN 1 ELSE 0 END +
                        CASE WHEN score > qs[3] THEN 1 ELSE 0 END + CASE WHEN score > qs[4] THEN 1 ELSE 0 END +
                        CASE WHEN score > qs[5] THEN 1 ELSE 0 END + CASE WHEN score > qs[6] THEN 1 ELSE 0 END +
                        CASE WHEN score > qs[7] THEN 1 ELSE 0 END + CASE WHEN score > qs[8] THEN 1 ELSE 0 END +
                        CASE WHEN score > qs[9] THEN 1 ELSE 0 END) AS bin
      FROM scored, e)""") + """
SELECT CAST(bin AS INTEGER) AS bin, COUNT(*) AS n, ROUND(AVG(CAST(y AS DOUBLE)), 6) AS frac_pos,
       ROUND(AVG(score), 6) AS mean_pred
FROM b GROUP BY bin""")
def q_calibration(spark, d):
    return rounded(M.calibration_curve(fx.scored(spark, d)))


@query("metric_regression", W(ORDERS_REG) + """
SELECT ROUND(SQRT(AVG((o_totalprice - pred) * (o_totalprice - pred))), 6) AS rmse,
       ROUND(AVG(ABS(o_totalprice - pred)), 6) AS mae,
       ROUND(1 - SUM((o_totalprice - pred) * (o_totalprice - pred)) / (VAR_POP(o_totalprice) * COUNT(*)), 6) AS r2
FROM orders_reg""")
def q_regression(spark, d):
    return rounded(M.regression_metrics(fx.orders_reg(spark, d), "o_totalprice", "pred"))


@query("residual_histogram", W(ORDERS_REG, """
r AS (SELECT o_totalprice - pred AS r FROM orders_reg),
st AS (SELECT MIN(r) AS lo, MAX(r) AS hi FROM r),
c AS (SELECT CAST(LEAST(FLOOR((r - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, COUNT(*) AS n FROM r, st GROUP BY 1)""")
       + """
SELECT CAST(i AS INTEGER) AS bin, ROUND(lo + i * ((hi - lo) / 30), 6) AS bin_lo,
       ROUND(lo + (i + 1) * ((hi - lo) / 30), 6) AS bin_hi, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM range(0, 30) g(i) CROSS JOIN st LEFT JOIN c ON c.bin = g.i""")
def q_residual_hist(spark, d):
    return rounded(M.residual_histogram(fx.orders_reg(spark, d), "o_totalprice", "pred"))


@query("pos_weight", W(SCORED) + """
SELECT ROUND(GREATEST(1.0, CAST(COUNT(*) - SUM(y) AS DOUBLE) / SUM(y)), 6) AS pos_weight FROM scored""")
def q_pos_weight(spark, d):
    return rounded(M.pos_weight(fx.scored(spark, d)))


# ---------------------------------------------------------------------------
# Cleaning, profiling, labels (2.1, 2.2, 2.4)
# ---------------------------------------------------------------------------
from .functions import cleaning as C  # noqa: E402
from .operators import labels as L  # noqa: E402
from .operators import profile as P  # noqa: E402

# RE2 spelling of cleaning.BLANK_PATTERN
BLANK_RE2 = (r"^[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
             r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$")


def _blank(c):
    return f"CASE WHEN regexp_matches({c}, '{BLANK_RE2}') THEN NULL ELSE {c} END"


def union(parts):
    return "\nUNION ALL\n".join(parts)


@query("read_csv", """
SELECT doc_id, CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '' THEN md5(text) END AS text_md5, lang, source, n_chars FROM documents""")
def q_read_csv(spark, d):
    """documents written as quoted CSV (texts hold line breaks, quotes and separators) and read back."""
    import uuid
    from .session import checkpoint_dir
    from .sources.tables import read_csv
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    (fx.read_table(spark, d, "documents").write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_csv(spark, path).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query("load_clean", W(DOCS_NULLS) + f"""
SELECT doc_id, {_blank('text')} AS text, {_blank('lang')} AS lang, {_blank('source')} AS source,
       n_chars, quality, toxic
FROM docs_nulls""")
def q_load_clean(spark, d):
    return C.clean_frame(fx.docs_nulls(spark, d), tokens=False)


DOCS_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@query("sparse_columns", W(DOCS_NULLS) + union([
    f"SELECT '{c}' AS column, ROUND(AVG(CAST({c} IS NULL AS DOUBLE)), 6) AS null_frac, "
    f"CAST(AVG(CAST({c} IS NULL AS DOUBLE)) > 0.5 AS INTEGER) AS dropped FROM docs_nulls"
    for c in DOCS_COLS if c != "quality"]))
def q_sparse_columns(spark, d):
    return rounded(P.sparse_columns(fx.docs_nulls(spark, d), target="quality", threshold=0.5))


@query("profile_nulls", W(DOCS_NULLS, "nc AS (" + union([
    f"SELECT '{c}' AS column, CAST(SUM(CAST({c} IS NULL AS BIGINT)) AS BIGINT) AS n_null, "
    f"ROUND(AVG(CAST({c} IS NULL AS DOUBLE)), 6) AS null_frac FROM docs_nulls" for c in DOCS_COLS]) + ")")
       + 'SELECT * FROM nc WHERE n_null > 0 ORDER BY n_null DESC, "column" LIMIT 10')
def q_profile_nulls(spark, d):
    return rounded(P.profile_nulls(fx.docs_nulls(spark, d), topn=10))


EV_TOP = ["user_id", "event_type"]


@query("profile_top_values", W(EVENTS_CAT, "vc AS (" + union([
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, COUNT(*) AS count FROM events_cat "
    f"WHERE {c} IS NOT NULL GROUP BY 2" for c in EV_TOP]) + ")") + """
SELECT "column", value, count, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank FROM vc) t
WHERE rank <= 5""")
def q_profile_top_values(spark, d):
    return P.profile_top_values(fx.events_cat(spark, d), EV_TOP, topn=5).withColumn("rank", F.col("rank").cast("int"))


@query("id_like_columns", W(EVENTS_CAT) + union([
    f"SELECT '{c}' AS column, COUNT(DISTINCT {c}) AS n_distinct, "
    f"ROUND(COUNT(DISTINCT {c}) / GREATEST(COUNT(*), 1), 6) AS unique_ratio, "
    f"CAST(COUNT(DISTINCT {c}) / GREATEST(COUNT(*), 1) > 0.9 AS INTEGER) AS is_id FROM events_cat"
    for c in ["event_id", "user_id"]]))
def q_id_like(spark, d):
    return rounded(P.id_like_columns(fx.events_cat(spark, d)))


def _docs_mi(spark, d):
    from .operators.features import MissingIndicators
    df = fx.docs_nulls(spark, d)
    return MissingIndicators().fit(df).transform(df)


@query("missing_indicators", W(DOCS_NULLS) + """
SELECT doc_id, CAST(quality IS NULL AS INTEGER) AS MI__quality, CAST(toxic IS NULL AS INTEGER) AS MI__toxic
FROM docs_nulls""")
def q_missing_indicators(spark, d):
    return _docs_mi(spark, d).select("doc_id", "MI__quality", "MI__toxic")


@query("column_roles", W(DOCS_NULLS) + union(
    [f"SELECT '{c}' AS column, 'categorical' AS kind, 'categorical' AS role" for c in ["text", "lang", "source"]]
    + [f"SELECT '{c}' AS column, 'numeric' AS kind, CASE WHEN COUNT(DISTINCT {c}) <= 2 THEN 'binary' "
       f"ELSE 'continuous' END AS role FROM docs_nulls" for c in ["doc_id", "n_chars", "quality", "toxic"]]
    + ["SELECT 'MI__quality', 'numeric', 'binary'", "SELECT 'MI__toxic', 'numeric', 'binary'"]))
def q_column_roles(spark, d):
    return P.column_roles(_docs_mi(spark, d))


EV_STR = ["user_id", "event_type", "props", "ts_text"]
DATE_RE2 = r"^\s*\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"


@query("date_columns", W(EVENTS_CAT) + union(
    ["SELECT 'ts' AS column, 1.0 AS parsed_frac, 1 AS is_date"]
    + [f"SELECT '{c}', ROUND(AVG(ok), 6), CAST(AVG(ok) > 0.8 AS INTEGER) FROM ("
       f"SELECT CAST(regexp_matches({c}, '{DATE_RE2}') AND TRY_CAST(trim({c}) AS TIMESTAMP) IS NOT NULL AS DOUBLE) AS ok "
       f"FROM events_cat WHERE {c} IS NOT NULL) t" for c in EV_STR]))
def q_date_columns(spark, d):
    return rounded(P.date_columns(fx.events_cat(spark, d)))


OML_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_year",
            "c_acctbal", "c_mktsegment", "n_name", "urgent"]


@query("group_like_columns", W(ORDERS_ML) + union([
    f"SELECT '{c}' AS column, ROUND(COUNT(DISTINCT {c}) / COUNT(*), 6) AS unique_ratio, "
    f"CAST(COUNT(DISTINCT {c}) / COUNT(*) <= 0.5 AND "
    f"({' OR '.join(f'contains(lower({chr(39)}{c}{chr(39)}), {chr(39)}{h}{chr(39)})' for h in P.GROUP_HINTS)}) AS INTEGER)"
    f" AS is_group FROM orders_ml" for c in OML_COLS]))
def q_group_like(spark, d):
    return rounded(P.group_like_columns(fx.orders_ml(spark, d)))


TASK_COLS = ["o_orderstatus", "o_totalprice", "o_orderpriority", "o_year", "urgent", "c_acctbal"]


@query("detect_task", W(ORDERS_ML) + union([
    f"SELECT '{c}' AS column, COUNT(DISTINCT {c}) AS n_distinct, COUNT(*) AS n_rows, "
    f"CASE WHEN COUNT(DISTINCT {c}) <= 20 THEN 'classification' ELSE 'regression' END AS task, "
    + ("'classification'" if c in ("o_orderstatus", "o_orderpriority") else
       f"CASE WHEN COUNT(DISTINCT {c}) <= GREATEST(20, FLOOR(COUNT(*) * 0.05)) THEN 'classification' "
       f"ELSE 'regression' END")
    + f" AS task_relative FROM orders_ml" for c in TASK_COLS]))
def q_detect_task(spark, d):
    return P.task_table(fx.orders_ml(spark, d), TASK_COLS)


@query("class_imbalance", W(DOCS_ML, "cc AS (SELECT quality, COUNT(*) AS n FROM docs_ml GROUP BY quality)") + """
SELECT COUNT(*) AS n_classes,
       ROUND(CASE WHEN COUNT(*) < 2 THEN 1.0 ELSE MAX(n) / MIN(n) END, 6) AS ratio,
       ROUND(CASE WHEN COUNT(*) < 2 THEN 1.0 WHEN COUNT(*) = 2 THEN MIN(n) / SUM(n) ELSE MAX(n) / SUM(n) END, 6)
         AS pos_rate
FROM cc""")
def q_class_imbalance(spark, d):
    return rounded(P.class_imbalance(fx.docs_ml(spark, d), "quality"))


@query("balanced_weights", W(DOCS_ML, "cc AS (SELECT quality, COUNT(*) AS n FROM docs_ml GROUP BY quality)") + """
SELECT doc_id, d.quality, ROUND((SELECT SUM(n) FROM cc) / ((SELECT COUNT(*) FROM cc) * cc.n), 6) AS weight
FROM docs_ml d JOIN cc ON d.quality = cc.quality""")
def q_balanced_weights(spark, d):
    return rounded(P.balanced_weights(fx.docs_ml(spark, d), "quality").select("doc_id", "quality", "weight"))


SKEW_COLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_year", "c_acctbal", "urgent"]


@query("skewness", W(ORDERS_ML) + union([
    f"SELECT '{c}' AS column, ROUND(CASE WHEN VAR_POP({c}) = 0 THEN 0.0 ELSE SKEWNESS({c}) END, 6) AS skew, "
    f"CAST(ABS(CASE WHEN VAR_POP({c}) = 0 THEN 0.0 ELSE SKEWNESS({c}) END) >= 1.0 AS INTEGER) AS skewed "
    f"FROM orders_ml" for c in SKEW_COLS]))
def q_skewness(spark, d):
    return rounded(P.skewness(fx.orders_ml(spark, d), SKEW_COLS))


EV_CAT = ["ts", "user_id", "event_type", "props", "ts_text"]


@query("high_card_columns", W(EVENTS_CAT) + union([
    f"SELECT '{c}' AS column, COUNT(DISTINCT {c}) + MAX(CAST({c} IS NULL AS INTEGER)) AS n_distinct, "
    f"CAST(COUNT(DISTINCT {c}) + MAX(CAST({c} IS NULL AS INTEGER)) >= 50 AS INTEGER) AS high_card FROM events_cat"
    for c in EV_CAT]))
def q_high_card(spark, d):
    return P.high_card_columns(fx.events_cat(spark, d), EV_CAT)


CORR_COLS = ["o_totalprice", "c_acctbal", "o_year", "urgent"]


@query("correlation_matrix", W(ORDERS_ML) + union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, " + ("1.0 AS corr" if a == b else f"ROUND(CORR({a}, {b}), 6) AS corr FROM orders_ml")
    for a in CORR_COLS for b in CORR_COLS]))
def q_corr(spark, d):
    return rounded(P.correlation_matrix(fx.orders_ml(spark, d), CORR_COLS))


CF_COLS = ["o_totalprice", "pred", "c_acctbal", "urgent"]


@query("correlation_filter", W(ORDERS_REG) + union([
    f"SELECT '{b}' AS column, CAST(" + (" OR ".join(f"ABS(CORR({a}, {b})) > 0.98" for a in CF_COLS[:j]) or "FALSE")
    + " AS INTEGER) AS dropped" + (" FROM orders_reg" if j else "") for j, b in enumerate(CF_COLS)]))
def q_corr_filter(spark, d):
    return P.correlation_filter(fx.orders_reg(spark, d), CF_COLS, 0.98)


@query("rare_categories", W(EVENTS_CAT) + union([
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, COUNT(*) AS count, "
    f"ROUND(COUNT(*) / (SELECT COUNT(*) FROM events_cat), 6) AS freq FROM events_cat GROUP BY 2 "
    f"HAVING COUNT(*) / (SELECT COUNT(*) FROM events_cat) < 0.01" for c in ["event_type", "user_id"]]))
def q_rare(spark, d):
    return rounded(P.rare_categories(fx.events_cat(spark, d), ["event_type", "user_id"], min_freq=0.01))


@query("encode_target", W(ORDERS_ML, """
m AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS y
      FROM (SELECT DISTINCT CAST(o_orderstatus AS VARCHAR) AS label FROM orders_ml) t)""")
       + "SELECT o_orderkey, m.y FROM orders_ml JOIN m ON o_orderstatus = m.label")
def q_encode_target(spark, d):
    df, _ = L.encode_target(fx.orders_ml(spark, d), "o_orderstatus", out="y")
    return df.select("o_orderkey", "y")


def _pos_inputs(spark, d):
    dm = fx.docs_ml(spark, d)
    om = fx.orders_ml(spark, d).withColumn("urgent_yn", F.when(F.col("urgent") == 1, "Y").otherwise("N"))
    en = fx.docs_nulls(spark, d).withColumn("english", F.when(F.col("lang") == "en", "english").otherwise("other"))
    return [("docs_ml.quality", dm, "quality"), ("orders_ml.o_orderstatus", om, "o_orderstatus"),
            ("orders_ml.urgent_yn", om, "urgent_yn"), ("documents.english", en, "english")]


def _pos_sql(name, table, expr):
    """Positive-label rule in SQL for one text-valued column expression."""
    return (f"SELECT '{name}' AS source, (SELECT CASE WHEN (SELECT COUNT(*) FROM g) <> 2 THEN NULL "
            f"WHEN (SELECT MIN(pref) FROM g) < 1000000 THEN (SELECT v FROM g ORDER BY pref LIMIT 1) "
            f"ELSE (SELECT v FROM g ORDER BY n, v LIMIT 1) END FROM (SELECT 1) one) AS positive_label "
            f"FROM (SELECT 1) z") .replace("FROM g", f"FROM (SELECT v, COUNT(*) AS n, {PREF_CASE} AS pref FROM "
                                            f"(SELECT CAST({expr} AS VARCHAR) AS v FROM {table} WHERE {expr} IS NOT NULL) s "
                                            f"GROUP BY v) g")


PREF_CASE = "CASE v WHEN '1' THEN 0 WHEN 'True' THEN 1 WHEN 'Y' THEN 2 WHEN 'y' THEN 3 WHEN 'Yes' THEN 4 WHEN 'YES' THEN 5 WHEN 'Si' THEN 6 WHEN 'SI' THEN 7 WHEN 'S' THEN 8 WHEN 'TRUE' THEN 9 ELSE 1000000 END"


@query("positive_label", W(ORDERS_ML, DOCS_ML, DOCS_NULLS) + union([
    _pos_sql("docs_ml.quality", "docs_ml", "quality"),
    _pos_sql("orders_ml.o_orderstatus", "orders_ml", "o_orderstatus"),
    _pos_sql("orders_ml.urgent_yn", "orders_ml", "CASE WHEN urgent = 1 THEN 'Y' ELSE 'N' END"),
    _pos_sql("documents.english", "docs_nulls", "CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END")]))
def q_positive_label(spark, d):
    out = None
    for name, df, col in _pos_inputs(spark, d):
        r = L.positive_label(df, col).select(F.lit(name).alias("source"), "positive_label")
        out = r if out is None else out.unionByName(r)
    return out


@query("binary_labels", W(DOCS_NULLS, """
v AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS english, quality FROM docs_nulls),
pos AS (SELECT english AS p FROM v GROUP BY 1 ORDER BY COUNT(*), 1 LIMIT 1)""") + """
SELECT doc_id, CAST(CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 1 ELSE 0 END AS INTEGER) AS quality01,
       CAST(CASE WHEN english = (SELECT p FROM pos) THEN 1 ELSE 0 END AS INTEGER) AS english01
FROM v""")
def q_binary_labels(spark, d):
    df = fx.docs_nulls(spark, d).withColumn("english", F.when(F.col("lang") == "en", "english").otherwise("other"))
    df, _ = L.binary_labels(df, "quality", out="quality01")
    df, _ = L.binary_labels(df, "english", out="english01")
    return df.select("doc_id", "quality01", "english01")


@query("remap_labels", W(ORDERS_ML) + """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE o_orderstatus END AS y
FROM orders_ml""")
def q_remap(spark, d):
    return L.remap_labels(fx.orders_ml(spark, d), "o_orderstatus", mapping={"F": 0, "O": 1}, out="y").select(
        "o_orderkey", "y")


@query("boolish", W(DOCS_NULLS) + """
SELECT doc_id,
  CAST(CASE WHEN lower(trim(CAST(quality AS VARCHAR))) IN ('y','yes','si','s','true','1') THEN TRUE
            WHEN lower(trim(CAST(quality AS VARCHAR))) IN ('n','no','false','0') THEN FALSE END AS INTEGER) AS quality_bool,
  CAST(CASE WHEN lower(trim(lang)) IN ('y','yes','si','s','true','1') THEN TRUE
            WHEN lower(trim(lang)) IN ('n','no','false','0') THEN FALSE END AS INTEGER) AS lang_bool
FROM docs_nulls""")
def q_boolish(spark, d):
    df = fx.docs_nulls(spark, d)
    return df.select("doc_id", C.boolish(F.col("quality")).cast("int").alias("quality_bool"),
                     C.boolish(F.col("lang")).cast("int").alias("lang_bool"))


# ---------------------------------------------------------------------------
# Feature transforms (2.5), splits (2.6), sources (2.1)
# ---------------------------------------------------------------------------
from .operators import features as FT  # noqa: E402
from .operators import split as SP  # noqa: E402


@query("ordinal_map", W(ORDERS_ML) + """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END
  AS o_orderpriority
FROM orders_ml""")
def q_ordinal_map(spark, d):
    m = FT.OrdinalMapper({"o_orderpriority": {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}})
    return m.transform(fx.orders_ml(spark, d)).select("o_orderkey", "o_orderpriority")


def _freq_sql(c):
    enc = f"(SELECT COUNT(DISTINCT {c}) FROM events_cat) >= 40"
    return (f"CASE WHEN {enc} THEN ROUND(COUNT(*) OVER (PARTITION BY {c}) / (SELECT COUNT(*) FROM events_cat), 6) END"
            f" AS {c}_freq, CASE WHEN NOT ({enc}) THEN {c} END AS {c}_raw")


FE_COLS = ["user_id", "event_type", "props"]


@query("freq_encode", W(EVENTS_CAT) + "SELECT event_id, " + ", ".join(_freq_sql(c) for c in FE_COLS)
       + " FROM events_cat")
def q_freq_encode(spark, d):
    """Frequency encoding (threshold 40 distinct values) of the event text columns: for each
    column, ``<c>_freq`` holds the encoded value when the column qualified, ``<c>_raw``
    the untouched text when it did not."""
    df = fx.events_cat(spark, d).select("event_id", *FE_COLS)
    enc = FT.FrequencyEncoder(threshold=40, exclude=["event_id"]).fit(df)
    out = enc.transform(df.select("event_id", *FE_COLS, *[F.col(c).alias(f"__raw_{c}") for c in FE_COLS]))
    cols = []
    for c in FE_COLS:
        done = c in enc.state["cols"]
        cols.append((F.col(c) if done else F.lit(None)).cast("double").alias(f"{c}_freq"))
        cols.append((F.lit(None) if done else F.col(f"__raw_{c}")).cast("string").alias(f"{c}_raw"))
    return rounded(out.select("event_id", *cols))


@query("rare_group", W(ORDERS_ML) + """
SELECT o_orderkey,
  CASE WHEN COUNT(*) OVER (PARTITION BY n_name) >= 0.05 * (SELECT COUNT(*) FROM orders_ml) THEN n_name
       ELSE '__OTHER__' END AS n_name,
  CASE WHEN COUNT(*) OVER (PARTITION BY c_mktsegment) >= 0.05 * (SELECT COUNT(*) FROM orders_ml) THEN c_mktsegment
       ELSE '__OTHER__' END AS c_mktsegment
FROM orders_ml""")
def q_rare_group(spark, d):
    df = fx.orders_ml(spark, d).select("o_orderkey", "n_name", "c_mktsegment")
    m = FT.RareCategoryGrouper(min_freq=0.05, cols=["n_name", "c_mktsegment"]).fit(df)
    return m.transform(df).select("o_orderkey", "n_name", "c_mktsegment")


@query("collapse_rare", W(EVENTS_CAT) + """
SELECT event_id, CASE WHEN user_id IS NOT NULL AND COUNT(*) OVER (PARTITION BY user_id) < 70 THEN '__OTHER__'
                      ELSE user_id END AS user_id
FROM events_cat""")
def q_collapse_rare(spark, d):
    df = fx.events_cat(spark, d).select("event_id", "user_id")
    return FT.collapse_rare_categories(df, "user_id", min_count=70).select("event_id", "user_id")


@query("hash_columns", W(DOCS_ML) + union([
    f"SELECT '{c}' AS column, ROUND(AVG(length({c})), 6) AS avg_len, "
    f"ROUND(COUNT(DISTINCT {c}) / GREATEST(COUNT(*), 1), 6) AS unique_ratio, "
    f"CAST(COALESCE(AVG(length({c})) >= 20, FALSE) OR COUNT(DISTINCT {c}) / GREATEST(COUNT(*), 1) >= 0.5 AS INTEGER)"
    f" AS hashed FROM docs_ml" for c in ["text", "lang", "source"]]))
def q_hash_columns(spark, d):
    return rounded(FT.auto_hash_columns(fx.docs_ml(spark, d), ["text", "lang", "source"]))


@query("hash_tokens")
def q_hash_tokens(spark, d):
    """Rows-only: bucket ids come from Spark's murmur3 FeatureHasher."""
    from pyspark.ml.functions import vector_to_array
    df = fx.docs_ml(spark, d)
    m = FT.HashingEncoder(cols=["lang", "source"], n_features=512).fit(df)
    arr = vector_to_array(F.col("hash_features"))
    return m.transform(df).select("doc_id", F.aggregate(arr, F.lit(0.0), lambda a, b: a + b).alias("token_total"),
                                  F.size(F.filter(arr, lambda v: v != 0)).alias("n_nonzero"))


@query("impute_numeric", W(DOCS_NULLS) + """
SELECT doc_id, COALESCE(CAST(quality AS DOUBLE), (SELECT MEDIAN(quality) FROM docs_nulls)) AS quality,
       COALESCE(CAST(toxic AS DOUBLE), (SELECT MEDIAN(toxic) FROM docs_nulls)) AS toxic,
       COALESCE(CAST(n_chars AS DOUBLE), (SELECT MEDIAN(n_chars) FROM docs_nulls)) AS n_chars
FROM docs_nulls""")
def q_impute_numeric(spark, d):
    df = fx.docs_nulls(spark, d).select("doc_id", "quality", "toxic", "n_chars")
    m = FT.NumericImputer(cols=["quality", "toxic", "n_chars"]).fit(df)
    return rounded(m.transform(df))


@query("impute_categorical", W(DOCS_NULLS, """
v AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END AS quality_txt, lang
      FROM docs_nulls),
m AS (SELECT quality_txt AS mv FROM v WHERE quality_txt IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1),
ml AS (SELECT lang AS mv FROM v WHERE lang IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)""") + """
SELECT doc_id, COALESCE(quality_txt, (SELECT mv FROM m)) AS quality_txt, COALESCE(lang, (SELECT mv FROM ml)) AS lang
FROM v""")
def q_impute_categorical(spark, d):
    df = fx.docs_nulls(spark, d).select(
        "doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("quality_txt"), "lang")
    m = FT.CategoricalImputer(cols=["quality_txt", "lang"]).fit(df)
    return m.transform(df)


def _yj_sql(x, lam):
    return (f"CASE WHEN {x} >= 0 THEN (CASE WHEN {lam} = 0 THEN LN(1 + {x}) ELSE (EXP({lam} * LN(1 + {x})) - 1) / {lam} END)"
            f" ELSE (CASE WHEN {lam} = 2 THEN -LN(1 - {x}) ELSE -(EXP((2 - {lam}) * LN(1 - {x})) - 1) / (2 - {lam}) END) END")


YJ_COLS = ["o_totalprice", "c_acctbal"]


@query("yeo_johnson", W(ORDERS_ML, """
g AS (SELECT CAST(ROUND(-2.0 + i * 0.1, 10) AS DOUBLE) AS lam FROM range(0, 41) r(i)),
ll AS (""" + union([
    f"SELECT '{c}' AS column, lam, -COUNT(*) / 2.0 * LN(VAR_POP({_yj_sql(c, 'lam')})) + (lam - 1) * "
    f"SUM(SIGN({c}) * LN(1 + ABS({c}))) AS loglik FROM orders_ml, g GROUP BY lam" for c in YJ_COLS]) + ")")
       + 'SELECT "column", ROUND(arg_max(lam, loglik), 6) AS lambda FROM ll GROUP BY "column"')
def q_yeo_johnson(spark, d):
    df = fx.orders_ml(spark, d)
    m = FT.YeoJohnson(cols=YJ_COLS, refine=False).fit(df)
    rows = [(c, float(v)) for c, v in m.state["lambdas"].items()]
    return rounded(spark.createDataFrame(rows, "column string, lambda double"))


SCALE_COLS = ["o_totalprice", "c_acctbal", "o_year"]


@query("standard_scale", W(ORDERS_ML) + "SELECT o_orderkey, " + ", ".join(
    f"ROUND(({c} - AVG({c}) OVER ()) / CASE WHEN STDDEV_POP({c}) OVER () = 0 THEN 1 ELSE STDDEV_POP({c}) OVER () END, 6)"
    f" AS {c}" for c in SCALE_COLS) + " FROM orders_ml")
def q_standard_scale(spark, d):
    df = fx.orders_ml(spark, d).select("o_orderkey", *SCALE_COLS)
    return rounded(FT.StandardScalerPop(cols=SCALE_COLS).fit(df).transform(df))


VAR_COLS = ["o_totalprice", "c_acctbal", "o_year", "urgent", "one"]


@query("variance_filter", W(ORDERS_ML) + union([
    f"SELECT '{c}' AS column, ROUND(VAR_POP({c}), 2) AS variance, CAST(VAR_POP({c}) > 0.0 AS INTEGER) AS kept "
    f"FROM (SELECT *, 1 AS one FROM orders_ml) t" for c in VAR_COLS]))
def q_variance_filter(spark, d):
    df = fx.orders_ml(spark, d).withColumn("one", F.lit(1))
    m = FT.VarianceFilter(cols=VAR_COLS, threshold=0.0).fit(df)
    rows = [(c, m.state["variances"][c], 0 if c in m.state["drop"] else 1) for c in VAR_COLS]
    # variances reach 1e10 here: 2 decimals keep ~13 significant digits
    return rounded(spark.createDataFrame(rows, "column string, variance double, kept int"), 2)


OH_COLS = ["c_mktsegment", "o_orderpriority"]


@query("one_hot", W(ORDERS_ML) + union([
    f"SELECT o_orderkey, '{c}=' || cat AS feature, CAST({c} = cat AS DOUBLE) AS value FROM orders_ml, "
    f"(SELECT DISTINCT {c} AS cat FROM orders_ml) t" for c in OH_COLS]))
def q_one_hot(spark, d):
    df = fx.orders_ml(spark, d).select("o_orderkey", *OH_COLS)
    m = FT.OneHot(cols=OH_COLS).fit(df)
    out = m.transform(df)
    names = m.output_columns()
    return out.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value"))
                                                        for n in names])).alias("e")).select("o_orderkey", "e.*")


OE_COLS = ["c_mktsegment", "o_orderpriority", "n_name"]


@query("ordinal_encode", W(ORDERS_ML) + "SELECT o_orderkey, " + ", ".join(
    f"CAST(DENSE_RANK() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}" for c in OE_COLS) + " FROM orders_ml")
def q_ordinal_encode(spark, d):
    df = fx.orders_ml(spark, d).select("o_orderkey", *OE_COLS)
    return FT.OrdinalEncode(cols=OE_COLS).fit(df).transform(df)


MI_FEATURES = ["o_totalprice", "c_acctbal", "o_year", "urgent", "c_mktsegment", "n_name", "o_orderpriority"]


def _mi_bin_sql(c, continuous):
    if not continuous:
        return f"CAST({c} AS VARCHAR)"
    qs = f"(SELECT quantile_cont({c}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) FROM orders_ml)"
    return "CAST(" + " + ".join(f"CASE WHEN {c} > {qs}[{i}] THEN 1 ELSE 0 END" for i in range(1, 10)) + " AS VARCHAR)"


@query("mutual_info_topk", W(ORDERS_ML, "long AS (" + union([
    f"SELECT '{c}' AS feature, {_mi_bin_sql(c, c in ('o_totalprice', 'c_acctbal'))} AS b, o_orderstatus AS y "
    f"FROM orders_ml" for c in MI_FEATURES]) + """),
cell AS (SELECT feature, b, y, COUNT(*) AS nxy FROM long GROUP BY ALL),
px AS (SELECT feature, b, SUM(nxy) AS nx FROM cell GROUP BY ALL),
py AS (SELECT y, COUNT(*) AS ny FROM orders_ml GROUP BY o_orderstatus, y),
mi AS (SELECT cell.feature, SUM(nxy / (SELECT COUNT(*) FROM orders_ml) *
              LN(nxy * (SELECT COUNT(*) FROM orders_ml) / (nx * ny))) AS mi
       FROM cell JOIN px USING (feature, b) JOIN py USING (y) GROUP BY cell.feature)""").replace(
    "py AS (SELECT y, COUNT(*) AS ny FROM orders_ml GROUP BY o_orderstatus, y)",
    "py AS (SELECT o_orderstatus AS y, COUNT(*) AS ny FROM orders_ml GROUP BY 1)") + """
SELECT feature, ROUND(mi, 6) AS mi, rank FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY mi DESC, feature) AS INTEGER) AS rank FROM mi) t WHERE rank <= 4""")
def q_mutual_info(spark, d):
    df = fx.orders_ml(spark, d)
    return rounded(FT.select_k_best_mi(df, MI_FEATURES, "o_orderstatus", k=4))


@query("stratified_folds", W(DOCS_ML) + f"""
SELECT doc_id, quality,
       CAST((row_number() OVER (PARTITION BY quality ORDER BY {H('doc_id', 42)}, doc_id) - 1) % 5 AS INTEGER) AS fold
FROM docs_ml""")
def q_stratified_folds(spark, d):
    return SP.stratified_folds(fx.docs_ml(spark, d), "quality", ["doc_id"], k=5).select("doc_id", "quality", "fold")


@query("kfold", W(ORDERS_ML) + f"""
SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {H('o_orderkey', 42)}, o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM orders_ml""")
def q_kfold(spark, d):
    return SP.kfold(fx.orders_ml(spark, d), ["o_orderkey"], k=5).select("o_orderkey", "fold")


@query("stratified_split", W(DOCS_ML) + f"""
SELECT doc_id, quality,
       CAST(row_number() OVER (PARTITION BY quality ORDER BY {H('doc_id', 42)}, doc_id) - 1
            < CEIL(COUNT(*) OVER (PARTITION BY quality) * 0.2) AS INTEGER) AS is_valid
FROM docs_ml""")
def q_stratified_split(spark, d):
    return SP.stratified_split(fx.docs_ml(spark, d), "quality", ["doc_id"], 0.2).select("doc_id", "quality", "is_valid")


@query("sample_rows", W(DOCS_NULLS) + f"""
SELECT doc_id, n_chars FROM docs_nulls ORDER BY {H('doc_id', 42)}, doc_id LIMIT 100""")
def q_sample_rows(spark, d):
    return SP.sample_rows(fx.docs_nulls(spark, d), ["doc_id"], 100).select("doc_id", "n_chars")


# ---------------------------------------------------------------------------
# Preprocessing assembly, sinks (2.1, 2.5 T18, 2.2 P11)
# ---------------------------------------------------------------------------
from .operators import preprocess as PP  # noqa: E402

PF_FEATS = ["o_totalprice", "c_acctbal", "urgent", "c_mktsegment", "o_orderpriority"]


def _pre_no_power():
    return PP.PreprocessOptions(power_transform=False)


@query("preprocess_full", W(ORDERS_ML) + union(
    [f"SELECT o_orderkey, '{c}' AS feature, ROUND(({c} - AVG({c}) OVER ()) / CASE WHEN STDDEV_POP({c}) OVER () = 0 "
     f"THEN 1 ELSE STDDEV_POP({c}) OVER () END, 6) AS value FROM orders_ml" for c in ["o_totalprice", "c_acctbal"]]
    + ["SELECT o_orderkey, 'urgent', CAST(urgent AS DOUBLE) FROM orders_ml"]
    + [f"SELECT o_orderkey, '{c}=' || cat, CAST({c} = cat AS DOUBLE) FROM orders_ml, "
       f"(SELECT DISTINCT {c} AS cat FROM orders_ml) t" for c in ["c_mktsegment", "o_orderpriority"]]))
def q_preprocess_full(spark, d):
    """Logistic-family preprocessing of orders_ml: median impute → population scaling for
    continuous columns, binary passthrough, mode impute → one-hot for categoricals; the
    assembled vector is unpacked to (key, feature, value)."""
    from pyspark.ml.functions import vector_to_array
    df = fx.orders_ml(spark, d)
    pre = PP.Preprocessor(PF_FEATS, "logistic", "classification", _pre_no_power()).fit(df)
    names = pre.feature_names
    out = pre.transform(df).select("o_orderkey", vector_to_array("features").alias("v"))
    long = out.select("o_orderkey", F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"),
                                                         F.col("v").alias("value"))).alias("e"))
    return rounded(long.select("o_orderkey", "e.feature", "e.value"))


@query("export_preprocessed", W(ORDERS_ML) + """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y,
       o_totalprice, c_acctbal, CAST(urgent AS DOUBLE) AS urgent,
       CAST(DENSE_RANK() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS c_mktsegment,
       CAST(DENSE_RANK() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority
FROM orders_ml""".replace("CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END",
                          "CAST(DENSE_RANK() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE)"))
def q_export_preprocessed(spark, d):
    """rf-family matrix (no scaling, ordinal codes) with the encoded target ``y`` first."""
    df, _ = L.encode_target(fx.orders_ml(spark, d), "o_orderstatus", out="label")
    df = df.withColumn("label", F.col("label").cast("double"))
    pre = PP.Preprocessor(PF_FEATS, "rf", "classification", _pre_no_power()).fit(df)
    return rounded(PP.export_matrix(pre, df, "label", key=["o_orderkey"]))


@query("align_columns", W(DOCS_NULLS) + """
SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, lang, CAST(NULL AS VARCHAR) AS c_segment, quality
FROM docs_nulls""")
def q_align_columns(spark, d):
    df = fx.docs_nulls(spark, d)
    return PP.align_columns(df, [("doc_id", "bigint"), ("n_chars", "double"), ("lang", "string"),
                                 ("c_segment", "string"), ("quality", "int")])


@query("feature_schema", W(ORDERS_ML) + """
SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name AS "column",
       CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                        WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS dtype
FROM (DESCRIBE SELECT * FROM orders_ml) t""")
def q_feature_schema(spark, d):
    return PP.feature_schema(fx.orders_ml(spark, d))


# ---------------------------------------------------------------------------
# Plan (2.4 A9, 2.10 M16)
# ---------------------------------------------------------------------------
from .plans import plan as PL  # noqa: E402

DOCS_X = ["text", "lang", "source", "n_chars", "toxic"]


def _docs_plan(spark, d):
    df = fx.docs_ml(spark, d)
    prof = PL.plan_profile(df.select(*DOCS_X), df, "quality")
    return prof


PLAN_PROFILE_CTE = DOCS_ML + """,
sk AS (SELECT (CASE WHEN VAR_POP(n_chars) = 0 THEN 0 ELSE SKEWNESS(n_chars) END) AS s_n_chars,
              (CASE WHEN VAR_POP(toxic) = 0 THEN 0 ELSE SKEWNESS(toxic) END) AS s_toxic FROM docs_ml),
hc AS (SELECT concat_ws(',', CASE WHEN COUNT(DISTINCT text) + MAX(CAST(text IS NULL AS INTEGER)) >= 50 THEN 'text' END,
                        CASE WHEN COUNT(DISTINCT lang) + MAX(CAST(lang IS NULL AS INTEGER)) >= 50 THEN 'lang' END,
                        CASE WHEN COUNT(DISTINCT source) + MAX(CAST(source IS NULL AS INTEGER)) >= 50 THEN 'source' END)
              AS high_card FROM docs_ml),
cc AS (SELECT quality, COUNT(*) AS n FROM docs_ml GROUP BY quality),
prof AS (SELECT (SELECT COUNT(*) FROM docs_ml) AS n_samples, 5 AS n_features, 2 AS n_num, 3 AS n_cat,
                concat_ws(',', CASE WHEN ABS(s_n_chars) >= 1 THEN 'n_chars' END,
                               CASE WHEN ABS(s_toxic) >= 1 THEN 'toxic' END) AS skewed,
                (SELECT high_card FROM hc) AS high_card,
                (SELECT CASE WHEN COUNT(*) < 2 THEN 1.0 ELSE MAX(n) / MIN(n) END FROM cc) AS imbalance_ratio,
                (SELECT CASE WHEN COUNT(DISTINCT quality) <= 20 THEN 'classification' ELSE 'regression' END
                 FROM docs_ml) AS task
         FROM sk)
"""


@query("plan_profile", "WITH " + PLAN_PROFILE_CTE + """
SELECT CAST(n_samples AS BIGINT) AS n_samples, CAST(n_features AS BIGINT) AS n_features, CAST(n_num AS BIGINT) AS n_num,
       CAST(n_cat AS BIGINT) AS n_cat, skewed, high_card, ROUND(imbalance_ratio, 6) AS imbalance_ratio, task FROM prof""")
def q_plan_profile(spark, d):
    return rounded(PL.profile_frame(spark, _docs_plan(spark, d)))


@query("auto_plan", "WITH " + PLAN_PROFILE_CTE + """
SELECT task, CASE WHEN imbalance_ratio >= 1.5 THEN 'f1_macro' ELSE 'roc_auc' END AS primary_metric,
       CASE WHEN imbalance_ratio >= 1.5 THEN 'balanced' END AS class_weight, 1 AS do_calibration,
       'random' AS search_strategy, CAST(imbalance_ratio >= 2.0 AS INTEGER) AS resample,
       CAST(skewed <> '' AS INTEGER) AS power_transform, 10 AS select_k_best,
       CAST(n_samples AS BIGINT) AS n_samples, CAST(n_features AS BIGINT) AS n_features, CAST(n_num AS BIGINT) AS n_num,
       CAST(n_cat AS BIGINT) AS n_cat, ROUND(imbalance_ratio, 6) AS imbalance_ratio, skewed, high_card,
       'logistic=23;rf=27;gbt=40' AS model_iters FROM prof""")
def q_auto_plan(spark, d):
    """Plan for docs_ml (target quality) with default options: 90 draws dealt out 1 : 1.2 : 1.8."""
    from .operators.train import RunOptions
    return rounded(PL.plan_frame(spark, PL.make_plan(_docs_plan(spark, d), RunOptions())))


# ---------------------------------------------------------------------------
# Models, search, ensembles, explanations (2.10), X1, T7, T15, R1
# ---------------------------------------------------------------------------
from .functions.proba import raw_to_proba  # noqa: E402
from .operators import calibrate as CA  # noqa: E402
from .operators import ensemble as EN  # noqa: E402
from .operators import explain as EX  # noqa: E402
from .operators import search as SE  # noqa: E402
from .session import cut_lineage  # noqa: E402
from .operators.models import feature_importance, fit_model, model_context, scored_frame  # noqa: E402
from .plans import registry as RG  # noqa: E402

DOCS_FEATS = ["lang", "source", "n_chars", "toxic"]
ORD_FEATS = ["o_totalprice", "c_acctbal", "o_year", "c_mktsegment", "n_name", "o_orderpriority"]


def _docs_folds(spark, d, family, k=5, weight=False):
    df = fx.docs_ml(spark, d)
    df = SP.stratified_folds(df, "quality", ["doc_id"], k=k, out="fold")
    wc = None
    if weight:
        df = P.balanced_weights(df, "quality", out="w")
        wc = "w"
    return SE.prepare_folds(df, ["doc_id"], "quality", DOCS_FEATS, family, "classification", k, "fold", wc,
                            _pre_no_power())


def _orders_folds(spark, d, family, k=5):
    df, _ = L.encode_target(fx.orders_ml(spark, d), "o_orderstatus", out="status_idx")
    df = SP.stratified_folds(df, "status_idx", ["o_orderkey"], k=k, out="fold")
    return SE.prepare_folds(df, ["o_orderkey"], "status_idx", ORD_FEATS, family, "classification", k, "fold", None,
                            _pre_no_power())


def _fit_all(spark, df, feats, family, task, label, spec_name, params, key):
    # every pass of the fits reads the rows: they are written once, so that the joins behind them (and what these broadcast) run once
    df = cut_lineage(df.select(*dict.fromkeys([*key, label, *feats])))
    pre = PP.Preprocessor(feats, family, task, _pre_no_power()).fit(df)
    x = pre.transform(df).select(*key, F.col(label).cast("double").alias("label"), "features")
    ctx = model_context(x, task, len(pre.feature_names))
    spec = RG.FAMILIES[task][spec_name]
    model = fit_model(spec, params, x, ctx)
    return pre, model, x


@query("fit_logistic")
def q_fit_logistic(spark, d):
    """L2 logistic regression (C=1) on docs_ml; in-sample predictions."""
    df = fx.docs_ml(spark, d)
    pre, model, x = _fit_all(spark, df, DOCS_FEATS, "logistic", "classification", "quality", "logistic", {"C": 1.0},
                             ["doc_id"])
    return scored_frame(model.transform(x), "classification", keep=["doc_id"]).drop("proba")


@query("fit_elasticnet")
def q_fit_elasticnet(spark, d):
    """Elastic net (alpha 0.01, l1_ratio 0.5) predicting o_totalprice on orders_ml."""
    df = fx.orders_ml(spark, d)
    pre, model, x = _fit_all(spark, df, ["c_acctbal", "o_year", "urgent", "c_mktsegment", "o_orderpriority"],
                             "linear", "regression", "o_totalprice", "linear", {"alpha": 0.01, "l1_ratio": 0.5},
                             ["o_orderkey"])
    return scored_frame(model.transform(x), "regression", keep=["o_orderkey"])


@query("fit_rf")
def q_fit_rf(spark, d):
    """Random forest on the 10-class embeddings."""
    df = fx.vec_ml(spark, d)
    from pyspark.ml.functions import array_to_vector
    x = df.select("vec_id", F.col("label").cast("double").alias("label"),
                  array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))
    ctx = model_context(x, "classification", 64)
    m = fit_model(RG.FAMILIES["classification"]["rf"], {"numTrees": 30, "maxDepth": 8}, x, ctx)
    return scored_frame(m.transform(x), "classification", keep=["vec_id"]).drop("proba", "score")


@query("fit_gbt")
def q_fit_gbt(spark, d):
    """Gradient-boosted trees (binary) on docs_ml."""
    df = fx.docs_ml(spark, d)
    pre, model, x = _fit_all(spark, df, DOCS_FEATS, "gbt", "classification", "quality", "gbt",
                             {"maxIter": 20, "maxDepth": 3}, ["doc_id"])
    return scored_frame(model.transform(x), "classification", keep=["doc_id"]).drop("proba")


@query("fit_mlp")
def q_fit_mlp(spark, d):
    """Multilayer perceptron (64 → 32 → 10) on the embeddings."""
    from pyspark.ml.functions import array_to_vector
    df = fx.vec_ml(spark, d)
    x = df.select("vec_id", F.col("label").cast("double").alias("label"),
                  array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))
    ctx = model_context(x, "classification", 64)
    m = fit_model(RG.FAMILIES["classification"]["mlp"], {"hidden": 32, "epochs": 40}, x, ctx)
    return scored_frame(m.transform(x), "classification", keep=["vec_id"]).drop("proba", "score")


@query("oof_predictions")
def q_oof(spark, d):
    """5-fold out-of-fold logistic predictions of o_orderstatus (every order predicted once)."""
    folds = _orders_folds(spark, d, "logistic")
    spec = RG.FAMILIES["classification"]["logistic"]
    oof = SE.oof_predictions(spec, {"C": 1.0}, folds, "classification", ["o_orderkey"])
    return oof.select("o_orderkey", "y", "y_pred", "fold", *[F.element_at("proba", j + 1).alias(f"proba_{j}")
                                                            for j in range(3)])


@query("oof_coverage", W(ORDERS_ML, f"""
c AS (SELECT o_orderkey, CAST(DENSE_RANK() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS y FROM orders_ml),
f AS (SELECT o_orderkey, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {H('o_orderkey', 42)}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM c)""") + """
SELECT o_orderkey, y, fold, CAST(1 AS BIGINT) AS n, 1.0::DOUBLE AS proba_sum FROM f""")
def q_oof_coverage(spark, d):
    """Every order is predicted once, in its own fold, with its class and probabilities that sum to 1."""
    p = q_oof(spark, d)
    return rounded(p.groupBy("o_orderkey", "y", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("proba_0") + F.col("proba_1") + F.col("proba_2")).alias("proba_sum")))


@query("fit_ridge_one_feature", W(ORDERS_ML, """
m AS (SELECT AVG(c_acctbal) AS mx, AVG(o_totalprice) AS my, COVAR_POP(c_acctbal, o_totalprice) / (VAR_POP(c_acctbal) + 1000000.0) AS b FROM orders_ml)""") + """
SELECT o_orderkey, ROUND(my + b * (c_acctbal - mx), 2) AS y_pred FROM orders_ml, m""")
def q_ridge(spark, d):
    """Linear model with l1_ratio 0 on one unscaled feature: the closed-form ridge solution."""
    from pyspark.ml.feature import VectorAssembler
    df = fx.orders_ml(spark, d).select("o_orderkey", "c_acctbal", F.col("o_totalprice").alias("label"))
    x = VectorAssembler(inputCols=["c_acctbal"], outputCol="features").transform(df)
    m = fit_model(RG.FAMILIES["regression"]["linear"], {"alpha": 1e6, "l1_ratio": 0.0}, x, model_context(x, "regression", 1))
    return rounded(scored_frame(m.transform(x), "regression", keep=["o_orderkey"]).select("o_orderkey", "y_pred"), 2)


@query("feature_importance_sum", "SELECT 1.0::DOUBLE AS total, CAST(1 AS INTEGER) AS sorted")
def q_importance_sum(spark, d):
    """Importances of the status forest sum to 1 and come in descending order."""
    rows = [r["importance"] for r in q_feature_importance(spark, d).collect()]
    return rounded(spark.createDataFrame([(float(sum(rows)), int(rows == sorted(rows, reverse=True)))], "total double, sorted int"))


@query("search_leaderboard")
def q_search(spark, d):
    """Random search (4 draws) for logistic C on docs_ml, 5 stratified folds, macro F1."""
    folds = _docs_folds(spark, d, "logistic", weight=True)
    res = SE.random_search(RG.FAMILIES["classification"]["logistic"], folds, "classification", ["doc_id"],
                           "f1_macro", n_iter=4)
    return SE.leaderboard_frame(spark, [res]).drop("seconds")


@query("halving_leaderboard")
def q_halving(spark, d):
    """Successive halving (factor 3) over 4 draws from the registry's forest space on docs_ml, accuracy."""
    folds = _docs_folds(spark, d, "rf")
    spec = RG.FAMILIES["classification"]["rf"]
    res = SE.halving_search(spec, folds, "classification", ["doc_id"], "accuracy", n_iter=4)
    return SE.leaderboard_frame(spark, [res]).drop("seconds")


@query("calibrate")
def q_calibrate(spark, d):
    """Isotonic calibration of logistic probabilities per fold, averaged (docs_ml): fold
    models and isotonic maps share one preprocessor's feature space."""
    df = SP.stratified_folds(fx.docs_ml(spark, d), "quality", ["doc_id"], k=5, out="fold")
    pre = PP.Preprocessor(DOCS_FEATS, "logistic", "classification", _pre_no_power()).fit(df)
    x = pre.transform(df).select("doc_id", "fold", F.col("quality").cast("double").alias("label"), "features")
    folds = SE.folds_of_matrix(x, "fold", 5, "classification", len(pre.feature_names))
    cal = CA.calibrate(RG.FAMILIES["classification"]["logistic"], {"C": 1.0}, folds)
    return CA.calibrated_scores(cal, x, ["doc_id"]).drop("proba")


@query("gbt_early_stop")
def q_gbt_early_stop(spark, d):
    """GBT on embeddings (label 0 vs rest) with a 20 % stratified validation share to pick the
    number of rounds, refitted on all rows."""
    from pyspark.ml.functions import array_to_vector
    df = fx.vec_ml(spark, d)
    x = df.select("vec_id", (F.col("label") == 0).cast("double").alias("label"),
                  array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))
    model, rounds = CA.gbt_early_stop(x, ["vec_id"], "classification", maxDepth=3)
    return scored_frame(model.transform(x), "classification", keep=["vec_id"]).drop("proba").withColumn(
        "rounds", F.lit(rounds))


@query("blend", W(SCORED_MULTI, f"""
mb AS (SELECT o_orderkey, y,
              {U('o_orderkey', 200)} + CASE WHEN y = 0 THEN 0.2 ELSE 0.0 END AS r0,
              {U('o_orderkey', 201)} + CASE WHEN y = 1 THEN 0.2 ELSE 0.0 END AS r1,
              {U('o_orderkey', 202)} + CASE WHEN y = 2 THEN 0.2 ELSE 0.0 END AS r2 FROM sm0),
b AS (SELECT a.o_orderkey,
             a.p0 * (2.0 / 3) + mb.r0 / (mb.r0 + mb.r1 + mb.r2) * (1.0 / 3) AS p0,
             a.p1 * (2.0 / 3) + mb.r1 / (mb.r0 + mb.r1 + mb.r2) * (1.0 / 3) AS p1,
             a.p2 * (2.0 / 3) + mb.r2 / (mb.r0 + mb.r1 + mb.r2) * (1.0 / 3) AS p2
      FROM scored_multi a JOIN mb ON a.o_orderkey = mb.o_orderkey)""") + """
SELECT o_orderkey, ROUND(p0, 6) AS p0, ROUND(p1, 6) AS p1, ROUND(p2, 6) AS p2,
       CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS y_pred
FROM b""")
def q_blend(spark, d):
    """Weighted (2:1) blend of two 3-class probability tables, argmax prediction."""
    out = EN.blend_scored([fx.scored_multi(spark, d), fx.scored_multi_b(spark, d)], ["o_orderkey"], [2, 1])
    return rounded(out.select("o_orderkey", *[F.element_at("proba", j + 1).alias(f"p{j}") for j in range(3)],
                              "y_pred"))


@query("raw_to_proba", W(SCORED_MULTI, """
m AS (SELECT o_orderkey, 3 * p0 AS z0, 3 * p1 AS z1, 3 * p2 AS z2, GREATEST(3 * p0, 3 * p1, 3 * p2) AS mx
      FROM scored_multi),
e AS (SELECT o_orderkey, EXP(z0 - mx) AS e0, EXP(z1 - mx) AS e1, EXP(z2 - mx) AS e2 FROM m)""") + """
SELECT o_orderkey, ROUND(e0 / (e0 + e1 + e2), 6) AS p0, ROUND(e1 / (e0 + e1 + e2), 6) AS p1,
       ROUND(e2 / (e0 + e1 + e2), 6) AS p2, ROUND(1 / (1 + EXP(-(3 * p1 - 1))), 6) AS sig
FROM e JOIN scored_multi USING (o_orderkey)""")
def q_raw_to_proba(spark, d):
    """Softmax of 3-class margins (3·p) and sigmoid of a 1-D margin (3·p1 − 1)."""
    sm = fx.scored_multi(spark, d)
    z = F.transform("proba", lambda v: v * 3)
    out = sm.select("o_orderkey", raw_to_proba(z, True).alias("pm"),
                    raw_to_proba(F.element_at("proba", 2) * 3 - 1, False).alias("pb"))
    return rounded(out.select("o_orderkey", *[F.element_at("pm", j + 1).alias(f"p{j}") for j in range(3)],
                              F.element_at("pb", 2).alias("sig")))


MI_K_FEATS = ["n_chars", "toxic"]


@query("mutual_info_knn", W(DOCS_ML, "b AS (" + union([f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, quality AS y FROM docs_ml" for c in MI_K_FEATS]) + ")", """
c AS (SELECT *, COUNT(*) OVER (PARTITION BY feature, y) AS nc FROM b),
m AS (SELECT *, LEAST(3, nc - 1) AS k, row_number() OVER () AS id FROM c WHERE nc > 1),
l AS (SELECT *, list_sort(list_filter([x - lag(x, 1) OVER w, x - lag(x, 2) OVER w, x - lag(x, 3) OVER w, lead(x, 1) OVER w - x, lead(x, 2) OVER w - x, lead(x, 3) OVER w - x],
                                      lambda d: d IS NOT NULL))[k] AS r FROM m WINDOW w AS (PARTITION BY feature, y ORDER BY x)),
n AS (SELECT l.id, l.feature, l.k, l.nc, COUNT(*) AS m FROM l JOIN m o ON l.feature = o.feature
      AND (CASE WHEN l.r > 0 THEN ABS(o.x - l.x) < l.r ELSE o.x = l.x END) GROUP BY ALL),
h AS (SELECT i AS v, -0.5772156649015329 + COALESCE(SUM(1.0 / (i - 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS psi
      FROM (SELECT UNNEST(generate_series(2, (SELECT COUNT(*) FROM docs_ml) + 1)) AS i) t UNION ALL SELECT 1, -0.5772156649015329)""") + """
SELECT n.feature, ROUND(GREATEST(0.0, MAX(hn.psi) + AVG(hk.psi) - AVG(hc.psi) - AVG(hm.psi)), 6) AS mi
FROM (SELECT *, COUNT(*) OVER (PARTITION BY feature) AS total FROM n) n JOIN h hn ON hn.v = n.total JOIN h hk ON hk.v = n.k JOIN h hc ON hc.v = n.nc JOIN h hm ON hm.v = n.m GROUP BY n.feature""")
def q_mutual_info_knn(spark, d):
    """Nearest-neighbour mutual information of numeric features with the quality of labelled documents."""
    from .operators.mutual import mutual_information_knn
    return rounded(mutual_information_knn(fx.docs_ml(spark, d), MI_K_FEATS, "quality"))


@query("stacking")
def q_stacking(spark, d):
    """Stacking logistic + random forest on docs_ml (5 folds): out-of-fold base probabilities
    feed a logistic meta model."""
    folds = _docs_folds(spark, d, "rf")
    reg = RG.FAMILIES["classification"]
    bases = [(reg["logistic"], {"C": 1.0}), (reg["rf"], {"numTrees": 20, "maxDepth": 5})]
    model, meta = EN.stacking(bases, folds, "classification", ["doc_id"])
    out = scored_frame(model.meta.transform(meta), "classification", keep=["doc_id"]).drop("proba")
    SE.release(folds)
    return out


@query("feature_importance")
def q_feature_importance(spark, d):
    """Random-forest importances on orders_ml (status), named by the preprocessor."""
    df, _ = L.encode_target(fx.orders_ml(spark, d), "o_orderstatus", out="status_idx")
    pre, model, _ = _fit_all(spark, df, ORD_FEATS, "rf", "classification", "status_idx", "rf",
                             {"numTrees": 20, "maxDepth": 5}, ["o_orderkey"])
    return spark.createDataFrame(feature_importance(model, pre.feature_names), "feature string, importance double")


PI_FEATS = ["o_totalprice", "urgent", "c_acctbal"]


def _pi_scorer(df):
    """Fixed linear scorer: 0.9·o_totalprice + 1000·urgent + 0.5·c_acctbal against the target copy."""
    return df.select(F.col("target").alias("y"),
                     (F.lit(0.9) * F.col("o_totalprice") + F.lit(1000.0) * F.col("urgent")
                      + F.lit(0.5) * F.col("c_acctbal")).alias("y_pred"))


def _pi_sql():
    parts = []
    for f in PI_FEATS:
        for r in range(5):
            sa, sb = f"42-{f}-{r}-a", f"42-{f}-{r}-b"
            cols = ", ".join(("b.v AS " + c) if c == f else ("a." + c) for c in PI_FEATS)
            parts.append(
                f"SELECT '{f}' AS feature, {r} AS rep, SQRT(AVG(POWER(target - (0.9 * o_totalprice + 1000.0 * urgent "
                f"+ 0.5 * c_acctbal), 2))) AS rmse FROM (SELECT a.target, {cols} FROM "
                f"(SELECT *, row_number() OVER (ORDER BY CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '#{sa}'), 1, 15)) AS BIGINT), o_orderkey) AS ra FROM pi) a "
                f"JOIN (SELECT {f} AS v, row_number() OVER (ORDER BY CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '#{sb}'), 1, 15)) AS BIGINT), o_orderkey) AS rb FROM pi) b "
                f"ON a.ra = b.rb) t")
    return union(parts)


PI_SQL = W(ORDERS_ML, "pi AS (SELECT o_orderkey, o_totalprice AS target, o_totalprice, urgent, c_acctbal FROM orders_ml)",
           "base AS (SELECT SQRT(AVG(POWER(target - (0.9 * o_totalprice + 1000.0 * urgent + 0.5 * c_acctbal), 2))) AS rmse FROM pi)",
           "perm AS (" + _pi_sql() + ")",
           """imp AS (SELECT feature, AVG(perm.rmse - base.rmse) AS m, STDDEV_POP(perm.rmse - base.rmse) AS s
                      FROM perm, base GROUP BY feature)""")


@query("permutation_importance", PI_SQL + """
SELECT feature, ROUND(m, 4) AS importance_mean, ROUND(s, 4) AS importance_std,
       CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank FROM imp""")
def q_permutation_importance(spark, d):
    """Permutation importance (5 seeded repeats, RMSE drop) of a fixed linear scorer on orders_ml."""
    df = fx.orders_ml(spark, d).select("o_orderkey", F.col("o_totalprice").alias("target"), *PI_FEATS)
    out = EX.permutation_importance(_pi_scorer, df, PI_FEATS, ["o_orderkey"], "rmse", "regression", repeats=5)
    return rounded(out, 4)


@query("prune_features", PI_SQL + """
SELECT feature, ROUND(m, 4) AS importance_mean,
       CAST(feature IN (SELECT feature FROM imp WHERE m <= 5000 ORDER BY m, feature LIMIT 1) AS INTEGER) AS dropped
FROM imp""")
def q_prune(spark, d):
    """Pruning advice over the permutation importances: drop ≤ 5000, at most 1 feature."""
    df = fx.orders_ml(spark, d).select("o_orderkey", F.col("o_totalprice").alias("target"), *PI_FEATS)
    imp = EX.permutation_importance(_pi_scorer, df, PI_FEATS, ["o_orderkey"], "rmse", "regression", repeats=5)
    return rounded(EX.prune_features(imp, drop_below=5000.0, max_drop=1), 4)


@query("learning_curve")
def q_learning_curve(spark, d):
    """Logistic learning curve on docs_ml: 5 nested training fractions × 5 folds, accuracy."""
    folds = _docs_folds(spark, d, "logistic")
    return EX.learning_curve(RG.FAMILIES["classification"]["logistic"], {"C": 1.0}, folds, "classification",
                             ["doc_id"], "accuracy")


T975_4 = 2.7764451051977987  # Fixed value: Student-t 97.5 % quantile, 4 degrees of freedom.


@query("cv_confidence_interval", W(ORDERS_REG, f"""
f AS (SELECT o_totalprice, pred,
             (row_number() OVER (ORDER BY {H('o_orderkey', 42)}, o_orderkey) - 1) % 5 AS fold FROM orders_reg),
s AS (SELECT fold, SQRT(AVG((o_totalprice - pred) * (o_totalprice - pred))) AS v FROM f GROUP BY fold)""") + f"""
SELECT ROUND(AVG(v), 4) AS mean, ROUND(AVG(v) - {T975_4} * STDDEV_SAMP(v) / SQRT(COUNT(*)), 4) AS low,
       ROUND(AVG(v) + {T975_4} * STDDEV_SAMP(v) / SQRT(COUNT(*)), 4) AS high, COUNT(*) AS n FROM s""")
def q_cv_ci(spark, d):
    """95 % t-interval of per-fold RMSE (5 folds) of the stand-in regression predictions."""
    df = SP.kfold(fx.orders_reg(spark, d), ["o_orderkey"], k=5)
    e = F.col("o_totalprice") - F.col("pred")
    scores = df.groupBy("fold").agg(F.sqrt(F.avg(e * e)).alias("value"))
    return rounded(EX.cv_confidence_interval(scores), 4)


@query("smote", W(DOCS_ML) + """
SELECT quality, MAX(COUNT(*)) OVER () AS n FROM docs_ml GROUP BY quality""")
def q_smote(spark, d):
    """SMOTE (k=5) on docs_ml numeric features: class counts after oversampling."""
    from pyspark.ml.feature import VectorAssembler
    df = fx.docs_ml(spark, d)
    x = VectorAssembler(inputCols=["n_chars", "toxic"], outputCol="features").transform(df)
    from .operators.smote import smote
    out = smote(x.select("doc_id", "quality", "features"), "quality", ["doc_id"])
    return out.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query("svd")
def q_svd(spark, d):
    """Truncated SVD (k = 8, uncentred) of the embeddings; projected rows."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from .operators.svd import TruncatedSVD
    df = fx.vec_ml(spark, d).select("vec_id", array_to_vector(F.transform("embedding", lambda v: v.cast("double")))
                                    .alias("features"))
    m = TruncatedSVD(k=8, inputCol="features", outputCol="svd").fit(df)
    arr = vector_to_array(F.col("svd"))
    return m.transform(df).select("vec_id", *[arr[i].alias(f"svd_{i}") for i in range(m.k)])


# ---------------------------------------------------------------------------
# Full training run (M23), holdout scoring (M22), incremental scoring (R1)
# ---------------------------------------------------------------------------
from .operators import holdout as HO  # noqa: E402
from .operators import train as TR  # noqa: E402
from .plans.options import changed  # noqa: E402


def docs_options(draws: int = TR.RunOptions().cv.n_iter_search, models=("logistic", "rf", "gbt"), **more):
    """Options of the documents runs: the registry's full spaces, five folds, ``draws`` draws a model (the operator's default)."""
    return changed(TR.RunOptions(), data__target="quality", data__key=["doc_id"],
                   data__features=["lang", "source", "n_chars", "toxic", "text"], cv__n_iter_search=draws,
                   cv__parallelism=4, train__model_names=list(models), **more)


@query("train_report")
def q_train_report(spark, d):
    """Automatic training run on docs_ml (target quality): plan, CV search of logistic regression, random
    forest and boosted trees, OOF metrics, resampling as planned, calibration, refit. Returns the leaderboard."""
    return TR.train_system(fx.docs_ml(spark, d), docs_options()).leaderboard.drop("seconds")


@query("score_holdout")
def q_score_holdout(spark, d):
    """Train on docs_ml rows outside fold 0 of a 5-fold split, score fold 0 as holdout with the
    best-F1 threshold; predictions (doc_id, y, y_pred, y_score)."""
    return _holdout(spark, d)[0]


def _holdout(spark, d):
    # written once: the training part and the holdout part read it
    df = cut_lineage(SP.stratified_folds(fx.docs_ml(spark, d), "quality", ["doc_id"], k=5, seed=7, out="hfold"))
    train = df.where("hfold != 0").drop("hfold")
    hold = df.where("hfold = 0").drop("hfold")
    res = TR.train_system(train, docs_options(models=("logistic",)))
    return HO.score_holdout(res.bundle, hold, threshold="f1")


@query("holdout_rows", W(DOCS_ML, f"""
h AS (SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY {H('doc_id', 7)}, doc_id) - 1) % 5 AS f FROM docs_ml)""") + """
SELECT doc_id, quality AS y, 1 AS by_threshold FROM h WHERE f = 0""")
def q_holdout_rows(spark, d):
    """The rows and labels that holdout scoring emits, and whether every prediction is the emitted score at
    the used threshold."""
    preds, res = _holdout(spark, d)
    t = float(res["metrics"]["used_threshold"])
    return preds.select("doc_id", "y", ((F.col("y_score") >= t).cast("int") == F.col("y_pred")).cast("int").alias("by_threshold"))


@query("stream_score", W(DOCS_ML) + """
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(*) AS BIGINT) AS n_predictions, 4 AS status FROM docs_ml""")
def q_stream_score(spark, d):
    """Incremental scoring: a model trained on docs_ml scores the documents ⋈ labels rows that
    arrive as files, one file a batch (availableNow trigger, checkpointed); returns the totals over the
    batches' status and prediction tables."""
    import uuid
    from .session import checkpoint_dir
    from .streaming.score import stream_score
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    src = fx.docs_ml(spark, d)
    res = TR.train_system(src, docs_options(models=("logistic",), train__calibrate=False))
    src.repartition(4).write.mode("overwrite").parquet(f"{base}/incoming")
    stream_score(spark, res.bundle, f"{base}/incoming", src.schema, f"{base}/checkpoint", f"{base}/out", max_files_per_trigger=1)
    done = spark.read.parquet(f"{base}/out/predictions").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    # all rows of the source, each scored once, over the batches
    return spark.read.parquet(f"{base}/out/status").join(done, "batch_id").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n_predictions"), F.max("status").cast("int").alias("status"))


# ---------------------------------------------------------------------------
# Additional views of E4/E5, E7 and P20
# ---------------------------------------------------------------------------

@query("metric_avg_precision_ovr", W(SCORED_MULTI, """
ex AS (SELECT 0 AS cls, CAST(y = 0 AS INTEGER) AS yb, p0 AS s FROM scored_multi
       UNION ALL SELECT 1, CAST(y = 1 AS INTEGER), p1 FROM scored_multi
       UNION ALL SELECT 2, CAST(y = 2 AS INTEGER), p2 FROM scored_multi),
g AS (SELECT cls, s, CAST(SUM(yb) AS DOUBLE) AS p, CAST(COUNT(*) - SUM(yb) AS DOUBLE) AS n FROM ex GROUP BY cls, s),
c AS (SELECT *, SUM(p) OVER w AS tp, SUM(p + n) OVER w AS a
      FROM g WINDOW w AS (PARTITION BY cls ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
per AS (SELECT cls, SUM(p * tp / a) / SUM(p) AS ap FROM c GROUP BY cls)""")
       + "SELECT ROUND(AVG(ap), 6) AS avg_precision FROM per")
def q_avg_precision_ovr(spark, d):
    """Macro one-vs-rest average precision of the 3-class orders table."""
    return rounded(M.avg_precision_ovr(fx.scored_multi(spark, d)))


@query("confusion_matrix_best_f1", W(SCORED, THRESH_GRID, """
bt AS (SELECT t FROM f1 ORDER BY f1 DESC, i ASC LIMIT 1),
lab AS (SELECT DISTINCT l FROM (SELECT CAST(y AS VARCHAR) AS l FROM scored UNION ALL SELECT '0' UNION ALL SELECT '1') t),
pr AS (SELECT CAST(y AS VARCHAR) AS y_true,
              CAST(CAST(LEAST(GREATEST(score, 0.0), 1.0) >= (SELECT t FROM bt) AS INTEGER) AS VARCHAR) AS y_pred
       FROM scored),
cnt AS (SELECT y_true, y_pred, COUNT(*) AS n FROM pr GROUP BY 1, 2)""") + """
SELECT a.l AS y_true, b.l AS y_pred, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n
FROM lab a JOIN lab b ON TRUE LEFT JOIN cnt ON cnt.y_true = a.l AND cnt.y_pred = b.l""")
def q_confusion_best(spark, d):
    """Confusion matrix after predicting with the best-F1 grid threshold."""
    s = fx.scored(spark, d)
    t = M.best_threshold_f1(s).first()["threshold"]
    return M.confusion_matrix(M.apply_threshold(s, t, "score", "y_at_t"), "y", "y_at_t")


@query("detect_task_relative", W(ORDERS_ML) + union([
    f"SELECT '{c}' AS column, " + ("'classification'" if c in ("o_orderstatus", "o_orderpriority") else
                                   f"CASE WHEN COUNT(DISTINCT {c}) <= GREATEST(20, FLOOR(COUNT(*) * 0.05)) "
                                   f"THEN 'classification' ELSE 'regression' END") + " AS task"
    + ("" if c in ("o_orderstatus", "o_orderpriority") else " FROM orders_ml") for c in TASK_COLS]))
def q_detect_task_relative(spark, d):
    """Relative task rule per candidate target: numeric → classification iff distinct ≤ max(20, 5 % of rows)."""
    df = fx.orders_ml(spark, d)
    rows = [(c, P.detect_task_relative(df, c)) for c in TASK_COLS]
    return spark.createDataFrame(rows, "column string, task string")
