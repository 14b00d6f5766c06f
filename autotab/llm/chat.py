"""Multi-party perspective rotation: for every participant the dialogue is rendered with that
speaker as the assistant and the others as named users, with the loss mask on the speaker's turns.

The rendering stays one row per turn and perspective; the character offsets within the whole
rendering come from prefix sums over runs: range partitions of about ``RUN`` turns at most, in the order of conversation,
turn, speaker and content. Equal rows are told apart by a salt, so a conversation that holds a third of
all rows is rendered by many tasks, whatever its turn numbers are. Roles named ``system`` set the scene: they keep their role in
every perspective and have none of their own.

Cases: a NULL role is the speaker ``unknown``; a NULL text is empty; a NULL conv_id is a
conversation of its own; equal turns are ordered by role and text; repeated rows are rendered
each; a conversation without participants has no perspective and so no rows; control marks inside
a text or a role are broken up by a blank and line breaks in a role become blanks where it is rendered, so
neither can open a turn (speaker and perspective keep the role as it is); an empty table gives an empty table.
Other columns are not taken over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

RUN = 65_536
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def shown_name(speaker: str) -> Column:
    return F.translate(F.replace(F.col(speaker), F.lit("<|im_"), F.lit("< |im_")), "\n\r", "  ")


def with_runs(t: DataFrame) -> DataFrame:
    """``t`` (conv_id, turn, speaker, content) with ``run`` and ``salt``: the rows in order, dealt out to runs that follow each other."""
    parts = max(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-t.count() // RUN))
    t = t.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    return stored(t.repartitionByRange(parts, "conv_id", "turn", "speaker", "content", "salt").withColumn("run", F.spark_partition_id()))


def rotate(turns: DataFrame) -> DataFrame:
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"),
                     F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("< |im_")).alias("content"))
    t = with_runs(t)
    seats = t.where(F.col("speaker") != "system").select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    d = t.join(seats, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    mine = F.col("speaker") == F.col("perspective")
    head = F.when(F.col("speaker") == "system", F.lit("system")).when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), shown_name("speaker")))
    d = (d.withColumn("trained", mine).withColumn("head", F.concat(F.lit(OPEN), head, F.lit("\n")))
         .withColumn("tail", F.concat("content", F.lit(CLOSE))).withColumn("rendered", F.concat("head", "tail", F.lit("\n")))
         .withColumn("conv", F.struct("conv_id", "perspective")))
    runs = d.groupBy("conv", "run").agg(F.sum(F.length("rendered")).alias("chars"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(F.col("conv").alias("oc"), F.col("run").alias("orun"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"o_{c}") for c in ("chars", "n")])
    inside = Window.partitionBy("conv", "run").orderBy(F.col("turn").asc_nulls_first(), "speaker", "content", "salt")
    d = d.join(offsets, F.col("conv").eqNullSafe(F.col("oc")) & (F.col("run") == F.col("orun")))
    d = (d.withColumn("position", F.row_number().over(inside) + F.col("o_n"))
         .withColumn("char_start", F.sum(F.length("rendered")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.length("rendered") + F.col("o_chars")))
    first = F.col("char_start") + F.length("head")
    return d.select("conv_id", "perspective", "position", "turn", "speaker", "rendered", "trained", "char_start",
                    F.when(F.col("trained"), first).alias("mask_start"), F.when(F.col("trained"), first + F.length("tail")).alias("mask_end"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '< |im_') AS content FROM conversations),
v AS (SELECT t.*, s.perspective, t.speaker = s.perspective AS trained,
        '<|im_start|>' || CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = s.perspective THEN 'assistant' ELSE 'user name=' || translate(replace(t.speaker, '<|im_', '< |im_'), chr(10) || chr(13), '  ') END || chr(10) AS head
      FROM t JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system') s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
r AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS rendered FROM v),
p AS (SELECT *, row_number() OVER o AS position, CAST(sum(length(rendered)) OVER o AS BIGINT) - length(rendered) AS char_start FROM r
      WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, speaker, rendered, trained, char_start,
       CASE WHEN trained THEN char_start + length(head) END AS mask_start,
       CASE WHEN trained THEN char_start + length(head) + length(content) + 10 END AS mask_end FROM p
"""
