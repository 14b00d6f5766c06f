"""Incremental scoring of newly arrived rows with a trained bundle.

File source (explicit schema) → foreachBatch(score + per-batch metrics + status
row) with a checkpoint, so a restarted query resumes after the last committed
batch. ``availableNow`` processes everything present and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.holdout import prepare_holdout

# Job status codes of the service loop.
STATUS_QUEUED, STATUS_TRAINING, STATUS_DONE, STATUS_ERROR = 2, 3, 4, 5


def stream_score(spark: SparkSession, bundle, source: str, schema, checkpoint: str, out_dir: str,
                 fmt: str = "parquet", max_files_per_trigger: int | None = None):
    """Score every file that arrives under ``source``; writes ``predictions`` and ``status``
    tables under ``out_dir``. Returns the finished StreamingQuery."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source)

    def put(rows: DataFrame, table: str, epoch: int) -> None:
        # a replayed batch overwrites its own folder, so it never stands twice
        rows.write.mode("overwrite").parquet(f"{out_dir}/{table}/batch_id={epoch}")

    def status(epoch: int, n, acc, code: int, error: str | None) -> None:
        put(spark.createDataFrame([(n, acc, code, error)], "n_rows long, accuracy double, status int, error string"), "status", epoch)

    def batch(df: DataFrame, epoch: int):
        scored = None
        try:
            d = prepare_holdout(bundle, df)
            scored = bundle.score(d).persist()
            n, acc = scored.count(), None
            if "label" in d.columns and n:
                acc = M.accuracy(scored.where(F.col("y").isNotNull())).first()["accuracy"]
            put(scored.select(*bundle.key, "y", "y_pred", *(["score"] if "score" in scored.columns else [])), "predictions", epoch)
            status(epoch, n, acc, STATUS_DONE, None)
        except Exception as e:  # noqa: BLE001 - recorded as an error status, then re-raised
            status(epoch, None, None, STATUS_ERROR, repr(e))
            raise
        finally:
            if scored is not None:
                scored.unpersist()

    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
