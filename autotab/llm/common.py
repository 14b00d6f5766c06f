"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: A word is a longest run of characters other than these (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Whole documents are handed to numpy in slices of about so many characters.
SLICE_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text; ``bytes.split`` splits on exactly the
    six ASCII white space characters and ``bytes.lower`` changes only A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def whole_text(col: str = "text") -> Column:
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def content_key(col: str = "text") -> Column:
    """128-bit content address of a text (binary)."""
    return F.unhex(F.md5(whole_text(col)))


def slices(batches: Iterator[pa.RecordBatch], text: int, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts record batches by the summed byte length of column ``text`` (one very long text stays whole)."""
    for b in batches:
        lens = pc.binary_length(b.column(text)).to_pylist()
        start = total = 0
        for i, n in enumerate(lens):
            total += n or 0
            if total >= chars:
                yield b.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < b.num_rows:
            yield b.slice(start)


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text",
              chars: int = SLICE_CHARS) -> DataFrame:
    """``fn`` over Arrow slices of ``df`` of about ``chars`` characters in column ``text``."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, at, chars):
            out = fn(s)
            if out is not None and out.num_rows:
                yield out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def carried(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` as columns and all others inside one struct, out of the way of an operator's own names."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keep]
    return df.select(*keep, F.struct(F.lit(0).alias("_"), *rest).alias("__row"))


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """Undoes ``carried``: the given columns, from the frame where it has them and else from the struct."""
    inside = set(df.schema["__row"].dataType.names)
    return df.select(*[F.col("__row").getField(c).alias(c) if c in inside else F.col(f"`{c}`") for c in columns])


def release(spark: SparkSession, pause: float = 0.2) -> None:
    """Lets the driver collect its garbage now, so that shuffle files and checkpoints to which nothing refers go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(pause)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder: what stands before need not run again, and
    the shuffle files of the stages behind it can go (else they stay until the driver collects its garbage)."""
    spark, path = df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    for _ in range(2):  # plans are dropped first, then what only they referred to
        release(spark, 0.5)
    return spark.read.schema(schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that this run wrote and that no result reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
