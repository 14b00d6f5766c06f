"""Size-checked lookups.

Fitted lookup tables (frequency maps, class counts, rank offsets) stay
DataFrames. They are broadcast only after their size in bytes has been
checked against a bound; beyond it Spark's shuffle join (with AQE skew handling) is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_MAX_BROADCAST_BYTES = 32 << 20
CONF_KEY = "autotab.broadcast.maxBytes"
ROW_BYTES = 32  # overhead of a row in a broadcast relation


def max_broadcast_bytes(spark) -> int:
    return int(spark.conf.get(CONF_KEY, str(DEFAULT_MAX_BROADCAST_BYTES)))


def table_bytes(df: DataFrame) -> int:
    """Size of the rows of ``df`` as a broadcast would hold them: text and binary by length, the rest by 8 bytes."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) if t in ("string", "binary") else F.lit(8) for n, t in df.dtypes]
    r = df.agg(F.sum(sum(wide, F.lit(ROW_BYTES)).cast("long")).alias("b")).first()
    return int(r["b"] or 0)


def sized(small: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``broadcast(small)`` when its measured size is within the bound, else ``small``; computed once, into the
    shared checkpoint folder, so that neither the measure nor the join computes it again."""
    bound = max_broadcast_bytes(small.sparkSession) if max_bytes is None else max_bytes
    if bound <= 0:  # caller knows the side is large: plain shuffle join
        return small
    small = cut_lineage(small)
    return F.broadcast(small) if table_bytes(small) <= bound else small


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
                   max_bytes: int | None = None, broadcast: bool | None = None) -> DataFrame:
    """Join on ``keys`` with NULL-safe equality (NULL matches NULL), right side size-checked.

    ``broadcast`` True/False skips the check when the caller already knows the size
    (e.g. a size taken at fit time). Right-hand key columns are dropped from the result.
    """
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    r = right.select(*[F.col(f"`{k}`").alias(f"__r_{k}") for k in keys],
                     *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    if broadcast is None:
        r = sized(r, max_bytes)
    elif broadcast:
        r = F.broadcast(r)
    cond = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`")) for k in keys])
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])
