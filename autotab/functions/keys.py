"""Stable, engine-independent row hashes.

Spark has no row order, so every "random" choice (folds, samples, shuffles,
SMOTE partners) hangs on a stable key hashed with md5. The first 15 hex digits
of the md5 give a non-negative 60-bit integer that DuckDB reproduces as
``CAST('0x' || substr(md5(text), 1, 15) AS BIGINT)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_HEX_DIGITS = 15
HASH_BITS = 4 * HASH_HEX_DIGITS


def key_text(*cols, seed: int | str | None = None) -> Column:
    """``c1|c2|...#seed`` as text (integer and string keys render identically in SQL engines)."""
    parts = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                for c in cols])
    if seed is None:
        return parts
    return F.concat(parts, F.lit(f"#{seed}"))


def md5_int(text: Column) -> Column:
    """Non-negative 60-bit integer from md5(text)."""
    return F.conv(F.substring(F.md5(text), 1, HASH_HEX_DIGITS), 16, 10).cast("bigint")


def row_hash(*cols, seed: int | str = 42) -> Column:
    return md5_int(key_text(*cols, seed=seed))


def unit_uniform(*cols, seed: int | str = 42) -> Column:
    """Deterministic u in [0, 1) from the key."""
    return row_hash(*cols, seed=seed).cast("double") / F.lit(float(2 ** HASH_BITS))
