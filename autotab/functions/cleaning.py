"""Cleaning expressions: blank strings, missing-value tokens, NaN, yes/no parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

# Fixed values. Whitespace characters recognised by Python's str.isspace / regex \s,
# which the reference's blank-cell rule (pattern ^\s*$) relies on.
PY_WHITESPACE_JAVA = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
BLANK_PATTERN = "^" + PY_WHITESPACE_JAVA + "*$"

# The default missing-value tokens of pandas.read_csv.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
               "nan", "null"]

# yes/no spellings (compared after trim + lower case).
TRUE_WORDS = ["y", "yes", "si", "s", "true", "1"]
FALSE_WORDS = ["n", "no", "false", "0"]


def quoted(name: str) -> str:
    """The name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col(quoted(name))


def blank_to_null(c: Column) -> Column:
    return F.when(c.rlike(BLANK_PATTERN), F.lit(None).cast("string")).otherwise(c)


def token_to_null(c: Column) -> Column:
    return F.when(c.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def clean_frame(df: DataFrame, tokens: bool = False) -> DataFrame:
    """Blank/whitespace strings → NULL (plus pandas missing tokens if ``tokens``); NaN → NULL."""
    out = []
    for f in df.schema.fields:
        c = named(f.name)
        if isinstance(f.dataType, StringType):
            e = blank_to_null(c)
            if tokens:
                e = token_to_null(e)
            out.append(e.alias(f.name))
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(nan_to_null(c).cast(f.dataType).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def boolish(c: Column) -> Column:
    """yes/no-like text → boolean; anything else → NULL."""
    s = F.lower(F.trim(c.cast("string")))
    return (F.when(s.isin(*TRUE_WORDS), F.lit(True))
             .when(s.isin(*FALSE_WORDS), F.lit(False))
             .otherwise(F.lit(None).cast("boolean")))
