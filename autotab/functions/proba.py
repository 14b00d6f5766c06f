"""Raw model scores → class probabilities (sigmoid / softmax) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def softmax_array(arr: Column) -> Column:
    """Softmax of an array column; the row maximum is subtracted first."""
    mx = F.array_max(arr)
    e = F.transform(arr, lambda v: F.exp(v - mx))
    tot = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda v: v / tot)


def raw_to_proba(c: Column, is_array: bool) -> Column:
    """1-D margin → [1 − σ(z), σ(z)]; array of margins → softmax."""
    if is_array:
        return softmax_array(c)
    p = sigmoid(c.cast("double"))
    return F.array(F.lit(1.0) - p, p)


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")
