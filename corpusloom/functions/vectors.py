"""Scores in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(c: Column) -> Column:
    """The place, from 0, of the largest value, the first of equals."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("long")


def softmax(c: Column) -> Column:
    """Exponentials shifted by the maximum, over their sum."""
    def divided(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
        return F.transform(e, lambda x: x / total)

    shifted = F.transform(c, lambda x: F.exp((x - F.array_max(c)).cast("double")))
    return F.get(F.transform(F.array(shifted), divided), F.lit(0))
