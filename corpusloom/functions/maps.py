"""Dictionary lookups as literal maps."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(c: Column, table: dict) -> Column:
    """The value of a key, NULL where there is none."""
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())), c)


def lookup_strict(c: Column, table: dict) -> Column:
    """The value of a key; a row without one ends the job."""
    found = lookup(c, table)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("no such key: "), F.coalesce(c.cast("string"), F.lit("NULL")))).cast("string")).otherwise(found)


def inverse(table: dict) -> dict:
    return {v: k for k, v in table.items()}
