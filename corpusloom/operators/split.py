"""Deterministic random order, samples and splits by hash: no row depends on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def hash_order(key: Column, seed: int = config.SEED) -> Column:
    """A text to order by: equal for equal keys and seeds on every engine with MD5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample_per_stratum(df: DataFrame, stratum: str, key: str, k: int, seed: int = config.SEED) -> DataFrame:
    """k random rows of each stratum (all of smaller ones); the row limit is pushed below the shuffle."""
    w = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


#: Leading hexadecimal digits of the hash by which a stratum is cut into buckets: 16 ** 3 of them.
BUCKET_DIGITS = 3


def stratified_split(df: DataFrame, stratum: str, key: str, train: float = config.TRAIN_SHARE, val: float = config.VAL_SHARE, seed: int = config.SEED) -> DataFrame:
    """Add ``split``: the first floor(n * train) rows of a stratum in hash order, the next floor(n * val), the rest.

    No stratum is ever in one task: rows are counted by stratum and leading digits of the
    hash, those few counts are summed up, and rows are numbered inside their bucket on top
    of the rows in the buckets before.  The join finds its rows where the numbering left
    them.  A NULL stratum is a stratum; repeated rows are numbered each.
    """
    place = hash_order(F.col(key), seed)
    # NULL strata and keys as plain values, so that the join needs no other partitioning than the window.
    parts = {"_s": F.coalesce(F.col(stratum).cast("string"), F.lit("")), "_null": F.col(stratum).isNull(), "_b": F.coalesce(F.substring(place, 1, BUCKET_DIGITS), F.lit(""))}
    rows = df.withColumns(parts)
    counts = rows.groupBy(*parts).agg(F.count("*").alias("_c"))
    up_to = Window.partitionBy("_s", "_null").orderBy("_b")
    sums = counts.select(*parts, (F.sum("_c").over(up_to) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy("_s", "_null")).alias("_n"))
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*parts).orderBy(place, key)) - 1)
    a, b, i = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(val)), F.col("_before") + F.col("_i")
    return numbered.join(sums, list(parts)).withColumn(
        "split", F.when(i < a, "train").when(i < a + b, "val").otherwise("test")
    ).select(*df.columns, "split")
