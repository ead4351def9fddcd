"""Writers; all overwrite what is there and commit as a whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What scratch() has named and remove() hasn't removed.
_NAMED: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``; only a local master may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _NAMED.append(f"{folder or tempfile.mkdtemp()}/{name}-{uuid.uuid4().hex}")
    return _NAMED[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete what this library has written to ``path``, if anything, once nobody will read it again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _NAMED:
        _NAMED.remove(path)


def remove_scratch(spark: SparkSession) -> int:
    """Delete all that this process has put under scratch() paths, and say how many; frames that read them are of no use then."""
    paths = list(_NAMED)
    for path in paths:
        remove(spark, path)
    return len(paths)


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order, those missing as empty strings."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, by: str | None = None) -> None:
    """Header, minimal quotes, doubled quotes inside; edge blanks and empty strings as they are."""
    out = (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("escape", '"')
    out = out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "")
    (out.partitionBy(by) if by else out).csv(path)


def write_report(blocks: DataFrame, path: str, order: str) -> None:
    """Text files of the blocks, which are in order when the files are read by name: no task writes all of them."""
    text = F.regexp_replace("block", "\n$", "")  # the writer ends each block with a line end itself
    blocks.orderBy(order).select(text.alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_pretty_json(df: DataFrame) -> str:
    """A one-row frame as indented JSON."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})).first()[0]
