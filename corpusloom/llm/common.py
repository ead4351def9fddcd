"""Column builders and lineage cuts shared by the training-data operators."""

from __future__ import annotations

import string
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[ \\t-\\r]+"
#: After lower-casing A-Z: whatever is neither a digit, a letter a-z nor beyond ASCII.
NON_WORD_RUN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same runs in a text whose A-Z are left as they are.
NON_WORD_RUN_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


#: The smaller side of a join is broadcast only up to this size of its values written as text.
BROADCAST_BYTES = 32 << 20
#: Row groups of written tables: what a task holds of a table that it writes.
BLOCK_BYTES = 16 << 20
#: Tasks that share a key of the larger side where the smaller one isn't broadcast.
SALTS = 8
#: A key with so many rows on the larger side is hot, where that is counted.
HOT_ROWS = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master (tests, a laptop) may leave it unset and gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from its files: lost executors cost a reread.

    A table, unlike a checkpoint, has a known size and no conditions of the plan it comes
    from; those double with every round of an iteration.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written and whose rows nobody will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows and BROADCAST_BYTES of values; ``df`` should be a cut or a cheap scan."""
    size = F.sum(F.octet_length(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns])))
    n, total = df.limit(rows + 1).agg(F.count("*"), size).first()
    return n <= rows and (total or 0) <= BROADCAST_BYTES


def join_sized(left: DataFrame, right: DataFrame, on: list[str], rows: int, how: str = "inner", counted: bool = False) -> DataFrame:
    """``left`` joined with ``right`` on equal ``on``, NULL equal to NULL; ``how``: inner, left, left_semi or left_anti.

    ``right`` is broadcast if it is proven small.  Else both sides are shuffled, and the
    rows of ``left`` with one key are dealt to SALTS tasks, each of which gets the
    key's rows of ``right``, so that a hot key doesn't end in one task.  With ``counted``, for a
    ``left`` that is cheap to read, the keys with HOT_ROWS rows there are counted first
    and only they are dealt out; the rows of ``right`` with other keys are sent once.
    """
    names = {c: fresh(left, f"_{c}") for c in on}
    other = right.select(*[F.col(c).alias(names[c]) for c in on], *[c for c in right.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(names[c])) for c in on]
    salt, other_salt = fresh(left, "_salt"), fresh(left, "_other_salt")
    if is_small(right, rows):
        other = F.broadcast(other)
    else:
        plain = [c for c in left.columns if c not in on and left.schema[c].dataType.typeName() in ("long", "integer", "string")]
        spread = F.pmod(F.xxhash64(F.lit("salt"), *plain), F.lit(SALTS)).cast("int")
        copies = F.sequence(F.lit(0), F.lit(SALTS - 1))
        hot = cut(left.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") >= HOT_ROWS).select(*on)) if counted else None
        if hot is not None and hot.isEmpty():
            return left.join(other, same, how).drop(*names.values())
        if hot is not None and is_small(hot, rows):
            left, here = _marked(left, on, hot)
            other, there = _marked(other, [names[c] for c in on], hot.toDF(*names.values()))
            left = left.withColumn(salt, F.when(F.col(here), spread).otherwise(0)).drop(here)
            other = other.withColumn(other_salt, F.explode(F.when(F.col(there), copies).otherwise(F.array(F.lit(0))))).drop(there)
        else:
            left = left.withColumn(salt, spread)
            other = other.withColumn(other_salt, F.explode(copies))
        same.append(F.col(salt) == F.col(other_salt))
    return left.join(other, same, how).drop(*names.values(), salt, other_salt)


def _marked(df: DataFrame, on: list[str], keys: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a column that says whether a row's key is one of ``keys``, which are few; and the column's name."""
    mark = fresh(df, "_hot")
    names = {c: f"{mark}_{i}" for i, c in enumerate(on)}
    few = F.broadcast(keys.toDF(*names.values()).withColumn(mark, F.lit(True)))
    out = df.join(few, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left").drop(*names.values())
    return out.withColumn(mark, F.coalesce(mark, F.lit(False))), mark


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; pure-ASCII texts take the byte-wise path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def split_words(c: Column, separators: str) -> Column:
    """The non-empty stretches between matches of ``separators``; NULL counts as empty."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), separators), "")


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module: str) -> None:
    """Send the functions of a module to Python workers by value: they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
