"""Selection and labelling of candidate texts, and sheets for their review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import matching
from ..functions import text as tx
from ..sources import sinks


def suggested_label(c: Column, terms: list[str], hit: str = config.URGENT_LABEL, miss: str = config.MANUAL_LABEL) -> Column:
    return F.when(matching.contains_any(c, terms), F.lit(hit)).otherwise(F.lit(miss))


def keyword_candidates(docs: DataFrame, text: str, terms: list[str], urgent: list[str], size: int = config.TEXT_CHARS) -> DataFrame:
    """Rows whose whole text holds a term, with a cleaned, shortened text and a suggested label.

    Where the urgent terms are the terms, every row kept has one and the texts aren't searched again.
    """
    label = F.lit(config.URGENT_LABEL) if {t.lower() for t in terms} == {t.lower() for t in urgent} else suggested_label(F.col(text), urgent)
    return docs.where(matching.contains_any(F.col(text), terms)).select(
        *[c for c in docs.columns if c != text],
        tx.clean_truncate(F.col(text), size).alias(text),
        label.alias("suggested_label"),
    )


def prefix_join(codes: DataFrame, code: str, prefixes: dict[str, tuple[str, str]]) -> DataFrame:
    """Codes that begin with a prefix, with the first such prefix in the order of ``prefixes``, its category and label.

    One pass and no join: the code's beginnings of the lengths that occur are looked up in
    a literal map, and the least rank wins, so that overlapping prefixes give one row a
    code.  A NULL code and one that begins with no prefix go.
    """
    first = prefix_of(tx.normalize_code(F.col(code)), {p: (i, p, *v) for i, (p, v) in enumerate(prefixes.items())}, "rank int, prefix string, category string, label string")
    found = codes.withColumn("_found", first).where(F.col("_found").isNotNull())
    return found.select(F.col("_found.prefix").alias("prefix"), *codes.columns, "_found.category", "_found.label")


def prefix_of(c: Column, table: dict[str, tuple], kind: str) -> Column:
    """The least of the values of all prefixes that a text begins with, as a struct of ``kind``; NULL if there is none."""
    keys = F.array(*[F.lit(p) for p in table])
    values = F.array(*[F.struct(*[F.lit(x) for x in v]) for v in table.values()])
    lookup = F.map_from_arrays(keys, values.cast(f"array<struct<{kind.replace(' ', ':')}>>".replace(",:", ",")))
    beginnings = F.array(*[F.substring(c, 1, n) for n in sorted({len(p) for p in table})])
    return F.array_min(F.transform(beginnings, lambda b: F.try_element_at(lookup, b)))


def prefix_match(codes: DataFrame, code: str, table: DataFrame) -> DataFrame:
    """prefix_join() for a table ``prefix, rank, ...`` of any size: the columns of the row of least rank, ties by prefix.

    Each distinct code is cut into its beginnings, whose lengths are those of the table (one row for
    each length that occurs), and they meet the prefixes in one equi-join; the least row
    of each code goes back to all rows with that code.  A NULL code, and one without a prefix, go.
    """
    others = [c for c in table.columns if c not in ("prefix", "rank")]
    lengths = [r[0] for r in table.select(F.char_length("prefix").alias("n")).where("n > 0").distinct().orderBy("n").collect()]  # as many as a prefix is long
    normal = codes.withColumn("_code", tx.normalize_code(F.col(code)))
    distinct = normal.select("_code").where(F.col("_code").isNotNull()).distinct()
    beginnings = distinct.select("_code", F.explode(F.array_distinct(F.array(*[F.substring("_code", 1, n) for n in lengths]))).alias("prefix") if lengths else F.lit("").alias("prefix"))
    best = beginnings.join(table.select("prefix", "rank", *others), "prefix").groupBy("_code").agg(F.min(F.struct("rank", "prefix", *others)).alias("_best"))
    return normal.join(best, "_code").select(*codes.columns, "_best.prefix", *[f"_best.{c}" for c in others])


def document_lookup(rows: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of their document; rows without a document go."""
    return rows.join(docs, key)


def review_sheet(df: DataFrame, kept: list[str], blank: list[str] = config.REVIEW_COLUMNS) -> DataFrame:
    """The kept columns and empty ones to fill in."""
    return df.select(*kept, *[F.lit("").alias(c) for c in blank])


def numbered(df: DataFrame, order: list[str], name: str = "number") -> tuple[DataFrame, int]:
    """``df`` with the place of each row in ``order`` from 1 on, and the number of rows.

    Rows are dealt to ranges and sorted there, and written with their place in the range;
    the ranges' counts, one number for each, are added up and put before them.  No
    task sees all rows.  Equal rows of ``order`` get places in any order; NULL comes first.
    """
    spark = df.sparkSession
    path = sinks.scratch(spark, "numbered")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)  # the range above 33 bits of the place in it
    rows = spark.read.parquet(path)
    task = F.shiftright("_place", 33).cast("int")
    counts = sorted((r[0], r[1]) for r in rows.groupBy(task.alias("t")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for t, n in counts:
        before.append((t, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "_task int, _before long"))  # a row for each range
    out = rows.withColumn("_task", task).join(offsets, "_task")
    place = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.select(*df.columns, place.alias(name)), total


def review_blocks(df: DataFrame, order: str, label: str, text: str) -> DataFrame:
    """One readable block per row, numbered over all rows."""
    rows, total = numbered(df.select(F.col(order).alias("o"), F.col(label).alias("l"), F.col(text).alias("t")), ["o"], "i")
    bar = F.repeat(F.lit("="), F.lit(80))
    return rows.select(
        F.col("o").alias(order),
        F.concat(
            bar, F.lit("\nCASO "), F.col("i").cast("string"), F.lit(f" de {total} — archivo: "), F.col("o").cast("string"),
            F.lit("\nEtiqueta sugerida automática: "), F.col("l").cast("string"), F.lit("\n"), bar, F.lit("\n"), F.col("t"), F.lit("\n\n"),
        ).alias("block"),
    )
