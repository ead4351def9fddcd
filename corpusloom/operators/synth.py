"""Texts from templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import maps
from ..functions import text as tx
from .split import sample_per_stratum


def combinations(spark: SparkSession, templates: dict[str, list[str]], fields: dict[str, list[str]]) -> DataFrame:
    """Every template with every value of every field: parameters times parameters, never data."""
    df = spark.createDataFrame(list(templates.items()), "category string, templates array<string>").select("category", F.explode("templates").alias("template"))
    for name, values in fields.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def generate(spark: SparkSession, templates: dict[str, list[str]], fields: dict[str, list[str]], labels: dict[str, str] = config.CATEGORY_LABELS,
             per_category: int = config.PER_CATEGORY, seed: int = config.SEED) -> DataFrame:
    """``text, category, label``: a balanced random sample of the rendered combinations."""
    df = combinations(spark, templates, fields)
    df = df.select(tx.render(F.col("template"), {n: F.col(n) for n in fields}).alias("text"), "category").distinct()
    df = sample_per_stratum(df, "category", "text", per_category, seed)
    return df.withColumn("label", maps.lookup_strict(F.col("category"), labels))
