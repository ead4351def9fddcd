"""The keyword flow over a stream of texts, with the same column builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import config
from ..operators import curate


def keyword_stream(spark: SparkSession, path: str, schema: str, text: str, terms: list[str] = config.DOMAIN_TERMS, urgent: list[str] = config.URGENT_TERMS) -> DataFrame:
    """Candidates among the rows of Parquet files as they arrive; stateless, so late files change nothing."""
    return curate.keyword_candidates(spark.readStream.schema(schema).parquet(path), text, terms, urgent)
