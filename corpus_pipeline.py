"""The document pipeline: quality rules, near-duplicates, decontamination, PII, tokens.

Every stage takes what its predecessor kept, written as Parquet and read again.  The
stages judge texts as they then are: quality and copies on raw texts, benchmark
passages before pseudonyms could hide them, tokens of the texts as they will be trained on.

All stages take rows with NULLs in any column, empty and very long texts, repeated keys
and rows, and further columns of any name; an empty table gives an empty result.  All but
the last return their input's columns.  Stages run jobs when they are called.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontam, pii, quality, simhash
from corpusloom.llm.common import fresh, remove, shared_folder, table

#: SQL can't express the stages from the second on; they are tested against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the texts that pass the base rules and the certified cutoffs of their language.

    NULL and empty texts fail; a NULL language has the base rules only; repeated rows stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one text of each group of near-duplicates, that of the smallest doc_id.

    A NULL doc_id comes after all others, of equal ones the least text hash is kept; rows
    without words are one group; rows with equal doc_id and text are one row.
    """
    return simhash.keep_one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the texts that hold a window of a benchmark item; texts without words stay, repeated rows too."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal values by format-preserving pseudonyms; n_chars, if there is one, follows the new text.

    NULL texts stay with their n_chars; every row and every other column stays.
    """
    out = pii.pseudonymise(docs, pii.key_or_drawn(spark), count=fresh(docs, "_n_values"))
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(size))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left and decode it again: the digests of ids and bytes by doc_id, a row for every row; NULL is empty."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("feistel_pii", pseudonyms),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each result but the last goes through the shared folder.

    A stage's files are removed once the next stage has been written; those that the
    returned frame reads stay.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
