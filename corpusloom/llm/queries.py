"""The queries opN_<name> and ``pipeline``: thin digests of the operators' results.

Every query takes its whole tables.  Rows with NULLs in any column, empty and very long
texts, repeated rows and keys, further columns and empty tables give what the operator's
docstring says; none drops a row but op11, which says which, and op3 has one for each conversation with a key.  op4, op5, op6,
op7, op10, op11, op12, op13 and pipeline run jobs when they are called, op2 and op8 only where their input
comes out of a shuffle; the others are declared only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, crf, decontam, html_text, phrases, pii, quality, simhash, substrings, tokencount, warc, whitening
from .common import table
from .sql import ORACLES


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_or_drawn(spark))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.preference_format(chat.next_replies(table(spark, sf_dir, "conversations")))
    loss = lambda c: F.aggregate(c, F.lit(0), lambda acc, s: acc + s["end"] - s["start"]).cast("long")
    return rows.select(
        "pair_id", "n_common", "prompt", "chosen", "rejected",
        loss("chosen_spans").alias("chosen_loss_chars"), loss("rejected_spans").alias("rejected_loss_chars"),
    )


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    # The whole number outgrows 64 bits with some 10 ** 7 distinct vectors and is NULL then; the operator's decimal goes on.
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.repeated_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {k: v for k, v in globals().items() if k == "pipeline" or k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
