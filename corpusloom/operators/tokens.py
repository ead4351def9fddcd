"""How tokenizers fragment texts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import text as tx
from ..functions.workers import joined, parts, ship

ship(__name__)

#: Bytes of texts that a library encodes at once.
ENCODED_BYTES = 1 << 17
#: Tokenizers by name: Column -> array of tokens.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"words": tx.words, "pretokens": tx.pretokens}


def profile(docs: DataFrame, text: str, tokenizers: dict[str, Callable[[Column], Column]] = TOKENIZERS) -> DataFrame:
    """A row per text and tokenizer: n_words, n_tokens and tokens per word (NULL without words)."""
    rows = [F.struct(F.lit(n).alias("tokenizer"), F.size(f(F.col(text))).cast("long").alias("n_tokens")) for n, f in tokenizers.items()]
    df = docs.withColumn("n_words", tx.word_count(F.col(text))).select("*", F.explode(F.array(*rows)).alias("_t"))
    return df.select(*docs.columns, "n_words", "_t.*").withColumn("tokens_per_word", tx.ratio(F.col("n_tokens"), F.col("n_words")))


def compare(profiled: DataFrame) -> DataFrame:
    """The plain mean of the rows' ratios by tokenizer; the lowest fragments least.

    ``n`` counts all rows, the mean has those with a ratio.  Ratios are added up as whole
    numbers, of 1, of 2^-26 and of 2^-52 (the last bit of a ratio of 1 to 2), so that no order of rows
    changes the mean.
    """
    ratio, unit = F.col("tokens_per_word"), float(1 << 26)
    high = (ratio - F.floor(ratio)) * unit
    low = (high - F.floor(high)) * unit
    total = F.sum(F.floor(ratio)) + (F.sum(F.floor(high)) + F.sum(F.floor(low)) / unit) / unit
    return profiled.groupBy("tokenizer").agg(tx.ratio(total, F.count(ratio)).alias("mean_ratio"), F.count("*").alias("n"))


def truncate(tokens: Column, size: int) -> Column:
    return F.slice(tokens, 1, size)


def pad(tokens: Column, size: Column | int, filler: str = "[PAD]") -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(tokens, F.array_repeat(F.lit(filler), F.greatest(size - F.size(tokens), F.lit(0))))


def key_terms(spark: SparkSession, terms: list[str] = config.KEY_TERMS, tokenizers: dict[str, Callable[[Column], Column]] = TOKENIZERS) -> DataFrame:
    """``term, tokenizer, n_tokens, tokens``: how each tokenizer cuts up each term."""
    rows = [F.struct(F.lit(n).alias("tokenizer"), F.size(f(F.col("term"))).cast("long").alias("n_tokens"), f(F.col("term")).alias("tokens")) for n, f in tokenizers.items()]
    return spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.explode(F.array(*rows)).alias("_t")).select("term", "_t.*")


def load_tokenizer(path: str) -> Callable[[Column], Column]:
    """The tokenizer of a local file (the JSON of the ``tokenizers`` library) behind the interface of TOKENIZERS: Column -> array of pieces.

    Pieces carry no added begin and end; a NULL text has none.  Every task reads the
    file, so it must lie where all executors find it.
    """
    return _tokenizer("from_file", path)


def tokenizer_of(saved: str) -> Callable[[Column], Column]:
    """load_tokenizer() for the JSON itself, which travels with the function."""
    return _tokenizer("from_str", saved)


def _tokenizer(maker: str, source: str) -> Callable[[Column], Column]:
    held: list = []
    kind = pa.list_(pa.string())

    def pieces(texts: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        if not held:
            own = getattr(Tokenizer, maker)(source)
            own.no_truncation()
            own.no_padding()
            held.append(own)
        # An encoding weighs some hundred times its text, so a few texts at once.
        done = (held[0].encode_batch([t or "" for t in part.to_pylist()], add_special_tokens=False) for part in parts(texts, size=ENCODED_BYTES))
        return joined([pa.array([e.tokens for e in x], kind) for x in done], kind)

    # A NULL text comes in as such and counts as empty.
    return F.arrow_udf(pieces, "array<string>")


def pad_batches(df: DataFrame, tokens: str, size: int, filler: str = "[PAD]") -> DataFrame:
    """Rows in batches of ``size`` with ``tokens`` padded to the longest of their batch, and ``real`` tokens counted.

    Batches are made inside each task, in its order, the last of a task being smaller;
    a NULL list counts as empty.
    """
    columns = [c for c in df.columns if c != "real"]

    def run(batches):
        held, rows = [], 0

        def flush(part: pa.Table) -> pa.RecordBatch:
            lists = [x or [] for x in part.column(tokens).to_pylist()]
            longest = max(map(len, lists))
            arrays = [pa.array([x + [filler] * (longest - len(x)) for x in lists], pa.list_(pa.string())) if c == tokens else part.column(c).combine_chunks() for c in columns]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([len(x) for x in lists], pa.int32())], [*columns, "real"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= size:
                table = pa.Table.from_batches(held)
                for at in range(0, rows - rows % size, size):
                    yield flush(table.slice(at, size))
                rest = table.slice(rows - rows % size)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield flush(pa.Table.from_batches(held))

    schema = df.select(*columns).schema
    return df.select(*columns).mapInArrow(run, T.StructType([*schema.fields, T.StructField("real", T.IntegerType())]))
