"""WordPiece by a vocabulary file: greedy longest matches, once for each distinct word of a stretch of a batch.

Texts are cleaned and cut into words by generated code in the JVM, as the public encoder
models do it: control characters go, ideographs stand alone, white space separates, and every
punctuation character is a word.  Only words go to Python, in Arrow batches; there each
distinct word of a stretch of texts (of a megabyte, whatever the batch) is cut up once and its pieces are taken back to all its places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.workers import joined, parts, ship
from . import tokens

ship(__name__)

#: Words with more characters are unknown as a whole.
LONGEST_WORD = 100
UNKNOWN, CONTINUED = "[UNK]", "##"
#: Control, format, unassigned and private characters other than tab and line ends, and the replacement character.
REMOVED = r"[\p{C}&&[^\t\n\r]]|\x{FFFD}"
# The blocks of ideographs that stand alone.
IDEOGRAPHS = r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B920}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}])"


def words(c: Column) -> Column:
    """The words of a text before WordPiece."""
    return tx.pretokens(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), REMOVED, ""), IDEOGRAPHS, " $1 "))


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """The pieces of a vocabulary file by id: one a line, in any store that Spark reads."""
    lines = spark.read.text(path, wholetext=True).first()[0].split("\n")
    return [x.rstrip("\r") for x in (lines[:-1] if lines and not lines[-1] else lines)]


def cut_up(word: str, pieces: dict[str, int], longest: int) -> list[str]:
    """The longest piece at each place, those behind the first marked as continued; unknown as a whole if one place has none."""
    if len(word) > LONGEST_WORD:
        return [UNKNOWN]
    out, at = [], 0
    while at < len(word):
        mark = CONTINUED if at else ""
        end = next((e for e in range(min(len(word), at + longest), at, -1) if mark + word[at:e] in pieces), None)
        if end is None:
            return [UNKNOWN]
        out.append(mark + word[at:end])
        at = end
    return out


def tokenizer(vocabulary: list[str], ids: bool = False):
    """Column -> array of pieces, or of their ids, by a vocabulary; a NULL text has none.

    The vocabulary is a parameter and travels with the function; a worker indexes it once.
    """
    held: list[tuple[dict[str, int], int]] = []

    def pieces(lists: pa.Array) -> pa.Array:
        if not held:
            held.append(({p: i for i, p in enumerate(vocabulary)}, max(map(len, vocabulary), default=0)))
        return joined([some(part) for part in parts(lists)], pa.list_(pa.int32() if ids else pa.string()))

    def some(lists: pa.Array) -> pa.Array:
        known, longest = held[0]
        coded = lists.flatten().dictionary_encode()
        found = [cut_up(w, known, longest) for w in coded.dictionary.to_pylist()]
        by_word = pa.array([[known[p] for p in x] for x in found], pa.list_(pa.int32())) if ids else pa.array(found, pa.list_(pa.string()))
        taken = by_word.take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(taken.offsets.take(pa.array(ends.astype(np.int32))), taken.flatten())

    if ids and UNKNOWN not in vocabulary:
        raise ValueError(f"a vocabulary without {UNKNOWN} gives no ids")
    apply = F.arrow_udf(pieces, "array<int>" if ids else "array<string>")
    return lambda c: apply(words(c))


def profile(docs: DataFrame, text: str, vocabularies: dict[str, list[str]]) -> DataFrame:
    """tokens.profile() by vocabularies of these names."""
    return tokens.profile(docs, text, {name: tokenizer(v) for name, v in vocabularies.items()})
