"""Byte-level BPE encoding and decoding by a file of ranks, through the global word shuffle."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .pretokens import shuffle_words

ship(__name__)

#: White space by Unicode's property, as Rust's \s has it (Python's adds U+001C to U+001F).
SPACE, NO_SPACE = r"\p{White_Space}", r"\P{White_Space}"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Letters of the Latin blocks up to U+024F; every other character there beyond ASCII is left to the general way.
LATIN = r"A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u024F"


def finder(pattern: str):
    """text -> all matches of a tokenizer's pattern.

    Texts of ASCII and Latin letters only take the standard library's engine, with the
    classes spelled out; all others one that knows Unicode's properties.
    """
    import re

    import regex

    general = regex.compile(pattern.replace("[^\\s", "[^" + SPACE).replace("\\s", SPACE).replace("\\S", NO_SPACE)).findall
    # Bare classes get brackets, those inside brackets don't.
    plain = re.sub(r"\[\^?[^\]]*\]", lambda m: m[0].replace("\\p{L}", LATIN).replace("\\p{N}", "0-9").replace("\\s", " \\t-\\r"), pattern)
    plain = plain.replace("\\p{L}", f"[{LATIN}]").replace("\\p{N}", "[0-9]").replace("\\s", "[ \\t-\\r]").replace("\\S", "[^ \\t-\\r]")
    simple = re.compile(plain).findall
    other = re.compile(r"[^\x00-\x7F\xC0-\xD6\xD8-\xF6\xF8-\u024F]").search
    return lambda t: simple(t) if t.isascii() or not other(t) else general(t)


def splitter_for(pattern: str):
    """Text -> matches of a tokenizer's pattern."""
    return lambda: finder(pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id", decoded: str | None = None) -> DataFrame:
    """``key, ids array<int>`` for every row of ``docs``; NULL and empty texts have no ids.

    Each distinct match of ``pattern`` is encoded once in the whole corpus and its ids
    are put back at all its positions.  Special tokens' strings are ordinary text.  With
    ``decoded`` a column of that name has the bytes of the ids, as decode() gives them,
    made by the same task without another one in Python behind it.
    """
    def worker():
        import tiktoken

        own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        return lambda words: [own._encode_single_piece(w.encode("utf-8", "surrogatepass")) for w in words]

    kind = docs.schema[key].dataType
    held: list[pa.Array] = []

    def assemble(keys, sizes, ends, slots, answers):
        starts, lengths, flat = answers
        each = lengths[slots]
        total = np.concatenate([[0], np.cumsum(each)])
        tokens = flat[np.repeat(starts[slots] - total[:-1], each) + np.arange(total[-1])]
        offsets = np.concatenate([[0], total[ends]]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens, pa.int32()))
        if decoded is None:
            return pa.RecordBatch.from_arrays([keys, ids], [key, "ids"])
        if not held:
            held.append(token_bytes(ranks_path))
        parts = [joined_bytes(ids.slice(a, b - a), held[0]) for a, b in groups_of(ids)]
        return pa.RecordBatch.from_arrays([keys, ids, pa.concat_arrays(parts)], [key, "ids", decoded])

    more = f", `{decoded}` binary" if decoded else ""
    return shuffle_words(docs, key, text, splitter_for(pattern), worker, assemble, f"`{key}` {kind.simpleString()}, ids array<int>{more}")


#: Texts are decoded in groups of so many ids, a longer text by itself.
GROUP_IDS = 1 << 20


def token_bytes(ranks_path: str) -> pa.Array:
    """The table of token bytes, in order of their ids."""
    known = {i: b for b, i in read_ranks(ranks_path).items()}
    return pa.array([known.get(i) for i in range(max(known) + 1)], pa.large_binary())


def groups_of(lists: pa.ListArray) -> list[tuple[int, int]]:
    """Stretches of lists with GROUP_IDS ids together, or one list with more."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64))
    out, first = [], 0
    while first < len(lists):
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + GROUP_IDS, side="right")))
        out.append((first, last))
        first = last
    return out


def joined_bytes(lists: pa.ListArray, table: pa.Array) -> pa.Array:
    """For each list of ids the bytes of its tokens: ids joined with the table, which puts the bytes of all side by side."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64))
    found = table.take(lists.flatten())
    if found.null_count:
        raise ValueError("an id without a token")
    places = np.frombuffer(found.buffers()[1], dtype=np.int64, count=len(found) + 1, offset=8 * found.offset)
    limits = places[np.concatenate([[0], ends])].astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(limits.tobytes()), found.buffers()[2]])
    return pc.if_else(pc.is_valid(lists), whole.cast(pa.binary()), pa.scalar(None, pa.binary()))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids: the ids are joined with the table of token bytes, which every task holds.

    The join is Arrow's take() on the column of token bytes in order of their ids.  A NULL
    list stays NULL, an empty one has no bytes; an id that isn't in the table ends the job.
    """
    columns = [c for c in df.columns if c != out]

    def run(batches):
        table = token_bytes(ranks_path)
        for batch in batches:
            lists = batch.column(columns.index(ids))
            for a, b in groups_of(lists):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, joined_bytes(lists.slice(a, b - a), table)], [*columns, out])

    from pyspark.sql import types as T

    return df.select(*columns).mapInArrow(run, T.StructType([*df.select(*columns).schema.fields, T.StructField(out, T.BinaryType())]))


def digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of encode() with the decoded bytes of its ids."""
    both = encode(docs, ranks_path, pattern, text, key, decoded="decoded")
    return both.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
