"""Phrase mining: n-gram counts from word-id suffix arrays, then collocation scores in SQL functions.

Texts are taken in shards of SHARD_BYTES.  A shard gives its words ids in byte order, by
language, with 0 between pieces, and sorts the suffixes of the ids by prefix doubling:
ranks of one word make ranks of two, those ranks of four, until ``longest`` words decide.
The longest common prefixes of neighbours cut the suffix array into intervals; an interval of
depth d that no 0 cuts short is a phrase of d words and its length the phrase's count.  Every
phrase of a shard goes to the shuffle once, with its count, in compressed blocks by hash of its words;
counts are added up by phrase, and those below ``least`` go, which no candidate has as a
part: a part occurs at least as often as the whole.  So a phrase that is everywhere weighs
one entry a shard, and neither a language nor a first word makes a hot key.

What is left is a table of frequent phrases; candidates, their cuts, what covers them and the
ranks are joins and groupings of that table, with exact products as decimals of 38 digits
(some 10 ** 16 occurrences of one phrase).

Defined results: a NULL language is ``und``; a NULL or empty text has no words; repeated rows
count each; an empty table gives no rows; further columns of any name are ignored.  One text
is taken as a unit.  Runs jobs when it is called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship
from .pretokens import _input_bytes

ship(__name__)

SHARD_BYTES = 8 << 20
#: One part of the phrases for so many bytes of input.
PART_BYTES = 8 << 20
LONGEST, LEAST, COVER_PERCENT, TOP = 3, 10, 50, 2000
SCALE = 1_000_000
#: The rows of a language are ranked in so many parts first.
RANK_PARTS = 64
ODD = 0x9E3779B97F4A7C15
BETWEEN_PIECES = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
BETWEEN_WORDS = BETWEEN_PIECES | np.isin(np.arange(256), list(b" \t"))
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The ids of the words of all texts, from 1 in byte order, with a 0 behind each piece; and the words by id - 1."""
    data = LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    word = ~BETWEEN_WORDS[data]
    edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.int64), pa.array([], pa.large_binary())
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    piece = np.searchsorted(np.flatnonzero(BETWEEN_PIECES[data]), starts)
    before = np.concatenate([[0], np.cumsum(np.diff(piece) > 0)])
    ids = np.zeros(len(starts) + int(before[-1]) + 1, dtype=np.int64)
    ids[np.arange(len(starts)) + before] = rank[coded.indices.to_numpy()]
    return ids, coded.dictionary.take(pa.array(order))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``ids`` in order of their first ``depth`` ids at least, by prefix doubling."""
    rank, known = ids, 1
    order = np.argsort(ids, kind="stable") if depth <= 1 else None
    while known < depth:
        behind = np.concatenate([rank[known:], np.zeros(min(known, len(rank)), dtype=np.int64)])
        key = rank * (int(rank.max(initial=0)) + 1) + behind
        order = np.argsort(key)
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
        known *= 2
    return order


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many ids, ``depth`` at most, each suffix has in common with the one before it; the first has none."""
    padded = np.concatenate([ids, np.zeros(depth, dtype=np.int64)])
    same, out = np.ones(max(len(order) - 1, 0), dtype=bool), np.zeros(len(order), dtype=np.int64)
    for d in range(depth):
        here = padded[order + d]
        same &= here[1:] == here[:-1]
        out[1:] += same
    return out


def shard_counts(texts: list[bytes], longest: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(phrases, counts, hashes) of 0, 1, ... ``longest`` words; the phrase without words counts all words."""
    ids, words = word_ids(texts)
    order = suffix_array(ids, longest)
    shared = common_prefixes(ids, order, longest)
    letters = np.fromiter((zlib.crc32(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))
    yield pa.array([b""], pa.large_binary()), np.array([np.count_nonzero(ids)]), np.zeros(1, dtype=np.uint64)
    padded = np.concatenate([ids, np.zeros(longest, dtype=np.int64)])
    for d in range(1, longest + 1):
        first = np.flatnonzero(shared < d)
        counts = np.diff(np.append(first, len(order)))
        rows = padded[order[first][:, None] + np.arange(d)]
        whole = (rows > 0).all(axis=1)
        rows, counts = rows[whole] - 1, counts[whole]
        key = np.zeros(len(rows), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(d):
                key = (key + letters[rows[:, j]] + np.uint64(1)) * np.uint64(ODD)
                key ^= key >> np.uint64(29)
        said = [words.take(pa.array(rows[:, j])) for j in range(d)]
        yield (pc.binary_join_element_wise(*said, pa.scalar(b" ", pa.large_binary())) if d > 1 else said[0]), counts, key


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``lang, phrase, f`` of all phrases up to ``longest`` words that occur ``least`` times, and of the empty one, which occurs once a word."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), _input_bytes(texts, "text") // PART_BYTES)

    def blocks(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for name, own in held.items():
            said, counts, keys = zip(*shard_counts(own, longest))
            part = (np.concatenate(keys) >> np.uint64(32)).astype(np.int64) * parts >> 32
            order = np.argsort(part, kind="stable")
            table = pa.table([pa.chunked_array(said).combine_chunks(), pa.array(np.concatenate(counts))], names=["phrase", "f"]).take(pa.array(order))
            ends = [*(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
            places = list(zip([0, *ends], ends))
            bodies = [_packed(table.slice(a, b - a)) for a, b in places]
            yield pa.RecordBatch.from_arrays([pa.array([int(part[order[a]]) for a, _ in places], pa.int32()), pa.array([name] * len(places)), pa.array(bodies, pa.binary())], ["part", "lang", "body"])

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(name, []).append(raw.as_py())
                size += len(held[name][-1])
                if size >= SHARD_BYTES:
                    yield from blocks(held)
                    held, size = {}, 0
        yield from blocks(held)

    def merge(table: pa.Table) -> pa.Table:
        out = []
        for name in pc.unique(table.column("lang")).to_pylist():
            own = table.filter(pc.equal(table.column("lang"), name)).column("body").to_pylist()
            summed = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in own]).group_by("phrase", use_threads=False).aggregate([("f", "sum")])
            kept = summed.filter(pc.or_(pc.greater_equal(summed.column("f_sum"), least), pc.equal(pc.binary_length(summed.column("phrase")), 0)))
            out.append(pa.table([pa.array([name] * len(kept), pa.string()), kept.column("phrase").cast(pa.large_string()).cast(pa.string()), kept.column("f_sum")], names=["lang", "phrase", "f"]))
        return pa.concat_tables(out)

    sent = texts.mapInArrow(shards, "part int, lang string, body binary")
    return sent.groupBy("part").applyInArrow(merge, "lang string, phrase string, f long")


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _part_of(words: Column, first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, cover_percent: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of 2 to ``longest`` words of each language.

    A phrase is scored at its weakest cut, floor(SCALE * a * a / (l * r)); it is dropped if a
    longer candidate holds its words in a row and occurs ``cover_percent`` percent as often or more.
    """
    return ranked(cut(frequent_phrases(docs, text, lang, longest, least)), cover_percent, top)


def ranked(counts: DataFrame, cover_percent: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """collocations() from the table of frequent_phrases(), which has every part of its phrases."""
    size = F.size("words")
    candidates = counts.where("phrase <> ''").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words")).where(size >= 2)

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part_of(F.col("words"), 1, F.col("k")).alias("head"), _part_of(F.col("words"), F.col("k") + 1, size).alias("tail"))
    scored = (
        cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
        .join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
        .withColumns({c: F.col(c).cast("decimal(19,0)") for c in "alr"})
        .withColumn("score", F.expr(f"cast({SCALE} * cast(a * a as decimal(32,0)) as decimal(38,0)) div (l * r)"))
        .groupBy("lang", "phrase", F.col("a").cast("long").alias("a")).agg(F.min(F.struct("score", "k", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))).alias("best"))
    )

    inner = candidates.where(size > 2).withColumn("m", F.explode(F.sequence(F.lit(2), size - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    covered = inner.select("lang", _part_of(F.col("words"), F.col("at"), F.col("m")).alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    open_ = scored.join(covered, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (100 * F.col("cover") < cover_percent * F.col("a")))

    rows = open_.select("lang", "phrase", "a", "best.score", "best.l", "best.r")
    by = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*by))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    words = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
