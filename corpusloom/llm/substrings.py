"""Removal of passages that occur more than once, by prefix-partitioned suffix trees.

A suffix is what follows a word of a text, up to ``length`` words.  Its path is the row of
its segments' fingerprints: segments of SEGMENT words (the last one overlaps where they
don't fit), 32 bits each, 160 bits for 35 words.  Suffixes with one path down to the full depth
repeat, and paths are taken for the words: the chance that any two of 10 ** 13 suffixes
agree by accident is below 10 ** -20.

1. Texts are written once, in chunks of CHUNK_BYTES, as a table that is bucketed by chunk,
   so that later steps bring answers to the texts and never shuffle a text.
2. Anchors: each suffix has its least segment fingerprint (64 bits) as anchor; equal suffixes
   have equal anchors.  The distinct anchors of each chunk, one for some 15 words, are
   counted globally.  A suffix whose anchor occurs once repeats nowhere and goes.
3. Vertical partitioning: prefixes of one segment split the suffixes that are left.
   Prefixes that a sample of all suffixes by place finds more than HEAVY times are extended by
   further segments until they are rare, so that every group fits into memory.  The sample decides
   only on places; a path of full depth that is that frequent occurs twice in the sample,
   is thereby known to repeat, and is never sent.
4. A chunk sends each distinct path once to the group of its prefix, however often it
   occurs there.  A group sorts its suffixes, which is its subtree in order of the leaves, and takes
   the longest common prefixes of neighbours; the internal nodes of full depth are the runs of
   neighbours that share it.  Each chunk learns which of its paths end below such a node.
5. Repeated suffixes that overlap join to the maximal repeats of a text, whose words go.

Defined results: a NULL or empty text has no words; texts of fewer words than ``length`` keep
all; repeated rows and keys and NULL keys are rows of their own, and equal texts repeat each
other wherever they are; an empty table gives no rows; further columns of any name are ignored.
One text is taken as a unit.  Runs jobs when it is called.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, cut, shared_folder, ship
from .pretokens import _input_bytes

ship(__name__)

LENGTH = 35
SEGMENT = 7
CHUNK_BYTES = 4 << 20
#: Bytes whose words are hashed at once.
SLAB = 1 << 20
#: One suffix of so many is in the sample; a prefix seen SEEN times there is heavy.
SAMPLE = 1 << 10
SEEN = 1 << 7
HEAVY = SAMPLE * SEEN
#: No more heavy prefixes of a depth than this; with more suffixes they are called heavy later.
MOST_HEAVY = 1 << 20
#: Suffixes that one group gets of even prefixes.
GROUP = 1 << 20
#: One part of the anchors for so many bytes of the table of texts, or one a shuffle partition where these are more.
PART_BYTES = 128 << 20
ODD = 0x9E3779B97F4A7C15 | 1
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
PARTS = "chunk bigint, part int, body binary"
SAMPLED = -1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What _tables() has made in this process.
MADE: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the bytes, blanks having 0; ``size`` powers of an odd number and of its inverse."""
    if size in MADE:
        return MADE[size]
    letters = np.where(BLANK, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64)))
    powers, inverse = np.full(size, ODD, dtype=np.uint64), np.full(size, pow(ODD, -1, 1 << 64), dtype=np.uint64)
    powers[0] = inverse[0] = 1
    MADE.clear()
    MADE[size] = letters, np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
    return MADE[size]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte and a 64-bit hash of each word between blanks of an array of bytes."""
    places, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + SLAB, len(data))
        if end < len(data):  # a slab ends behind a blank, however far that is
            last = np.flatnonzero(BLANK[data[at:end]])
            more = np.flatnonzero(BLANK[data[end:]]) if not len(last) else None
            end = at + int(last[-1]) + 1 if more is None else end + int(more[0]) + 1 if len(more) else len(data)
        part = data[at:end]
        letters, powers, inverse = _tables(max(SLAB, 1 << (len(part) - 1).bit_length()))
        edges = np.flatnonzero(np.diff((~BLANK[part]).view(np.int8), prepend=0, append=0))
        starts, sizes = edges[::2], (edges[1::2] - edges[::2]).astype(np.uint64)
        if len(starts):
            sums = np.add.reduceat(letters[part] * powers[: len(part)], starts) * inverse[starts]
            places.append(at + starts)
            hashes.append(mix(sums + mix(sizes)))
        at = end
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))


def sliding(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a = op(a[: len(a) - step], a[step:])
        done += step
    return a


class Chunk:
    """The suffixes of a chunk's texts."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.step = length, min(SEGMENT, length)
        ends = np.cumsum([len(t) + 1 for t in texts])
        with np.errstate(over="ignore"):
            starts, all_words = words_of(np.frombuffer(b" ".join(texts), dtype=np.uint8))
            self.words = np.diff(np.searchsorted(starts, ends), prepend=0)
            n = len(all_words) - length + 1
            if n <= 0:
                self.valid, self.least, self.segments = (np.zeros(0, dtype=k) for k in (bool, np.uint64, np.uint64))
                return
            h = np.zeros(len(all_words) - self.step + 1, dtype=np.uint64)
            for j in range(self.step):
                h = h * np.uint64(ODD) + all_words[j : j + len(h)]
            self.segments = np.maximum(mix(h), np.uint64(1))
        of = np.repeat(np.arange(len(self.words)), self.words)
        self.valid = of[:n] == of[length - 1 :]
        self.least = sliding(self.segments, length - self.step + 1, np.minimum)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors in order, and whether they stand at two places of this chunk."""
        if not self.valid.any():
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        reach = self.length - self.step
        shown = np.pad(np.where(self.valid, self.least, np.uint64(0)), reach)
        at = sliding(shown, reach + 1, np.maximum) == self.segments
        values, counts = np.unique(self.segments[at], return_counts=True)
        return values, counts > 1

    def paths(self, places: np.ndarray) -> np.ndarray:
        """The fingerprints of the segments of the suffixes at ``places``, a row each."""
        offsets = [min(j, self.length - self.step) for j in range(0, self.length, self.step)]
        return np.stack([(self.segments[places + o] >> np.uint64(32)).astype(np.uint32) for o in offsets], axis=1) if len(places) else np.zeros((0, len(offsets)), dtype=np.uint32)


def in_order(paths: np.ndarray) -> np.ndarray:
    """The order of rows by their columns from the left, two columns being one key."""
    wide = paths.astype(np.uint64)
    keys = [wide[:, j] << np.uint64(32) | wide[:, j + 1] if j + 1 < wide.shape[1] else wide[:, j] for j in range(0, wide.shape[1], 2)]
    return np.lexsort(keys[::-1])


def common_prefixes(paths: np.ndarray) -> np.ndarray:
    """For rows in order, how many columns each has in common with the one before; the first has none."""
    same = np.ones(max(len(paths) - 1, 0), dtype=bool)
    out = np.zeros(len(paths), dtype=np.int64)
    for j in range(paths.shape[1]):
        same = same & (paths[1:, j] == paths[:-1, j])
        out[1:] += same
    return out


def below_deep_nodes(paths: np.ndarray) -> np.ndarray:
    """Which leaves of the subtree of these suffixes are below an internal node of full depth."""
    order = in_order(paths)
    shared = common_prefixes(paths[order]) == paths.shape[1]
    out = np.zeros(len(paths), dtype=bool)
    out[order] = shared | np.append(shared[1:], False)[: len(shared)]
    return out


def prefix_keys(paths: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit keys of the prefixes of one segment, of two, and so on."""
    key = np.full(len(paths), np.uint64(1))
    with np.errstate(over="ignore"):
        for j in range(paths.shape[1]):
            key = mix(key * np.uint64(ODD) + paths[:, j])
            yield key


def partition(paths: np.ndarray, heavy: list[np.ndarray], whole: set[bytes], groups: int) -> np.ndarray:
    """The group of each suffix: that of its shortest prefix that isn't heavy; -1 where the path itself is in ``whole``."""
    place = np.full(len(paths), -1, dtype=np.int64)
    left = np.ones(len(paths), dtype=bool)
    for key, frequent in zip(prefix_keys(paths), [*heavy, None]):
        if frequent is None:
            rare = left.copy()
            rare[left] = [p.tobytes() not in whole for p in paths[left].astype("<u4")]
        else:
            rare = left & ~np.isin(key, frequent)
        place[rare] = (key[rare] >> np.uint64(32)).astype(np.int64) * groups >> 32
        left &= ~rare
    return place


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The table of texts: chunk, their order in it, key and text; bucketed by chunk."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, size, n = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            ends = size + np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            before = np.concatenate([[size], ends[:-1]]) if len(ends) else ends
            yield pa.RecordBatch.from_arrays([pa.array(first + before // CHUNK_BYTES), pa.array(np.arange(n, n + len(ends))), *batch.columns], ["chunk", "place", "key", "text"])
            size, n = int(ends[-1]) if len(ends) else size, n + len(ends)

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("place", T.LongType()), *rows.schema.fields])
    name = f"corpusloom_texts_{uuid.uuid4().hex}"
    out = rows.mapInArrow(number, schema).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
    out.option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").option("parquet.block.size", BLOCK_BYTES).saveAsTable(name)
    return spark.table(name)


def _texts(table: pa.Table) -> tuple[pa.Array, list[bytes]]:
    table = table.sort_by("place")
    return table.column("key").combine_chunks(), table.column("text").to_pylist()


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    chunk, part, body = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(chunk, pa.int64()), pa.array(part, pa.int32()), pa.array(body, pa.binary())], names=["chunk", "part", "body"])


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of an array of parts; the places keep their order."""
    order = np.argsort(part, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        yield int(part[places[0]]), places


def _repeats(values: np.ndarray) -> np.ndarray:
    """Which of these numbers occur twice."""
    _, at, counts = np.unique(values, return_inverse=True, return_counts=True)
    return counts[at] > 1


def _answered(kind: str, width: int, find):
    """A function for applyInArrow: the bodies of a part, of all chunks together, through ``find``; each chunk gets bits."""

    def run(table: pa.Table) -> pa.Table:
        bodies = [np.frombuffer(b, dtype=kind) for b in table.column("body").to_pylist()]
        found = find(np.concatenate(bodies).reshape(-1, width) if width > 1 else np.concatenate(bodies))
        ends = np.cumsum([len(b) // width for b in bodies])
        bits = [np.packbits(x).tobytes() for x in np.split(found, ends[:-1])]
        return _rows(list(zip(table.column("chunk").to_pylist(), table.column("part").to_pylist(), bits)))

    return run


def _bits(answers: dict[int, bytes], part: np.ndarray) -> np.ndarray:
    """The answers by part, put back to the places they belong to; no part, no bit."""
    out = np.zeros(len(part), dtype=bool)
    for p, places in _by_part(part):
        if p >= 0:
            out[places] = np.unpackbits(np.frombuffer(answers[p], dtype=np.uint8), count=len(places)).view(bool)
    return out


def _anchor_part(values: np.ndarray, parts: int) -> np.ndarray:
    return (values >> np.uint64(32)).astype(np.int64) * parts >> 32


def _repeated_places(chunk: Chunk, answers: dict[int, bytes], parts: int) -> np.ndarray:
    """The suffixes whose anchor occurs twice."""
    values, twice = chunk.anchors()
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    twice = twice | _bits(answers, _anchor_part(values, parts))
    places = np.flatnonzero(chunk.valid)
    return places[twice[np.searchsorted(values, chunk.least[places])]]


def _distinct(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in order, the row of each, and how often each row occurs."""
    order = in_order(paths)
    new = common_prefixes(paths[order]) < paths.shape[1]
    of = np.empty(len(paths), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return paths[order[new]], of, np.bincount(of, minlength=int(new.sum()))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``key, n_words, spans, kept`` for every row of ``docs``.

    spans are the maximal repeats of the text as [start, end) of its words, in order: every
    word is in one that is covered by ``length`` words in a row which also start elsewhere,
    in any text.  kept has all other words, joined by one blank.
    """
    spark = docs.sparkSession
    texts = _numbered(docs, key, text)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, _input_bytes(texts, "text") // PART_BYTES)

    def anchors(table: pa.Table) -> pa.Table:
        number = table.column("chunk")[0].as_py()
        chunk = Chunk(_texts(table)[1], length)
        values, _ = chunk.anchors()
        out = [(number, p, values[at].astype("<u8").tobytes()) for p, at in _by_part(_anchor_part(values, parts))]
        places = np.flatnonzero(chunk.valid)
        with np.errstate(over="ignore"):
            drawn = places[mix(places.astype(np.uint64) + mix(np.array([number], dtype=np.uint64))) % np.uint64(SAMPLE) == 0]
        return _rows([*out, (number, SAMPLED, chunk.paths(drawn).astype("<u4").tobytes())])

    said = cut(texts.groupBy("chunk").applyInArrow(anchors, PARTS))
    first = cut(said.where(F.col("part") >= 0).groupBy("part").applyInArrow(_answered("<u8", 1, _repeats), PARTS))
    depth = -(-length // min(SEGMENT, length))
    heavy, whole, groups = _heavy_prefixes(said.where(F.col("part") == SAMPLED), depth, tasks)

    def suffixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([])
        chunk = Chunk(_texts(table)[1], length)
        paths, _, _ = _distinct(chunk.paths(_repeated_places(chunk, _of(answers), parts)))
        part = partition(paths, heavy, whole, groups)
        return _rows([(table.column("chunk")[0].as_py(), p, paths[at].astype("<u4").tobytes()) for p, at in _by_part(part) if p >= 0])

    sent = texts.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(suffixes, PARTS)
    second = sent.groupBy("part").applyInArrow(_answered("<u4", depth, below_deep_nodes), PARTS)
    both = first.withColumn("body", F.concat(F.lit(b"a"), "body")).union(second.withColumn("body", F.concat(F.lit(b"s"), "body")))

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, raw = _texts(table)
        chunk = Chunk(raw, length)
        places = _repeated_places(chunk, _of(answers, b"a"), parts)
        paths, of, counts = _distinct(chunk.paths(places))
        part = partition(paths, heavy, whole, groups)
        repeated = (counts > 1) | (part < 0) | _bits(_of(answers, b"s"), part)
        step = np.zeros(int(chunk.words.sum()) + 1, dtype=np.int64)
        np.add.at(step, places[repeated[of]], 1)
        np.add.at(step, places[repeated[of]] + length, -1)
        gone = np.cumsum(step)[:-1] > 0
        spans, kept, at = [], [], 0
        for n, t in zip(chunk.words.tolist(), raw):
            own = gone[at : at + n]
            at += n
            edges = np.flatnonzero(np.diff(own.view(np.int8), prepend=0, append=0)).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
            kept.append(b" ".join(compress(t.split(), (~own).tolist())))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([keys, pa.array(chunk.words), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["key", "n_words", "spans", "kept"])

    schema = T.StructType([
        T.StructField("key", texts.schema["key"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType()),
    ])
    out = texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(remove, schema)
    return out.select(F.col("key").alias(key), "n_words", "spans", F.col("kept").cast("string").alias("kept"))


def _of(answers: pa.Table, mark: bytes = b"") -> dict[int, bytes]:
    """The answers of a chunk by part, those whose body begins with ``mark``."""
    rows = zip(answers.column("part").to_pylist(), answers.column("body").to_pylist())
    return {p: b[len(mark) :] for p, b in rows if b.startswith(mark)}


def _heavy_prefixes(sampled: DataFrame, depth: int, tasks: int) -> tuple[list[np.ndarray], set[bytes], int]:
    """By depth the keys of the prefixes that too many suffixes have, the whole paths that have so many, and the number of groups.

    A list is bounded by MOST_HEAVY: with more suffixes a prefix is heavy later.
    """

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for body in (b for batch in batches for b in batch.column(0).to_pylist()):
            paths = np.frombuffer(body, dtype="<u4").reshape(-1, depth)
            for d, key in enumerate(prefix_keys(paths)):
                path = [p.tobytes() for p in paths] if d == depth - 1 else [None] * len(key)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), d, dtype=np.int32)), pa.array(key.view(np.int64)), pa.array(path, pa.binary())], ["d", "prefix", "path"])

    n = (sampled.agg(F.sum(F.octet_length("body")).alias("n")).first().n or 0) // (4 * depth)
    counted = sampled.select("body").mapInArrow(prefixes, "d int, prefix long, path binary").groupBy("d", "prefix", "path").agg(F.count("*").alias("n"))
    found = counted.where(F.col("n") >= max(SEEN, n // MOST_HEAVY)).collect()
    heavy = [np.sort(np.array([r.prefix for r in found if r.d == d], dtype=np.int64).view(np.uint64)) for d in range(depth - 1)]
    return heavy, {bytes(r.path) for r in found if r.path is not None}, max(tasks, n * SAMPLE // GROUP)
