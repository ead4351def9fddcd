"""A global word shuffle: work done once per distinct pre-token and joined back to texts.

Texts are taken in chunks of some 8 MB.  Inside a chunk each distinct pre-token gets a
slot, the most frequent the lowest.  The chunk's pre-tokens go to the shuffle once
each, by hash bucket, however often they occur.  A bucket holds all occurrences of its
pre-tokens in the corpus and does the work once for each; the answers return to the
chunks by slot, where they meet the texts' slots (positions or frequencies).  No text is
in a shuffle, and a frequent pre-token weighs one entry a chunk.

Rows of the shuffles are ``chunk, bucket, body``.  A body is compressed and holds arrays
of 32-bit numbers, stored byte plane by byte plane (small numbers leave empty planes), and
UTF-8 or Arrow bytes: of a chunk's words in a bucket the slots, lengths and letters; of
their answers the slots, lengths and values; of a chunk's texts an Arrow batch of keys,
sizes and ends, and the slots and counts of all texts one after another.

The texts are read and split twice, for the two sides of the join: sent through the first
shuffle beside the words, the texts' slots would weigh more than all else.  A chunk is
cut out of the rows of a task, so both readings, and a task that is run again, must meet
the same rows in the same order.  Files are read so; what comes out of a shuffle is
written as a table first.  A chunk is named by a hash of its keys and texts: should sides
that don't belong together meet all the same, the job ends.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

ship(__name__)

CHUNK_BYTES = 8 << 20
#: Rows turned into Python's strings at once.
BATCH_ROWS = 500
#: So many words of a chunk are numbered by frequency.
FREQUENT = 1 << 14
LEVEL = 3
#: One bucket for so many bytes of input, and one task for so many where the session's shuffle partitions are fewer.
BUCKET_BYTES = 32 << 20
TASK_BYTES = 128 << 20
LEAST_BUCKETS, MOST_BUCKETS = 256, 1 << 16
PACKED = "chunk bigint, bucket int, body binary"


class Slots(dict):
    """Numbers its keys in the order of their first use."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def pack(numbers: list[np.ndarray], data: bytes = b"") -> bytes:
    """Arrays of 32-bit numbers and bytes as one compressed body."""
    head = np.array([len(numbers), *map(len, numbers)], dtype="<u8").tobytes()
    planes = [np.asarray(a).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in numbers]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([head, *planes, data]))


def unpack(body: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    k = int(np.frombuffer(raw, dtype="<u8", count=1)[0])
    sizes = np.frombuffer(raw, dtype="<u8", count=k, offset=8)
    at, out = 8 * (k + 1), []
    for n in map(int, sizes):
        out.append(np.frombuffer(raw, dtype=np.uint8, count=4 * n, offset=at).reshape(4, n).T.copy().view("<u4").reshape(-1))
        at += 4 * n
    return out, raw[at:]


def pack_words(slots: list[int] | np.ndarray, words: list[str]) -> bytes:
    """Slots in ascending order and their words."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    return pack([np.diff(np.array(slots, dtype=np.int64), prepend=0), np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))], b"".join(raw))


def unpack_words(body: bytes) -> tuple[np.ndarray, list[str]]:
    """The slots' steps as they are, and the words."""
    (steps, lengths), raw = unpack(body)
    ends = np.cumsum(lengths.astype(np.int64)).tolist()
    return steps, [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)]


def _chunks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[pa.Array], list[str]]]:
    """(name, key arrays, texts) of runs of rows; a text beyond the limit ends its chunk."""
    keys: list[pa.Array] = []
    texts: list[str] = []
    size, name = 0, xxhash.xxh64()
    for batch in (big.slice(at, BATCH_ROWS) for big in batches for at in range(0, big.num_rows, BATCH_ROWS)):
        first = 0
        for i, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            text = text or ""
            raw = text.encode("utf-8", "surrogatepass")
            name.update(repr(key).encode() + b"\0" + raw + b"\0")
            texts.append(text)
            size += len(raw)
            if size >= limit:
                yield name.intdigest() - (1 << 63), [*keys, batch.column(0).slice(first, i + 1 - first)], texts
                keys, texts, size, name, first = [], [], 0, xxhash.xxh64(), i + 1
        if first < batch.num_rows:
            keys.append(batch.column(0).slice(first))
    if texts:
        yield name.intdigest() - (1 << 63), keys, texts


def _row(chunk: int, bucket: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([body], pa.binary())], ["chunk", "bucket", "body"]
    )


def _input_bytes(pairs: DataFrame, text: str) -> int:
    """The optimizer's estimate where it has one, else the counted size of the texts."""
    known = int(str(pairs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 50:
        return known
    return pairs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def _as_files(pairs: DataFrame) -> DataFrame:
    """``pairs``, written as a table first where it comes out of a shuffle, whose rows may come in another order the next time."""
    return cut(pairs) if "Exchange" in pairs._jdf.queryExecution().executedPlan().toString() else pairs


def shuffle_words(
    docs: DataFrame, key: str, text: str, splitter: Callable[[], Callable[[str], list[str]]],
    worker: Callable[[], Callable[[list[str]], list[list[int]]]], assemble: Callable[..., pa.RecordBatch],
    schema: str, frequencies: bool = False, buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per row of ``docs`` by ``assemble(keys, sizes, ends, slots, answers[, counts])``.

    splitter() makes the function text -> pre-tokens, worker() the function from distinct
    pre-tokens to answers, lists of ints; both run once per task.  keys are an Arrow array,
    sizes the texts' bytes; ``slots[ends[i-1]:ends[i]]`` belong to text i: its pre-tokens
    in order, or with ``frequencies`` its distinct ones beside their counts.  ``answers`` is
    (starts, lengths, flat): the answer of a slot is ``flat[start:start+length]``.
    A NULL text is empty; repeated keys stay apart; the empty table gives no rows.

    The number of buckets grows with the input, so that the words which one bucket knows
    stay few; tasks grow with it beyond the session's shuffle partitions.
    """
    pairs = docs.select(F.col(key), F.col(text))
    size = _input_bytes(pairs, text)
    pairs = _as_files(pairs)
    if buckets is None:
        buckets = min(max(LEAST_BUCKETS, size // BUCKET_BYTES), MOST_BUCKETS)
    tasks = -(-size // TASK_BYTES)

    def spread(df: DataFrame, by: str) -> DataFrame:
        more = tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(tasks, by) if more else df.repartition(by)

    def numbered(split, texts: list[str]):
        """The chunk's words by slot and their buckets; slots, counts and ends of its texts."""
        slots, places, counts, ends = Slots(), array("I"), array("I"), array("Q")
        for t in texts:
            found = split(t)
            if frequencies:
                tally = Counter(found)
                places.extend(map(slots.__getitem__, tally))
                counts.extend(tally.values())
            else:
                places.extend(map(slots.__getitem__, found))
            ends.append(len(places))
        at = np.frombuffer(places, dtype=np.uint32) if places else np.zeros(0, dtype=np.uint32)
        words, n = list(slots), len(slots)
        bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), dtype=np.int64, count=n)
        # The most frequent words get the lowest slots, all others lie side by side in their buckets.
        order = np.argsort(-np.bincount(at, minlength=n), kind="stable")
        order[FREQUENT:] = order[FREQUENT:][np.argsort(bucket[order[FREQUENT:]], kind="stable")]
        rank = np.empty(n, dtype=np.uint32)
        rank[order] = np.arange(n, dtype=np.uint32)
        return words, order, bucket[order], rank[at], np.array(counts, dtype=np.uint32), np.array(ends, dtype=np.int64)

    def words(batches):
        split = splitter()
        for chunk, _, texts in _chunks(batches, chunk_bytes):
            said, order, bucket, *_ = numbered(split, texts)
            inside = np.argsort(bucket, kind="stable")
            for part in np.split(inside, np.flatnonzero(np.diff(bucket[inside])) + 1) if len(said) else []:
                yield _row(chunk, int(bucket[part[0]]), pack_words(part, [said[i] for i in order[part].tolist()]))

    def bodies(batches):
        split = splitter()
        for chunk, keys, texts in _chunks(batches, chunk_bytes):
            said, _, _, places, counts, ends = numbered(split, texts)
            sizes = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            table = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(sizes, pa.int64()), pa.array(ends)], ["key", "size", "end"])
            yield _row(chunk, -1, pack([np.array([len(said)]), places, counts], table_bytes(table)))

    def answers(batches):
        work = worker()
        now, known = None, {}  # of one bucket at a time: the rows are sorted by it
        for batch in batches:
            for chunk, bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket != now:
                    now, known = bucket, {}
                steps, said = unpack_words(body.as_py())
                new = [w for w in said if w not in known]
                known.update(zip(new, (array("i", x).tobytes() for x in work(new))))
                got = [known[w] for w in said]
                lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4
                yield _row(chunk, bucket, pack([steps, lengths, np.frombuffer(b"".join(got), dtype=np.int32).view(np.uint32)]))

    def joined(table: pa.Table) -> pa.Table:
        texts, parts = [], {}
        for bucket, packed in zip(table.column("bucket").to_pylist(), table.column("body")):
            if bucket < 0:
                texts.append(packed)  # equal chunks have one name; each is done below
            else:
                parts[bucket] = packed
        out = []
        ready = None
        for packed in texts:
            (n, places, counts), raw = unpack(packed.as_py())
            rows = table_of(raw)
            if ready is None:
                n = int(n[0])
                starts, lengths = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
                flat, end = [], 0
                for part in parts.values():
                    (steps, sizes, said), _ = unpack(part.as_py())
                    at, sizes = np.cumsum(steps.astype(np.int64)), sizes.astype(np.int64)
                    lengths[at] = sizes
                    starts[at] = end + np.cumsum(sizes) - sizes
                    flat.append(said.view(np.int32))
                    end += len(said)
                if (starts < 0).any():
                    raise RuntimeError("a chunk of texts met the pre-tokens of another; the input isn't read in one order")
                ready = (starts, lengths, np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32))
            args = (rows.column(0), rows.column(1), rows.column(2).to_numpy(), places, ready)
            out.append(assemble(*args, counts.astype(np.int64)) if frequencies else assemble(*args))
        if parts and not texts:
            raise RuntimeError("pre-tokens came back without their chunk; the input isn't read in one order")
        return pa.Table.from_batches(out)

    asked = spread(pairs.mapInArrow(words, PACKED), "bucket").sortWithinPartitions("bucket").mapInArrow(answers, PACKED)
    return spread(asked.union(pairs.mapInArrow(bodies, PACKED)), "chunk").groupBy("chunk").applyInArrow(joined, schema)


def table_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def table_of(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()
