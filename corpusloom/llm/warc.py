"""WARC archives: written by Spark's text sink, read back, segments put together again.

A record longer than a segment is written as one ``response`` with
WARC-Segment-Number 1 and ``continuation`` records that name their origin; the last
gives the total length.  Bodies are in HTTP chunked transfer framing.  Of records with
equal payloads of some size one is a response and the others are ``revisit`` records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_sized, remove, shared_folder, ship

ship(__name__)

MIN_DEDUP_BYTES = 1000
SEGMENT_CHARS = 16_384
CHUNK_CHARS = 4_096
RECORDS_PER_FILE = 2_000
#: Repeated keys and payloads are broadcast up to this number, which is counted first.
BROADCAST_ROWS = 500_000
CRLF = "\r\n"
HTTP = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked", "", ""])


def deduplicated(pages: DataFrame, key: str, url: str, html: str, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """``key, url, payload, digest, size, first``: first is the largest key with that payload, NULL for a response.

    Payloads below min_bytes have no first.  Only payloads that occur more than once are
    joined, so pages go through no shuffle while those are few; where they aren't, a
    payload that fills a third of all rows is dealt to several tasks.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).alias("key"), F.regexp_replace(F.col(url), "\\s", "%20").alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
    )
    large = rows.where(F.col("size") >= min_bytes)
    firsts = cut(large.groupBy("digest", "size").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = join_sized(rows, firsts, ["digest", "size"], BROADCAST_ROWS, "left")
    other = F.when(~F.col("first").eqNullSafe(F.col("key")), F.col("first"))
    return joined.select("key", "url", "payload", "digest", "size", other.alias("first"))


def _marked(rows: DataFrame, repeated: DataFrame, of: str, out: str) -> DataFrame:
    """Add ``out``: whether the key in column ``of`` is in ``repeated(key)``, distinct keys that are joined only if there are any."""
    if repeated.isEmpty():
        return rows.withColumn(out, F.lit(False))
    marks = repeated.select(F.col("key").alias(of), F.lit(True).alias(out))
    return join_sized(rows, marks, [of], BROADCAST_ROWS, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def _written(key: Column) -> Column:
    """A key as it can stand in a header line and between < and >."""
    return F.url_encode(key.cast("string"))


def chunked(body: Column) -> Column:
    """``body`` in chunked framing, CHUNK_CHARS characters a chunk."""
    n = F.ceil(F.char_length(body) / CHUNK_CHARS).cast("int")
    parts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def frame(i: Column) -> Column:
        part = F.substr(body, (i - 1) * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS))
        return F.concat(F.lower(F.hex(F.octet_length(part))), F.lit(CRLF), part, F.lit(CRLF))

    return F.concat(F.array_join(F.transform(parts, frame), ""), F.lit("0" + CRLF + CRLF))


def _record(kind: Column, block: Column, fields: list[tuple[str, Column]]) -> Column:
    """A record as text, without the two line ends that close it; a NULL field is left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", compression: str = "none") -> None:
    """Write ``pages`` to ``path`` as WARC files, a response or revisit for every row.

    Records go through Spark's own commit of task output: a lost or repeated task leaves
    no half file.  A record is named by its key, and rows with a NULL or repeated key by a
    UUID besides; the key itself is in WARC-Page-Key, which a NULL key lacks.  A revisit of
    a repeated key has WARC-Page-Refers-To and its digest, but no record's name.  Keys are
    percent-encoded there.  A NULL html is an empty payload; an empty table gives no record.
    """
    repeated = cut(pages.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("key is not null and n > 1").select("key"))
    rows = _marked(_marked(deduplicated(pages, key, url, html), repeated, "key", "many"), repeated, "first", "first_many")
    # The UUIDs come after the last shuffle: all segments of a row are written by the task that names it.
    rows = rows.withColumn("name", F.concat_ws(":", F.lit("urn:page"), _written(F.col("key")), F.when(F.col("key").isNull() | F.col("many"), F.uuid())))
    name = F.col("name")
    target = F.coalesce("url", name)
    page_key = ("WARC-Page-Key", _written(F.col("key")))
    identifier = F.concat(F.lit("<"), name, F.lit(">"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    revisit = rows.where("first is not null").select(_record(F.lit("revisit"), F.lit(""), [
        ("WARC-Record-ID", identifier), page_key, ("WARC-Target-URI", target), ("WARC-Payload-Digest", digest),
        ("WARC-Payload-Length", F.col("size").cast("string")),
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(~F.col("first_many"), F.concat(F.lit("<urn:page:"), _written(F.col("first")), F.lit(">")))),
        ("WARC-Page-Refers-To", _written(F.col("first"))),
    ]).alias("value"))
    blocks = rows.where("first is null").select("key", "name", "url", "digest", F.concat(F.lit(HTTP), chunked(F.col("payload"))).alias("block"))
    blocks = blocks.withColumn("n", F.greatest(F.ceil(F.char_length("block") / SEGMENT_CHARS).cast("int"), F.lit(1)))
    parts = blocks.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    part = F.substr(F.col("block"), (F.col("i") - 1) * SEGMENT_CHARS + 1, F.lit(SEGMENT_CHARS))
    parts = parts.select("key", "name", "url", "digest", "n", "i", part.alias("part"), F.octet_length("block").alias("total"))
    first, several = F.col("i") == 1, F.col("n") > 1
    response = parts.select(_record(F.when(first, F.lit("response")).otherwise(F.lit("continuation")), F.col("part"), [
        ("WARC-Record-ID", F.when(first, identifier).otherwise(F.concat(F.lit("<"), name, F.lit(":"), F.col("i").cast("string"), F.lit(">")))),
        page_key,
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", F.when(first, digest)),
        ("WARC-Segment-Number", F.when(several, F.col("i").cast("string"))),
        ("WARC-Segment-Origin-ID", F.when(several & ~first, identifier)),
        ("WARC-Segment-Total-Length", F.when(several & (F.col("i") == F.col("n")), F.col("total").cast("string"))),
    ]).alias("value"))
    revisit.union(response).write.mode("overwrite").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", compression).text(path)


RECORD = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_length", T.LongType()),
    T.StructField("refers_to", T.StringType()), T.StructField("segment_number", T.IntegerType()),
    T.StructField("origin_id", T.StringType()), T.StructField("total_length", T.LongType()),
    T.StructField("page_key", T.StringType()), T.StructField("page_refers_to", T.StringType()), T.StructField("block", T.BinaryType()),
])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under ``path`` (plain or gzip, whole files or by record).

    Each file is parsed by its records' Content-Length; a file that ends inside a
    record ends the job.
    """
    names = ["warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-payload-length", "warc-refers-to",
             "warc-segment-number", "warc-segment-origin-id", "warc-segment-total-length",
             "warc-page-key", "warc-page-refers-to"]

    def run(batches):
        out: list[list] = []
        size = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], [f.name for f in RECORD.fields])

        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                f = gzip.open(io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                while line := f.readline():
                    if not line.strip():
                        continue
                    if not line.startswith(b"WARC/"):
                        raise ValueError(f"no WARC record starts with {line[:40]!r}")
                    head = {}
                    while (line := f.readline()).strip():
                        name, _, value = line.decode().partition(":")
                        head[name.strip().lower()] = value.strip()
                    length = int(head["content-length"])
                    block = f.read(length)
                    if len(block) != length:
                        raise ValueError(f"record {head.get('warc-record-id')} is cut short")
                    row = [head.get(n) for n in names]
                    for i in (4, 6, 8):
                        row[i] = None if row[i] is None else int(row[i])
                    out.append([*row, block])
                    size += length
                    if size > 4 << 20:
                        yield flush()
                        out, size = [], 0
        if out:
            yield flush()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def unchunk(body: bytes) -> bytes:
    """The payload in a chunked body; trailers are skipped, a cut-off body raises."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(part)
        at = end + 4 + n


def checked_payload(declared: str | None, payload: bytes) -> bytes:
    """The payload, if its SHA-1 is the declared one, in hexadecimal or in base 32; other digests aren't checked."""
    kind, _, value = (declared or "").partition(":")
    if kind.lower() == "sha1":
        own = hashlib.sha1(payload)
        if value.lower() != own.hexdigest() and value.upper() != base64.b32encode(own.digest()).decode():
            raise ValueError(f"a payload of {len(payload)} bytes doesn't have its digest {declared}")
    return payload


def reassemble(records: DataFrame) -> DataFrame:
    """``record_type, record_id, target_uri, payload_digest, payload_length, refers_to, page_key, page_refers_to, payload``: one row per response or revisit.

    Segments are grouped by their origin's id and put in order; missing or repeated
    numbers, a total length that differs and a payload that doesn't have its declared
    digest end the job.  A group holds one page; its blocks are joined once, whatever their number.
    """
    whole = records.where("record_type in ('response', 'revisit') and segment_number is null")
    segments = records.where("segment_number is not null").select(
        F.coalesce("origin_id", "record_id").alias("origin"), "segment_number", "target_uri", "payload_digest", "total_length", "page_key", "block"
    )
    joined = segments.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment_number", "block"))).alias("parts"), F.sum(F.octet_length("block").cast("long")).alias("length"),
        F.max("target_uri").alias("target_uri"), F.max("payload_digest").alias("payload_digest"), F.max("total_length").alias("total_length"), F.max("page_key").alias("page_key"),
    )
    in_order = F.transform("parts", lambda p: p["segment_number"]) == F.sequence(F.lit(1), F.size("parts"))
    checked = joined.select(
        F.lit("response").alias("record_type"), F.col("origin").alias("record_id"), "target_uri", "payload_digest", F.lit(None).cast("long").alias("payload_length"),
        F.lit(None).cast("string").alias("refers_to"), "page_key", F.lit(None).cast("string").alias("page_refers_to"),
        F.when(in_order & (F.col("length") == F.col("total_length")), F.transform("parts", lambda p: p["block"]))
        .otherwise(F.raise_error(F.concat(F.lit("segments don't add up: "), F.coalesce("target_uri", "origin"))).cast("array<binary>")).alias("blocks"),
    )
    both = whole.select(*checked.columns[:8], F.array("block").alias("blocks")).union(checked)

    def run(batches):
        for batch in batches:
            payloads = []
            for kind, digest, blocks in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(8)):
                if kind == "revisit":
                    payloads.append(None)
                    continue
                head, _, body = b"".join(blocks.as_py()).partition(b"\r\n\r\n")
                payloads.append(checked_payload(digest, unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body))
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(payloads, pa.binary())], [*batch.schema.names[:8], "payload"])

    return both.mapInArrow(run, T.StructType([*both.schema.fields[:8], T.StructField("payload", T.BinaryType())]))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to a new folder of the shared folder, read it back and describe each record.

    ``key, payload_bytes, payload_digest, record_type, refers_to``, one row for every row of
    ``pages``: a NULL html has an empty payload, NULL and repeated keys and equal rows are
    records of their own, an empty table gives no rows, other columns aren't read.  The jobs
    run when it is called; the archives are removed once they have been read.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, key, url, html, compression="gzip")
    rows = reassemble(read_records(spark, path))
    kind = pages.schema[key].dataType
    out = cut(rows.select(
        F.url_decode("page_key").cast(kind).alias(key),
        F.when(F.col("record_type") == "revisit", F.col("payload_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.regexp_extract("payload_digest", "sha1:(.*)", 1)).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        F.url_decode("page_refers_to").cast(kind).alias("refers_to"),
    ))
    remove(spark, path)
    return out
