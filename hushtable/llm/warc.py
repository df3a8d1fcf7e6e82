"""WARC archives, compressed by record with a Zstandard dictionary that a leading skippable frame holds.

A payload that several records share is stored once: in the record with the
largest identifier; the others are revisits that refer to it. The digests of
shared payloads come from a count by digest, which Spark combines before it
shuffles, so a payload in a third of all records makes no hot task.

A task fills one archive after another up to a bounded size, builds the
dictionary from all its records, and writes under a name of its own attempt;
the index that Spark commits names the archives that count. Small partitions
are read by one task, so that an archive has records enough to learn from;
where they are too few for the trainer, the dictionary is the records' own
starts.

Null payloads are empty, null identifiers are kept (and are the smallest),
a null URL leaves the header out, rows with the same identifier and payload
are all written alike, an empty table gives no archive, and further columns
are left out, whatever their names. A very long payload is a record of an
archive of its own, held by its task alone.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh, kept_table, scratch, small_batches, table
from .sstable import made_folder, opened

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES, LEAST_BYTES = 64 << 10, 256
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, size long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    value = (record or "none").strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """One record; a revisit has the HTTP header with the length of the payload, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of a record; those of a response are taken from the payload itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response" and (size != len(payload) or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": page_of(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


def built_dictionary(records: list[bytes]):
    """A dictionary built from all the records: trained on them, or of their starts where they are too few for the trainer."""
    import zstandard

    size = min(DICTIONARY_BYTES, max(LEAST_BYTES, sum(map(len, records)) // 8))
    with contextlib.suppress(zstandard.ZstdError):
        return zstandard.train_dictionary(size, records, k=1024, d=8, f=18, accel=1)
    each = max(64, size // len(records))
    return zstandard.ZstdCompressionDict(b"".join(x[:each] for x in records)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes of an archive, and the offset and size of each record's frame."""
    import zstandard

    if not records:
        return b"", []
    dictionary = built_dictionary(records)
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary)
    raw = dictionary.as_bytes()
    head = struct.pack("<II", SKIPPABLE, len(raw)) + raw
    parts, places, at = [head], [], len(head)
    for raw in records:
        parts.append(packer.compress(raw))
        places.append((at, len(parts[-1])))
        at += len(parts[-1])
    return b"".join(parts), places


def frame_size(raw: memoryview) -> int:
    """The size of the Zstandard frame at the start of ``raw``, by its block headers."""
    import zstandard

    at = zstandard.frame_header_size(raw[:18])
    while True:
        head = raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * zstandard.get_frame_parameters(raw[:18]).has_checksum


def records_of(raw: bytes) -> Iterator[bytes]:
    """All records of an archive, one after another; needs no index."""
    import zstandard

    view, at, dictionary = memoryview(raw), 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", raw, 4)[0]
        dictionary, at = zstandard.ZstdCompressionDict(raw[8 : 8 + size]), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(raw):
        size = frame_size(view[at:])
        yield reader.decompress(view[at : at + size])
        at += size


def with_responses(df: DataFrame, page_id: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Adds ``revisit`` and ``refers_to``, in place of columns of these names. Only digests that occur twice or more go into the join."""
    df = df.drop("revisit", "refers_to")
    digest, size, response, d, n = fresh(df, "digest", "size", "response", "d", "n")
    whole = F.coalesce(F.col(payload), F.lit(""))
    rows = df.withColumn(digest, F.sha1(whole)).withColumn(size, F.octet_length(whole))
    counts = rows.where(F.col(size) >= least_bytes).groupBy(F.col(digest).alias(d), F.col(size).alias(n)).agg(F.max(page_id).alias(response), F.count("*").alias("copies"))
    shared = kept_table(counts.where("copies > 1").drop("copies"), "warc-shared")
    joined = rows.join(shared, (F.col(digest) == F.col(d)) & (F.col(size) == F.col(n)), "left")
    revisit = F.col(response).isNotNull() & ~F.col(page_id).eqNullSafe(F.col(response))
    return joined.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col(response))).drop(digest, size, response, d, n)


def write_archives(df: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes all rows; returns the index: archive, offset and size of every record."""

    def flush(folder: str, records: list[bytes]) -> pa.RecordBatch:
        path = f"{made_folder(folder)}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        raw, places = archive(records)
        with opened(path, write=True) as sink:
            sink.write(raw)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(places)), pa.array([a for a, _ in places], pa.int64()), pa.array([n for _, n in places], pa.int64())], names=["archive", "offset", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, held = [], 0
        for batch in small_batches(batches, payload, 2 << 20):
            for row in batch.to_pylist():
                raw = (row[payload] or "").encode()
                records.append(record(row[page_id], row[url], raw, row["refers_to"], row["revisit"], base32(hashlib.sha1(raw).digest())))
                held += len(records[-1])
                if held >= ARCHIVE_BYTES:
                    yield flush(folder, records)
                    records, held = [], 0
        if records:
            yield flush(folder, records)

    rows = df.select(F.col(page_id).cast("long").alias(page_id), url, payload, "revisit", "refers_to")
    total = df.agg(F.sum(F.octet_length(payload)).alias("n")).first()["n"] or 0
    rows = rows.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // ARCHIVE_BYTES)))  # never more than there are
    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return df.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_archives(index: DataFrame, payload: bool = False) -> DataFrame:
    """All records of the archives in the index, read frame by frame from the files."""
    names = [*(c.split()[0] for c in RECORD.split(", ")), *(["payload"] if payload else [])]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payload else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["archive"].to_pylist():
                with opened(path) as source:
                    raw = source.read()
                rows, held = [], 0
                for data in records_of(raw):
                    rows.append({k: v for k, v in parsed(data).items() if k in names})
                    held += len(data) * payload + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    archives = index.select("archive").distinct()
    return archives.repartitionByRange(max(1, archives.count()), "archive").mapInArrow(run, RECORD + (", payload binary" if payload else ""))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_responses(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    index = write_archives(rows, scratch(spark, "warc"))
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
