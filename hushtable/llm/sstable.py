"""Sorted-string-table shards of token ids: prefix-compressed blocks, a sparse block index, a Bloom filter and a footer.

The table is dealt by range of the identifier (ties by a hash of the text), so
that shard after shard holds ascending keys and no hot key has to fit one task
beyond its equal rows. Each task encodes its rows and writes one file after
another up to a bounded size, under names of its own attempt; the manifest, a
table that Spark commits, names the files that count, so a lost executor leaves
no half-written shard in use.

Texts are encoded as the tokenizers library encodes them whole: strings of its
special tokens in a text become these tokens, unless ``special_as_text``.

A null identifier sorts first, a null text is empty, repeated identifiers each
have an entry, an empty table has no shard, and further columns are left out.
A very long text is one entry of a block of its own, held by its task alone.

File: blocks | index | Bloom filter | footer (last 64 bytes).
Entry: shared prefix length, rest length, value length (varints), rest, value.
Block: a Zstandard frame of entries; the first entry shares nothing.
Index: for each block its first key (17 bytes), offset and size (unsigned 64 bits).
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .byte_bpe import PieceEncoder, encode_pieces
from .common import flat_words, scratch, small_batches, table

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQQQQQQ8s")  # index offset and size, filter offset and size, entries, ids, bytes of an id
BLOCK_BYTES = 256 << 10
#: A shard is closed at this size, or with so many entries.
SHARD_BYTES, SHARD_ENTRIES = 256 << 20, 1 << 20
#: Shards of a task are numbered from its own number times this.
SHARDS_OF_TASK = 1 << 24
#: Writing tasks whose shards a lookup finds together.
TASKS_OF_GROUP = 64
BLOOM_BITS_PER_KEY, BLOOM_PROBES = 10, 7


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes that sort as identifiers do, null first."""
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    b |= 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    def __init__(self, sink, id_bytes: int):
        import zstandard

        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=1)
        self.id_bytes, self.block, self.held, self.last, self.at = id_bytes, [], 0, b"", 0
        self.index, self.keys, self.n_ids = [], [], 0

    def add(self, key: bytes, value: bytes) -> None:
        if not self.block:
            self.index.append((key, self.at))
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.held += len(entry) + len(value)
        self.last = key
        self.keys.append(key)
        self.n_ids += len(value) // self.id_bytes
        if self.held >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.at += self.sink.write(self.pack.compress(b"".join(self.block)))
            self.block, self.held = [], 0

    def close(self) -> None:
        self.flush()
        ends = [*(o for _, o in self.index), self.at][1:]
        index = b"".join(k + struct.pack("<QQ", o, e - o) for (k, o), e in zip(self.index, ends, strict=True))
        bits = max(64, len(self.keys) * BLOOM_BITS_PER_KEY)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        tail = struct.pack("<Q", bits) + bytes(bloom)
        self.sink.write(index + tail + FOOTER.pack(self.at, len(index), self.at + len(index), len(tail), len(self.keys), self.n_ids, self.id_bytes, MAGIC))


class Shard:
    """Reads a shard: ``get`` by filter, binary search in the index and a scan of one block; ``entries`` all in order."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        *numbers, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        index_at, index_size, bloom_at, bloom_size, self.n_entries, self.n_ids, self.id_bytes = numbers
        raw = self.read(index_at, index_size)
        self.index = [(raw[a : a + 9], *struct.unpack("<QQ", raw[a + 9 : a + 25])) for a in range(0, len(raw), 25)]
        bloom = self.read(bloom_at, bloom_size)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        raw, at, key = self.unpack.decompress(self.read(*self.index[k][1:])), 0, b""
        kind = f"<u{self.id_bytes}"
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, kind, size // self.id_bytes, at)
            at += size

    def entries(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all entries with this key."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, self.bits)):
            return []
        low, high = 0, len(self.index)
        while low < high:  # the first block whose first key is not below the key
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found = []
        for k in range(max(0, low - 1), len(self.index)):
            if self.index[k][0] > key:
                break
            found += [ids for x, ids in self.block(k) if x == key]
        return found


@functools.cache
def word_encoder(vocabulary: str) -> PieceEncoder:
    """One for each worker, as it remembers words from task to task."""
    from tokenizers import Tokenizer

    return PieceEncoder(Tokenizer.from_file(vocabulary))


@functools.cache
def special_strings(vocabulary: str) -> list[str]:
    """The special tokens' strings."""
    return [t.content for t in word_encoder(vocabulary).tokenizer.get_added_tokens_decoder().values() if t.special]


def encode_words(vocabulary: str, text: pa.Array, special_as_text: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the number of ids of each.

    Words are encoded apart, as the tokenizer lowers letters and drops white space itself. A text with a
    special token's string is encoded whole, as the library looks for these before it lowers anything.
    """
    encoder = word_encoder(vocabulary)
    encoder.tokenizer.encode_special_tokens = True
    text = pc.fill_null(text, "")
    whole = np.zeros(len(text), bool)
    for special in () if special_as_text else special_strings(vocabulary):
        whole |= pc.match_substring(text, special).to_numpy(zero_copy_only=False)
    words, counts = flat_words(pc.if_else(pa.array(whole), "", text) if whole.any() else text, lower=True)
    ids, sizes = encode_pieces(encoder, words, np.repeat(np.arange(len(counts)), counts), len(counts))
    if not whole.any():
        return ids, sizes
    encoder.tokenizer.encode_special_tokens = False
    found = [np.array(encoder.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) for x in text.filter(pa.array(whole)).to_pylist()]
    ends, parts, given = np.cumsum(sizes), [], iter(found)
    for k, own in enumerate(whole.tolist()):
        parts.append(next(given) if own else ids[ends[k] - sizes[k] : ends[k]])
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def uri(path: str) -> str:
    """The URI by which pyarrow knows a store that Hadoop names otherwise."""
    return re.sub(r"^s3[an]://", "s3://", path)


def opened(path: str, write: bool = False):
    """A file in any store that pyarrow knows, by its URI."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri(path))
    return store.open_output_stream(at, compression=None) if write else store.open_input_file(at)


def made_folder(path: str) -> str:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri(path))
    store.create_dir(at, recursive=True)
    return path


MANIFEST = "shard long, path string, low binary, high binary, n_entries long, n_ids long"


def write_shards(df: DataFrame, folder: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", special_as_text: bool = False) -> DataFrame:
    """Encodes and writes all texts; returns the manifest, one row for each shard, numbered in the order of keys."""
    kinds = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("low", pa.binary()), ("high", pa.binary()), ("n_entries", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, sink, path = None, None, ""
        width = 2 if max(word_encoder(vocabulary).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        shard = TaskContext.get().partitionId() * SHARDS_OF_TASK

        def finish() -> pa.RecordBatch:
            writer.close()
            sink.close()
            row = {"shard": shard, "path": path, "low": writer.keys[0], "high": writer.keys[-1], "n_entries": len(writer.keys), "n_ids": writer.n_ids}
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        for batch in small_batches(batches, text):
            ids, sizes = encode_words(vocabulary, batch[text], special_as_text)
            ids, ends = ids.astype(f"<u{width}"), np.cumsum(sizes)
            end = np.array([end_id], ids.dtype).tobytes()
            for key, a, b in zip(batch[doc_id].to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                if writer is None:
                    path = f"{made_folder(folder)}/{shard:012d}-{uuid.uuid4().hex}.sst"
                    sink = opened(path, write=True)
                    writer = ShardWriter(sink, width)
                writer.add(key_of(key), ids[a:b].tobytes() + end)
                if writer.at >= SHARD_BYTES or len(writer.keys) >= SHARD_ENTRIES:
                    yield finish()
                    writer, shard = None, shard + 1
        if writer is not None:
            yield finish()

    tie = F.xxhash64(text)
    dealt = df.select(F.col(doc_id).cast("long").alias(doc_id), text).repartitionByRange(doc_id, tie).sortWithinPartitions(F.asc_nulls_first(doc_id), tie, text)
    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """All entries: ``doc_id``, ``start`` (ids in all entries before it), ``n_tokens``, ``ids`` (unsigned 32-bit little-endian).

    The starts of the shards are a running sum over the manifest, one small row for each shard.
    """
    first = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    tasks = max(1, manifest.count())
    own = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["first"].to_pylist(), strict=True):
                with opened(path) as source:
                    rows, held = [], 0
                    for doc_id, ids in Shard(source).entries():
                        raw = ids.astype("<u4").tobytes()
                        rows.append((doc_id, start, len(ids), zlib.crc32(raw), raw))
                        start += len(ids)
                        held += len(raw)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), own, strict=True)], schema=own)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), own, strict=True)], schema=own)

    return first.repartitionByRange(tasks, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def lookup(manifest: DataFrame, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The entries of some identifiers, each asked of the shards whose key range holds it.

    Only the key ranges of groups of ``TASKS_OF_GROUP`` writing tasks go with the tasks that find the groups of
    the wanted rows; a join by group finds the shards, so neither rows nor paths pass through the driver.
    """
    group = F.expr(f"shard div {SHARDS_OF_TASK * TASKS_OF_GROUP}").alias("group")
    ranges = manifest.groupBy(group).agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("group").collect()
    numbers, lows, highs = [r["group"] for r in ranges], [bytes(r["low"]) for r in ranges], [bytes(r["high"]) for r in ranges]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(k, key_of(k)) for k in batch[doc_id].to_pylist()]
            rows = [(numbers[n], key, k) for k, key in keys for n in range(bisect_left(highs, key), bisect_right(lows, key))]  # both lists ascend
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["group", "key", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, own in batch.to_pandas().groupby("path")["doc_id"]:
                with opened(path) as source:
                    shard = Shard(source)
                    rows = [(k, ids.astype("<u4").tobytes()) for k in own.tolist() for ids in shard.get(k)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["doc_id", "ids"])

    asked = wanted.select(F.col(doc_id).cast("long").alias(doc_id)).where(F.col(doc_id).isNotNull()).distinct()
    found = asked.mapInArrow(assign, "group long, key binary, doc_id long").join(manifest.select(group, "path", "low", "high"), "group").where("key >= low and key <= high")
    return found.select("path", "doc_id").repartition("path", F.pmod("doc_id", F.lit(16))).sortWithinPartitions("path").mapInArrow(run, "doc_id long, ids binary")


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_shards(table(spark, sf_dir, "documents"), scratch(spark, "sst"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
