"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared in lower case, with each run of ASCII characters that are
neither letters nor digits as one space. An item of m bytes is found where a
part of a document is within k = m * ``EDITS`` edits of it. Such a part shares
at least m - q + 1 - k q q-grams with the item, on diagonals at most k apart;
so shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap by
half, bands below the bound are dropped without loss, and the rest are verified
by an alignment within the band. Short items use a smaller q, so that the bound
stays positive.

Items are a stated query set: Spark writes them in blocks of at most
``BLOCK_BYTES`` into the shared folder, and a task loads one block at a time, so
neither the driver nor a task holds more than one. The documents are read once:
with several blocks a task holds ``HELD_BYTES`` of text while it goes through
them. Documents are never shuffled and each is held by its own task only,
whatever its source or copies.

A null or empty document or item is never found; repeated items and documents
each have their rows; an empty table gives an empty table; further columns pass
through ``decontaminated``. A very long document is looked at in pieces: a task
needs about eight bytes for each of its bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import scratch, small_batches, table
from .sstable import made_folder, opened

EDITS = 0.1
MOST_Q = 8
BLOCK_BYTES = 2 << 20
#: Text that is searched at once, and text that a task holds while it goes through several blocks of items.
PIECE_BYTES, HELD_BYTES = 1 << 20, 32 << 20
#: Grams that are looked at at once; few, so that they stay in the cache.
GRAMS_AT_ONCE = 1 << 16
#: Shared q-grams that are looked at at once.
SHARED_AT_ONCE = 4_000_000
GAP = b"\xff" * MOST_Q
_SCATTER, _BITS = np.uint64(0x9E3779B97F4A7C15), 20

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def normalized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in their compared form, with a gap after each text, and where each text starts."""
    raw = pc.cast(pc.utf8_lower(pc.fill_null(texts, "")), pa.binary()).to_pylist()
    data = _PLAIN[np.frombuffer(GAP + GAP.join(raw) + GAP, np.uint8)]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + MOST_Q
    starts = MOST_Q + np.cumsum(sizes) - sizes
    space = data == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    before = np.add.reduceat(keep, np.append(0, starts), dtype=np.int64)  # kept bytes between one start and the next
    return data[keep], np.cumsum(before)[:-1]


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer."""
    n = len(data) - MOST_Q + 1
    out, raw = np.empty(max(n, 0), np.uint64), data.tobytes()
    for k in range(min(MOST_Q, len(out))):
        out[k::MOST_Q] = np.frombuffer(raw, "<u8", len(out[k::MOST_Q]), k)
    return out


def mask_of(q: int) -> np.uint64:
    return np.uint64((1 << 8 * q) - 1)


def aligned(item: np.ndarray, part: np.ndarray, k: int, width: int) -> int:
    """The fewest edits that turn ``item`` into a piece of ``part``, on the ``width`` diagonals from the start of ``part``."""
    room = np.full(len(item) + width, 0xFE, np.uint8)
    room[: min(len(part), len(room))] = part[: len(room)]
    place = np.arange(width)
    row = np.zeros(width, np.int64)
    for i in range(len(item)):
        new = row + (room[i : i + width] != item[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
        if row.min() > k:
            return k + 1
    return int(row.min())


@dataclass
class Items:
    """A block of items, ready to be searched for."""

    ids: list
    texts: list[str]

    @cached_property
    def bodies(self) -> list[np.ndarray]:
        data, starts = normalized(pa.array(self.texts, pa.string()))
        bodies = [data[a:b] for a, b in zip(starts, [*(starts[1:] - MOST_Q), len(data) - MOST_Q], strict=True)]
        return [np.frombuffer(bytes(x).strip(), np.uint8) for x in bodies]

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.bodies], np.int64)

    @cached_property
    def budgets(self) -> np.ndarray:
        return (self.lengths * EDITS).astype(np.int64)

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """q and the bound of each item."""
        m, k = self.lengths, self.budgets
        q = np.minimum(MOST_Q, np.maximum(1, m))
        for _ in range(MOST_Q):
            q = np.where((q > 1) & (m - q + 1 - k * q < np.maximum(1, m // 8)), q - 1, q)
        return q, np.maximum(1, m - q + 1 - k * q)

    @cached_property
    def index(self) -> dict[int, tuple[np.ndarray, ...]]:
        """For each q: the sorted codes, where their postings start and end, and the items and places posted."""
        found = {}
        for q in sorted(set(self.bounds[0].tolist())):
            codes, items, places = [], [], []
            for i in np.flatnonzero((self.bounds[0] == q) & (self.lengths > 0)).tolist():
                body = self.bodies[i]
                own = grams(np.concatenate([body, np.zeros(MOST_Q, np.uint8)]))[: len(body) - q + 1] & mask_of(q)
                codes.append(own)
                items.append(np.full(len(own), i, np.int32))
                places.append(np.arange(len(own), dtype=np.int32))
            if codes:
                code, item, place = map(np.concatenate, (codes, items, places))
                order = np.argsort(code, kind="stable")
                code, item, place = code[order], item[order], place[order]
                distinct, first = np.unique(code, return_index=True)
                found[q] = distinct, np.append(first, len(code)), item, place
        return found

    @cached_property
    def filter(self) -> tuple[np.uint64, np.ndarray]:
        """A mask for the least q, and a bit table of all codes under it."""
        mask, bits = mask_of(min(self.index, default=MOST_Q)), np.zeros(1 << _BITS, bool)
        for distinct, *_ in self.index.values():
            bits[((distinct & mask) * _SCATTER) >> np.uint64(64 - _BITS)] = True
        return mask, bits

    def candidates(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places whose gram may be one of an item, and these grams."""
        (mask, bits), at, codes = self.filter, [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for a in range(0, len(data) - MOST_Q + 1, GRAMS_AT_ONCE):
            own = grams(data[a : a + GRAMS_AT_ONCE + MOST_Q - 1])
            good = np.flatnonzero(bits[((own & mask) * _SCATTER) >> np.uint64(64 - _BITS)])
            at.append(good + a)
            codes.append(own[good])
        return np.concatenate(at), np.concatenate(codes)

    def counted(self, at: np.ndarray, hit: np.ndarray, q: int, starts: np.ndarray, low: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of (text, item, band) and their shared q-grams; in pieces, as a gram that repeats in an item and in a text is shared often."""
        _, first, item, place = self.index[q]
        per = first[hit + 1] - first[hit]
        ends, a, codes, counts = np.cumsum(per), 0, [], []
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SHARED_AT_ONCE, side="right")))
            n = per[a:b]
            posting = np.repeat(first[hit[a:b]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            places, items = np.repeat(at[a:b], n), item[posting]
            doc = np.searchsorted(starts, places, side="right") - 1
            band = (places - place[posting]) // (self.budgets[items] + 1)
            pair = (doc * len(self.ids) + items) * span + band - low  # documents of a batch, items of a block and bands: far below 2**63
            code, count = np.unique(np.concatenate([pair, pair - 1]), return_counts=True)
            codes.append(code)
            counts.append(count)
            a = b
        if len(codes) == 1:
            return codes[0], counts[0]
        code, back = np.unique(np.concatenate([np.empty(0, np.int64), *codes]), return_inverse=True)
        return code, np.bincount(back, weights=np.concatenate([np.empty(0, np.int64), *counts]), minlength=len(code)).astype(np.int64)

    def search(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(text, item, edits) for all items found in the texts."""
        data, starts = normalized(texts)
        out, (near, codes) = [], self.candidates(data)
        for q, (distinct, *_) in self.index.items():
            at, own = near, codes & mask_of(q)
            hit = np.searchsorted(distinct, own)
            hit[hit == len(distinct)] = 0
            true = distinct[hit] == own
            at, hit = at[true], hit[true]
            low = -int(self.lengths.max()) - 2
            span = len(data) - low + 1
            code, count = self.counted(at, hit, q, starts, low, span)
            rest, band = np.divmod(code, span)
            doc, items = np.divmod(rest, len(self.ids))
            key, begin = np.stack([doc, items, band + low]), np.arange(len(code))
            good = count >= self.bounds[1][key[1, begin]]
            begin, count = begin[good], count[good]
            begin = begin[np.lexsort((-count, key[1, begin], key[0, begin]))]  # the fullest band of a pair first
            done: dict[tuple[int, int], int] = {}
            for d, i, b in key[:, begin].T.tolist():
                k = int(self.budgets[i])
                if done.get((d, i), k + 1) == 0:
                    continue
                low = max(starts[d], b * (k + 1) - k)
                end = starts[d + 1] - MOST_Q if d + 1 < len(starts) else len(data) - MOST_Q
                part = data[low : min(end, b * (k + 1) + 2 * (k + 1) + len(self.bodies[i]) + k)]
                edits = 0 if self.bodies[i].tobytes() in part.tobytes() else aligned(self.bodies[i], part, k, 4 * k + 2)
                if edits <= k:
                    done[d, i] = min(edits, done.get((d, i), edits))
            out += [(d, i, e) for (d, i), e in done.items()]
        return out


def blocks_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[str]:
    """Writes the items in blocks of bounded size into the shared folder (a single longer item is a block of its own); returns the files."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    total = benchmark.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    n, folder = max(1, -(-2 * total // BLOCK_BYTES)), scratch(benchmark.sparkSession, "items")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            path = f"{made_folder(folder)}/{uuid.uuid4().hex}"
            with opened(path, write=True) as sink, pa.ipc.new_stream(sink, held[0].schema) as out:
                for x in held:
                    out.write_batch(x)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        now = None
        for batch in batches:
            block = batch["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and block[a] != now:
                    yield close()
                now = block[a]
                held.append(batch.slice(a, b - a).select(["item", "text"]))
        if held:
            yield close()

    marked = benchmark.where(size > 0).select(F.pmod(F.xxhash64(item_id, text), F.lit(n)).alias("block"), F.col(item_id).alias("item"), F.col(text).alias("text"))
    rows = marked.repartition(min(n, 1024), "block").sortWithinPartitions("block", "item", "text").mapInArrow(written, "path string")
    return sorted(r["path"] for r in rows.collect())  # names of files


@lru_cache(1)
def block_at(path: str) -> Items:
    with opened(path) as source, pa.ipc.open_stream(source) as stream:
        rows = stream.read_all()
    return Items(rows["item"].to_pylist(), rows["text"].to_pylist())


def searched(batches: Iterator[pa.RecordBatch], paths: list[str], text: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, object, int]]]]:
    """Batches, each with the (row, item, edits) found in it; every block of items is loaded once for ``HELD_BYTES`` of text."""
    held, size = [], 0

    def out() -> Iterator[tuple[pa.RecordBatch, list[tuple[int, object, int]]]]:
        found: list[list] = [[] for _ in held]
        for path in paths:
            items = block_at(path)
            for own, batch in zip(found, held, strict=True):
                own += [(d, items.ids[i], e) for d, i, e in items.search(batch[text])]
        yield from zip(held, found, strict=True)
        held.clear()

    for batch in small_batches(batches, text, PIECE_BYTES):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch[text])).as_py() or 0
        if len(paths) <= 1 or size >= HELD_BYTES:
            yield from out()
            size = 0
    yield from out()


def contaminated(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id`` and ``edits`` of every item found in a document."""
    kinds = f"{doc_id} {df.schema[doc_id].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, edits long"
    paths = blocks_of(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in searched(batches, paths, text):
            if found:
                ids = batch[doc_id].take(pa.array([d for d, _, _ in found]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i, _ in found]), pa.array([e for _, _, e in found], pa.int64())], names=[doc_id, "item_id", "edits"])

    return df.select(doc_id, text).mapInArrow(run, kinds)


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows in which no item is found, with the columns of the table."""
    paths = blocks_of(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in searched(batches, paths, text):
            bad = np.zeros(batch.num_rows, bool)
            bad[[d for d, _, _ in found]] = True
            yield batch.filter(pa.array(~bad))

    return df.mapInArrow(run, df.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
