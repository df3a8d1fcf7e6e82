"""Substring dedup by a log-structured index of window fingerprints.

A window is 20 consecutive words. Its fingerprint is the least hash of its
5-word grams, so equal windows have equal fingerprints, and neighbouring
windows mostly share theirs: the windows of a document become about a ninth as
many rows, each with the hashes of its windows. Windows are equal where the
fingerprint and ``HASH_BYTES`` bytes of the window's own hash are (104 bits in
all); words are told apart by 64-bit hashes.

The index holds immutable runs, one for each batch of documents: files sorted
by fingerprint, one for each range of fingerprints, with the hashes of the
windows that the batch has first. A new batch is dealt to these ranges and
sorted; the task of a range opens the runs' files of that range and merges them
with its rows, so history is neither shuffled nor sorted again, and no older
text is read. The batch is verified window by window, the later of equal windows
are told, and the new windows become the new run. With more than ``MOST_RUNS``
runs, each range's files are merged into one by a task of their own. Which files
count is a table that Spark commits.

Windows that were earlier in their own Arrow batch are settled before the
shuffle. A fingerprint with more rows than ``GROUP_ROWS`` isn't held by a task:
its windows, also those of the runs, go on one by one, are dealt by their own
hash and pre-aggregated, and none is left out.

Documents must come in batches of ascending identifiers. A null text has no
words. A null identifier counts as the smallest. Rows with the same
identifier are judged as one document each: equal places of equal texts are
not earlier than each other, and what is removed is removed from all of them.
An empty table gives an empty table; further columns pass through ``cleaned``.
A very long text is looked at by its task alone, which needs about a hundred
bytes for each of its words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import BASES, few_rows, flat_words, fresh, give_back, kept_table, mixed, scratch, small_batches, table, windows, word_ids
from .sstable import made_folder, opened

WINDOW, GRAM = 20, 5
GROUP_ROWS, MERGED_ROWS = 200_000, 20_000
#: Batches of a whole table, and runs that an index has at most.
BATCHES, MOST_RUNS = 6, 4
#: Bytes of text for each range of fingerprints, and the bounds of their number (powers of two).
RANGE_BYTES, FEWEST_RANGES, MOST_RANGES = 32 << 20, 8, 1 << 17
#: What is removed is broadcast up to this size; Spark joins more by a shuffle.
BROADCAST_BYTES = 32 << 20
HASH_BYTES = 5
#: Windows of a row.
LONGEST = WINDOW - GRAM + 1
NO_ID = -(1 << 63)
ROWS = "fp long, doc_id long, pos int, hashes binary, n int"
PIECE_BYTES = 2 << 20


def grams_of(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """For all windows: fingerprint, document, place, hash."""
    h, of, at = windows(ids, counts, WINDOW, BASES[1])
    if not len(h):
        return h, of, at, h
    n = len(ids) - GRAM + 1
    least = np.zeros(n, np.uint64)
    for i in range(GRAM):
        least = least * BASES[0] + ids[i : n + i]
    least = mixed(least)
    span, grams = 1, WINDOW - GRAM + 1
    while span < grams:  # the least of ever wider spans
        step = min(span, grams - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return mixed(least[(np.cumsum(counts) - counts)[of] + at]), of, at, h  # mixed again, as the least hashes are mostly small ones


def packed_hashes(h: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of window hashes, cut to ``HASH_BYTES``, as a binary array."""
    raw = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * HASH_BYTES
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def unpacked_hashes(hashes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes, one after another, and the number of each row."""
    sizes = pc.binary_length(hashes).to_numpy(zero_copy_only=False).astype(np.int64) // HASH_BYTES
    raw = np.frombuffer(b"".join(hashes.to_pylist()), np.uint8).reshape(-1, HASH_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :HASH_BYTES] = raw
    return wide.reshape(-1).view(np.int64), sizes


def window_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``fp``, ``doc_id``, ``pos`` and ``hashes`` of each run of windows with one fingerprint.

    Windows that start earlier in the same Arrow batch need no look-up: they are told apart here, as
    runs of ``n`` windows with no hashes and a fingerprint of their own, and only the first goes on. So
    copies, and passages that very many documents share, are mostly settled before the shuffle.
    """

    def rows(fp: np.ndarray, doc: np.ndarray, pos: np.ndarray, h: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Neighbouring places of one document and fingerprint become a row."""
        if not len(fp):
            return
        new = np.ones(len(fp), bool)
        new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
        first = np.flatnonzero(new)
        if h is not None:
            new |= (np.arange(len(fp)) - first[np.cumsum(new) - 1]) % LONGEST == 0
            first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(fp)))
        if h is None:
            hashes = pa.array([b""]).take(pa.array(np.zeros(len(first), np.int64)))
            key = mixed(doc[first].view(np.uint64) * BASES[0] + pos[first].astype(np.uint64))
        else:
            hashes, key = packed_hashes(h, sizes), fp[first]
        columns = [pa.array(key.view(np.int64)), pa.array(doc[first]), pa.array(pos[first].astype(np.int32)), hashes, pa.array(sizes.astype(np.int32))]
        for a in range(0, len(first), 100_000):
            yield pa.RecordBatch.from_arrays([c.slice(a, 100_000) for c in columns], names=["fp", "doc_id", "pos", "hashes", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, PIECE_BYTES):
            batch = batch.take(pc.array_sort_indices(pc.fill_null(batch[doc_id].cast(pa.int64()), NO_ID)))
            words, counts = flat_words(batch[text])
            fp, of, pos, h = grams_of(word_ids(words), counts)
            doc = pc.fill_null(batch[doc_id].cast(pa.int64()), NO_ID).to_numpy()[of]
            order = np.argsort(h, kind="stable")  # equal windows stay in the order of their places
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (fp[order][1:] != fp[order][:-1])
            first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else order
            again = np.zeros(len(h), bool)
            again[order] = (doc[order] != doc[first]) | (pos[order] != pos[first])
            yield from rows(fp[~again], doc[~again], pos[~again], h[~again])
            yield from rows(np.zeros(int(again.sum()), np.uint64), doc[again], pos[again], None)

    return df.select(doc_id, text).mapInArrow(run, ROWS)


class RunFile:
    """Streams a run's file: Arrow batches of ``fp`` and ``hashes``, ascending."""

    def __init__(self, path: str):
        self.source = opened(path)
        self.batches = iter(pa.ipc.open_stream(self.source))
        self.fp, self.hashes = np.empty(0, np.int64), pa.array([], pa.binary())

    def more(self) -> bool:
        """Takes up the next batch when the last one is used up; False at the end."""
        if len(self.fp):
            return True
        batch = next(self.batches, None)
        if batch is None:
            self.source.close()
            return False
        self.fp, self.hashes = batch["fp"].to_numpy(), batch["hashes"]
        return True

    def until(self, fp: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and hash of all windows up to this fingerprint that were not given yet; of the ``wanted`` fingerprints, if these are named. Others are dropped batch by batch."""
        fps, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while self.more() and self.fp[0] <= fp:
            k = int(np.searchsorted(self.fp, fp, side="right"))
            own, part = self.fp[:k], self.hashes[:k]
            if wanted is not None:
                good = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
                own, part = own[good], part.filter(pa.array(good))
            h, sizes = unpacked_hashes(part)
            fps.append(np.repeat(own, sizes))
            hashes.append(h)
            self.fp, self.hashes = self.fp[k:], self.hashes[k:]
        return np.concatenate(fps), np.concatenate(hashes)


class RunWriter:
    """Writes a run's file under a name of its own attempt."""

    def __init__(self, folder: str):
        self.path = f"{made_folder(folder)}/{uuid.uuid4().hex}"
        self.sink = opened(self.path, write=True)
        self.out = pa.ipc.new_stream(self.sink, pa.schema([("fp", pa.int64()), ("hashes", pa.binary())]))

    def add(self, fp: np.ndarray, h: np.ndarray) -> None:
        """Windows in the order of fingerprints, which follow those written so far."""
        for a in range(0, len(fp), 1 << 16):
            part = fp[a : a + (1 << 16)]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sizes = np.diff(np.append(first, len(part)))
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.array(part[first]), packed_hashes(h[a : a + (1 << 16)], sizes)], names=["fp", "hashes"]))

    def close(self) -> str:
        self.out.close()
        self.sink.close()
        return self.path


FOUND = pa.schema([("kind", pa.int32()), ("fp", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("hash", pa.int64()), ("own", pa.bool_()), ("path", pa.string())])
FOUND_SQL = "kind int, fp long, doc_id long, pos int, n int, hash long, own boolean, path string"
FILE, REMOVED, OPEN = range(3)


def _batch(kind: int, doc: np.ndarray, pos: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    columns = {"kind": np.full(len(doc), kind, np.int32), "doc_id": doc, "pos": pos} | more
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(doc), f.type) for f in FOUND], schema=FOUND)


def _removed(doc: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Removed windows as runs of neighbouring places."""
    if not len(doc):
        return
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    yield _batch(REMOVED, doc[first], pos[first], n=pos[last] - pos[first] + 1)


def known(fp: np.ndarray, h: np.ndarray, old_fp: np.ndarray, old_h: np.ndarray) -> np.ndarray:
    """Which windows are among the old ones."""
    found = np.zeros(len(fp), bool)
    shared = np.isin(fp, old_fp)
    if shared.any():
        both, n_old = (np.concatenate([old_fp, fp[shared]]), np.concatenate([old_h, h[shared]])), len(old_fp)
        order = np.lexsort((np.arange(len(both[0])) >= n_old, both[1], both[0]))  # old windows first
        f, x = both[0][order], both[1][order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (x[1:] != x[:-1])
        told = np.zeros(len(f), bool)
        told[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] < n_old
        found[shared] = told[n_old:]
    return found


class Merge:
    """Merges the rows of a range, in the order of fingerprints, with the runs' files of that range."""

    def __init__(self, folder: str):
        self.folder, self.files, self.writer = folder, [], None

    def history(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of these fingerprints (ascending) in the runs."""
        parts = [f.until(int(wanted[-1]), wanted) for f in self.files]
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    def write(self, fp: np.ndarray, h: np.ndarray) -> None:
        if len(fp):
            self.writer = self.writer or RunWriter(self.folder)
            self.writer.add(fp, h)

    def exploded(self, group: pa.Table) -> tuple[np.ndarray, ...]:
        """Fingerprint, hash, document and place of every window."""
        h, sizes = unpacked_hashes(group["hashes"].combine_chunks())
        of = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        column = lambda c: group[c].to_numpy()[of]
        return column("fp"), h, column("doc_id"), column("pos") + inside

    def settle(self, group: pa.Table) -> Iterator[pa.RecordBatch]:
        """Tells the later of equal windows of whole fingerprints, and keeps the new ones."""
        if not group.num_rows:
            return
        fp, h, doc, pos = self.exploded(group)
        old_fp, old_h = self.history(np.unique(fp))
        old = known(fp, h, old_fp, old_h)
        order = np.lexsort((pos, doc, h, fp))
        f, x, d, p, o = fp[order], h[order], doc[order], pos[order], old[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (x[1:] != x[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = o | (d != d[first]) | (p != p[first])
        yield from _removed(d[again], p[again])
        self.write(f[new & ~o], x[new & ~o])

    def opened_up(self, group: pa.Table) -> Iterator[pa.RecordBatch]:
        """The windows of one very frequent fingerprint, and the first time those of the runs, for a look-up by window."""
        fp, h, doc, pos = self.exploded(group)
        old_fp, old_h = self.history(fp[-1:])
        for a in range(0, len(old_h), MERGED_ROWS):
            part = old_h[a : a + MERGED_ROWS]
            yield _batch(OPEN, np.full(len(part), NO_ID), np.full(len(part), -1), fp=old_fp[a : a + MERGED_ROWS], hash=part, own=np.zeros(len(part), bool))
        for a in range(0, len(fp), MERGED_ROWS):
            b = a + MERGED_ROWS
            yield _batch(OPEN, doc[a:b], pos[a:b], fp=fp[a:b], hash=h[a:b], own=np.ones(len(fp[a:b]), bool))

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        frequent = None
        for batch in few_rows(batches, MERGED_ROWS):
            rows = pa.Table.from_batches([batch])
            is_path = pc.equal(rows["n"], -1)
            if pc.any(is_path).as_py():
                self.files += [RunFile(x.decode()) for x in rows.filter(is_path)["hashes"].to_pylist()]
                rows = rows.filter(pc.invert(is_path))
            told = pc.equal(pc.binary_length(rows["hashes"]), 0)
            if pc.any(told).as_py():
                early = rows.filter(told)
                yield _batch(REMOVED, early["doc_id"].to_numpy(), early["pos"].to_numpy(), n=early["n"].to_numpy())
                rows = rows.filter(pc.invert(told))
            if not rows.num_rows:
                continue
            held = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows.combine_chunks()
            fp = held["fp"].to_numpy()
            if frequent is not None:
                to = int(np.searchsorted(fp, frequent, side="right"))
                if to:
                    yield from self.opened_up(held.slice(0, to))
                held, fp = held.slice(to), fp[to:]
                if not len(fp):
                    held = None
                    continue
                frequent = None
            last = int(np.searchsorted(fp, fp[-1]))
            yield from self.settle(held.slice(0, last))
            held = held.slice(last)
            if held.num_rows > GROUP_ROWS:
                frequent = int(fp[-1])
                yield from self.opened_up(held)
                held = None
        if held is not None:
            yield from self.settle(held)
        if self.writer:
            yield pa.RecordBatch.from_pylist([{"kind": FILE, "path": self.writer.close()}], schema=FOUND)


class WindowIndex:
    """The runs of one index, in a folder that all executors share; ``ranges`` is a power of two."""

    def __init__(self, spark: SparkSession, folder: str, ranges: int = FEWEST_RANGES):
        self.spark, self.folder, self.bits, self.number = spark, folder, ranges.bit_length() - 1, 0
        self.runs: list[DataFrame] = []

    @property
    def ranges(self) -> int:
        return 1 << self.bits

    def range_of(self, fp: str = "fp") -> F.Column:
        return (F.shiftright(F.col(fp), 64 - self.bits) + (self.ranges >> 1)).cast("int")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows by range, in order; before them the paths of the runs' files of the range."""
        low = F.shiftleft(F.col("range").cast("long") - (self.ranges >> 1), 64 - self.bits)
        for run in self.runs:
            rows = rows.union(run.select(low.alias("fp"), F.lit(NO_ID).alias("doc_id"), F.lit(-1).alias("pos"), F.encode("path", "UTF-8").alias("hashes"), F.lit(-1).alias("n")))
        return rows.repartitionById(self.ranges, self.range_of()).sortWithinPartitions("fp", "n")

    def add(self, batch: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Takes up a batch, whose documents come after all before. Returns ``doc_id`` and ``spans``: start (upper half) and number (lower half) of removed windows."""
        self.number += 1
        folder = f"{self.folder}/run-{self.number}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            for out in Merge(folder).run(batches):
                if out["kind"][0].as_py() == FILE:
                    out = out.set_column(FOUND.get_field_index("n"), FOUND.field("n"), pa.array([TaskContext.get().partitionId()], pa.int32()))
                yield out

        found = kept_table(self.dealt(window_rows(batch, doc_id, text)).mapInArrow(run, FOUND_SQL), "window-merge")
        removed, run_files = found.where(F.col("kind") == REMOVED).select("doc_id", "pos", "n"), found.where(F.col("kind") == FILE).select(F.col("n").alias("range"), "path")
        opened_windows = found.where(F.col("kind") == OPEN).select("fp", "hash", "doc_id", "pos", "own")
        if not opened_windows.isEmpty():
            first = kept_table(opened_windows.groupBy("fp", "hash").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.bool_and("own").alias("new")), "window-firsts")
            later = opened_windows.where("own").join(first, ["fp", "hash"]).where(F.struct("doc_id", "pos") > F.col("first"))
            removed = removed.union(later.select("doc_id", "pos", F.lit(1).alias("n")))
            run_files = kept_table(run_files.union(self.written(first.where("new").select("fp", "hash"), folder)), "window-run")
        self.runs.append(run_files)
        if len(self.runs) > MOST_RUNS:
            self.compact()
        span = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("n")
        return removed.groupBy("doc_id").agg(F.sort_array(F.collect_set(span)).alias("spans"))

    def written(self, windows_of: DataFrame, folder: str) -> DataFrame:
        """Writes windows, in order, into a further file of each range."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            writer = None
            for batch in batches:
                if batch.num_rows:
                    writer = writer or RunWriter(folder)
                    writer.add(batch["fp"].to_numpy(), batch["hash"].to_numpy())
            if writer:
                yield pa.RecordBatch.from_pydict({"range": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [writer.close()]})

        return windows_of.repartitionById(self.ranges, self.range_of()).sortWithinPartitions("fp", "hash").mapInArrow(run, "range int, path string")

    def compact(self) -> None:
        """Merges the runs' files of each range into one."""
        self.number += 1
        folder = f"{self.folder}/run-{self.number}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, paths in zip(batch["range"].to_pylist(), batch["paths"].to_pylist(), strict=True):
                    yield pa.RecordBatch.from_pydict({"range": pa.array([number], pa.int32()), "path": [merged_file(paths, folder)]})
            give_back()

        listed = reduce(DataFrame.union, self.runs).groupBy("range").agg(F.collect_list("path").alias("paths"))
        self.runs = [kept_table(listed.repartitionById(self.ranges, "range").mapInArrow(run, "range int, path string"), "window-run")]

    def windows(self) -> DataFrame:
        """``fp`` and ``hash`` of all windows in the index."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch["path"].to_pylist():
                    fp, h = RunFile(path).until((1 << 63) - 1)
                    yield pa.RecordBatch.from_pydict({"fp": fp, "hash": h})

        return reduce(DataFrame.union, self.runs).mapInArrow(run, "fp long, hash long")


def merged_file(paths: list[str], folder: str) -> str:
    """One file of the windows of several, read side by side; equal windows, which only one run has, stay apart."""
    files, writer = [RunFile(p) for p in paths], RunWriter(folder)
    live = [f for f in files if f.more()]
    while live:
        edge = min(int(f.fp[-1]) for f in live)  # all up to here has been read from every file
        fp, h = map(np.concatenate, zip(*(f.until(edge) for f in live), strict=True))
        order = np.argsort(fp, kind="stable")
        writer.add(fp[order], h[order])
        live = [f for f in live if len(f.fp) or f.more()]
    return writer.close()


def applied(df: DataFrame, removed: DataFrame, doc_id: str = "doc_id", text: str = "text", names: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """The table with ``text`` made of the kept words, and two counts, which take the place of columns of these names."""
    df = df.drop(*names)
    of, spans = fresh(df, "_of", "_spans")
    removed = kept_table(removed.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias(of), F.col("spans").alias(spans)), "removed")
    size = removed.agg(F.coalesce(F.sum(48 + 8 * F.size(spans)), F.lit(0)).alias("n")).first()["n"]
    small = F.broadcast(removed) if size <= BROADCAST_BYTES else removed
    joined = df.join(small, df[doc_id].eqNullSafe(F.col(of)), "left").drop(of)
    own = T.StructType([*(f if f.name != text else T.StructField(text, T.StringType()) for f in df.schema.fields), *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, PIECE_BYTES):
            words, counts = flat_words(batch[text])
            first = np.cumsum(counts) - counts
            per = pc.fill_null(pc.list_value_length(batch[spans]), 0).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(batch[spans]).to_numpy(zero_copy_only=False).astype(np.int64)
            change = np.zeros(len(words) + 1, np.int64)
            start = np.repeat(first, per) + (flat >> 32)
            # rows that share an identifier may be shorter than the one a span comes from
            end = np.repeat(first + counts, per)
            np.add.at(change, np.minimum(start, end), 1)
            np.add.at(change, np.minimum(start + (flat & 0xFFFFFFFF) + WINDOW - 1, end), -1)
            gone = np.cumsum(change[:-1]) > 0
            of_text = np.repeat(np.arange(len(counts)), counts)
            n_removed = np.bincount(of_text[gone], minlength=len(counts)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(counts - n_removed)]).astype(np.int32)
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words.filter(pa.array(~gone))), " ")
            columns = [kept if f.name == text else batch[f.name] for f in own.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(n_removed)], names=own.names)

    return joined.mapInArrow(run, own)


def deduplicated(df: DataFrame, batches: int = BATCHES, doc_id: str = "doc_id", text: str = "text", names: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """All rows, less the repeated windows. The documents are taken up in batches of ascending identifiers."""
    spark = df.sparkSession
    cuts = sorted(set(df.stat.approxQuantile(doc_id, [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    size = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    ranges = min(MOST_RANGES, max(FEWEST_RANGES, 1 << (size // RANGE_BYTES).bit_length()))
    index, removed, low = WindowIndex(spark, scratch(spark, "window-index"), ranges), [], None
    for cut in [*cuts, None]:
        key = F.coalesce(F.col(doc_id), F.lit(NO_ID))
        batch = df.where((F.lit(True) if low is None else key > low) & (F.lit(True) if cut is None else key <= cut))
        removed.append(index.add(batch, doc_id, text))
        low = cut
    return applied(df, reduce(DataFrame.union, removed), doc_id, text, names)


def cleaned(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the columns of the table: texts without their repeated windows, unchanged where nothing repeats; documents with no word left go."""
    before, n_words, n_removed = fresh(df, "_before", "_n_words", "_n_removed")
    out = deduplicated(df.withColumn(before, F.col(text)), doc_id=doc_id, text=text, names=(n_words, n_removed))
    kept = out.where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_words)))
    return kept.withColumn(text, F.when(F.col(n_removed) == 0, F.col(before)).otherwise(F.col(text))).select(*df.columns)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
