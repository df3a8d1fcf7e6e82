"""What the training-data operators share: tables, scratch space, Arrow batches, word arrays and 64-bit hashes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..names import fresh as fresh, scratch as scratch
from ..shipping import ship

BATCH_CONF, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"
#: Words are maximal runs of anything but space and the control characters x09-x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Sends the package to the executors, and lowers the size of Arrow batches where nobody set it, as texts are long and a task holds several batches."""
    ship(spark)
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_table(df: DataFrame, what: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back, which cuts the lineage: a lost executor loses none of it."""
    prepare(spark := df.sparkSession)
    df.write.parquet(path := scratch(spark, what))
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def dropped_tables(*tables: DataFrame) -> None:
    """Deletes tables of ``kept_table`` that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the system, as a worker outlives its tasks and the next may be another operator's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the text of each is about ``most_bytes`` at most; a longer text gets a batch of its own. No row is dropped."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_bytes, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def few_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches to so many rows, for steps that make much of a row."""
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            yield batch.slice(a, most)
    give_back()


def flat_words(text: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, one after another, and the number of words of each text. A null text has none."""
    text = pc.fill_null(text, "")
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.list_flatten(lists)
    full = pc.not_equal(pc.binary_length(words), 0)
    if not pc.all(full).as_py() and len(words):  # leading and trailing white space leaves empty strings
        of = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(of[full.to_numpy(zero_copy_only=False)], minlength=len(counts)).astype(np.int64)
        words = words.filter(full)
    return words, counts


#: Odd multipliers of the polynomial hashes and of the mixing step (arbitrary fixed values).
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX[0]
    x = x ^ (x >> np.uint64(29))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(32))


def word_ids(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word; only distinct words are hashed one by one."""
    if not len(words):
        return np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    key = f"llm-words-{seed:06d}"[:16]
    distinct = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), hash_key=key, categorize=False)
    return mixed(distinct)[coded.indices.to_numpy()]


def windows(ids: np.ndarray, counts: np.ndarray, k: int, base: np.uint64 = BASES[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words of one text: the hashes, the text of each and the place of its first word in that text."""
    n, ends = len(ids), np.cumsum(counts)
    starts = ends - counts
    per = np.maximum(counts - k + 1, 0)
    of = np.repeat(np.arange(len(counts)), per)
    at = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    if not len(of):
        return np.empty(0, np.uint64), of, at
    first = starts[of] + at
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):  # Horner's rule, over all places at once
        h = h * base + ids[i : n - k + 1 + i]
    return mixed(h[first]), of, at
