"""MinHash near-dedup: universal hash minima with banding, signature and full-set verification, components by alternating stars.

Documents with the same shingle set are one class and enter the search once.
In the buckets of the first bands every class is compared with the bucket's
leader, the class that meets most others over all bands; then in all buckets
those that are not in the leader's component. That can miss a link between two
classes that the leader links with neither, so buckets whose classes are still
in different components are then compared in full within tasks that return only
links that join components. The classes of buckets beyond ``BLOCK`` are first
split by prefix filtering: of two similar sets, the first quarter of one and
that of the other, in any one order of all shingles, have a shingle in common,
so only classes with such a shingle are compared; the order puts frequent
shingles last. Where one is in too many first quarters even so, its classes are
compared block by block; no pair is dropped for the size of its bucket.

With ``BANDS`` bands of ``ROWS`` minima a pair at the threshold of 0.75 shares
no bucket with probability (1 - 0.75 ** ROWS) ** BANDS, about 2e-6; the
signature test then loses less than 1e-6 (over five standard deviations).

A null or empty text, or one without words, has an empty set and no links;
rows with a null identifier have none either. Repeated rows each have a row in
the result and are in one class. An empty table gives an empty table, and
further columns are left out. A very long text is looked at whole by its task
alone, which needs about a hundred bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import packed
from .common import BASES, few_rows, flat_words, kept_table, mixed, small_batches, table, windows, word_ids
from .graph import components

SHINGLE, SIMILAR_PERCENT = 5, 75
BANDS, ROWS = 48, 5
#: Bands whose buckets link most copies before the others are looked at.
FIRST_BANDS = 6
#: Least share of equal minima for a pair to be confirmed on full sets.
SIGNATURE_FLOOR = 0.60
#: Classes of a bucket that are compared with each other at once.
BLOCK = 1000
#: Shingles that come last in the order for prefix filtering, at most, and the classes that have such a one, at least.
FREQUENT, FREQUENT_FROM = 100_000, 50
#: The band of a pair that shares a shingle in place of a bucket.
NO_BAND = -1
#: Identifiers of candidates are broadcast up to this number; Spark joins more by a shuffle.
BROADCAST_IDS = 1 << 20


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The universal hash functions (a x + b mod 2**64, upper half); a is odd."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, np.uint64)


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after another, and the size of each set."""
    words, counts = flat_words(text, lower=True)
    ids = word_ids(words)
    h, of, _ = windows(ids, counts, SHINGLE)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        starts = np.cumsum(counts) - counts
        extra = []
        for k in short.tolist():
            x = counts[k : k + 1].astype(np.uint64)
            for i in range(starts[k], starts[k] + counts[k]):
                x = x * BASES[1] + ids[i]
            extra.append(x[0])
        h, of = np.concatenate([h, mixed(np.array(extra, np.uint64))]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(counts)).astype(np.int64)


def minima(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The signatures (32-bit minima) of all non-empty sets; rows of empty sets are zero."""
    a, b = multipliers(BANDS * ROWS)
    out = np.zeros((len(sizes), len(a)), np.uint32)
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[full])
    k = 0
    while k < len(full):  # so many sets at a time that they stay in the cache
        start = ends[k] - sizes[full[k]]
        to = max(k + 1, int(np.searchsorted(ends, start + 30_000, side="right")))
        part = h[start : ends[to - 1]]
        places = ends[k:to] - sizes[full[k:to]] - start
        room = np.empty_like(part)
        for i in range(len(a)):
            np.multiply(part, a[i], out=room)
            np.add(room, b[i], out=room)
            out[full[k:to], i] = np.minimum.reduceat(room, places) >> np.uint64(32)
        k = to
    return out


def signatures(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (set size), ``f`` and ``g`` (two sums over the set, equal for equal sets) and ``signature``."""
    names = ["doc_id", "n", "f", "g", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, 2 << 20):
            h, sizes = shingle_sets(batch[text])
            signature = minima(h, sizes)
            sums = []
            for base in BASES:
                total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h * base))])
                ends = np.cumsum(sizes)
                sums.append((total[ends] - total[ends - sizes]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch[doc_id].cast(pa.int64()), pa.array(sizes), *map(pa.array, sums), packed(signature.reshape(-1), np.full(len(sizes), signature.shape[1]))], names=names)

    return df.select(doc_id, text).mapInArrow(run, "doc_id long, n long, f long, g long, signature binary")


def band_keys(df: DataFrame) -> DataFrame:
    """``key``, ``band`` and ``doc_id``, one row for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 1000):
            n = batch.num_rows
            rows = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint32).reshape(n, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
            for i in range(ROWS):
                key = mixed(key * BASES[0] + rows[:, :, i])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int8), n)), pa.array(np.repeat(batch["doc_id"].to_numpy(), BANDS))], names=["key", "band", "doc_id"])

    return df.select("doc_id", "signature").mapInArrow(run, "key long, band byte, doc_id long")


def sets_of(df: DataFrame, ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The full shingle sets of some documents, from their texts."""
    few = ids.count() <= BROADCAST_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, 2 << 20):
            h, sizes = shingle_sets(batch[text])
            yield pa.RecordBatch.from_arrays([batch[doc_id].cast(pa.int64()), packed(h, sizes, 8)], names=["doc_id", "shingles"])

    return df.select(doc_id, text).join(F.broadcast(ids) if few else ids, doc_id, "left_semi").mapInArrow(run, "doc_id long, shingles binary")


def alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs whose signatures agree well enough."""
    least = int(SIGNATURE_FLOOR * BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 1000):
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    both = pairs.join(signed.select(F.col("doc_id").alias("a"), F.col("signature").alias("x")), "a").join(signed.select(F.col("doc_id").alias("b"), F.col("signature").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The pairs that are similar on their full sets."""
    pairs = kept_table(pairs.distinct(), "candidates")
    ids = kept_table(pairs.select(F.col("a").alias(doc_id)).union(pairs.select("b")).distinct(), "candidate-ids")
    sets = kept_table(sets_of(df, ids, doc_id, text), "candidate-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 1000):
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    return kept_table(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def unsettled(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with their components and the bucket's size."""
    members = buckets.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_keys = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    return kept_table(members.join(open_keys, "key"), "unsettled")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """The test on full sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= SIMILAR_PERCENT * (len(x) + len(y) - both)


def links_across(band: int, rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links that join different components of a bucket (or of two blocks of it): own block, document, component, signature, set of each row.

    A pair is tested in the first bucket that it shares (by shingle: in each), and only while its components aren't joined.
    """
    own, ids = np.array([r[0] for r in rows]), [r[1] for r in rows]
    marks = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(len(rows), -1)
    names, comp = np.unique([r[2] for r in rows], return_inverse=True)
    if len(names) < 2:
        return
    sizes = [len(r[4]) // 8 for r in rows]
    sets = {}
    set_of = lambda k: sets.setdefault(k, np.frombuffer(rows[k][4], np.uint64))
    one_block, least = own.min() == own.max(), int(SIGNATURE_FLOOR * BANDS * ROWS)
    count = np.bincount(comp)
    for k in np.argsort(count[comp], kind="stable").tolist():  # members of small components first
        rest = np.flatnonzero((comp != comp[k]) if one_block else (comp != comp[k]) & (own != own[k]))
        if not len(rest):
            continue
        equal = marks[rest] == marks[k]
        good = np.flatnonzero(equal.sum(1) >= least)
        if band != NO_BAND:
            good = good[equal[good].reshape(len(good), BANDS, ROWS).all(2).argmax(1) == band]
        for m in rest[good[np.argsort(-equal[good].sum(1), kind="stable")]].tolist():
            small, large = sorted((sizes[k], sizes[m]))
            if comp[m] != comp[k] and 100 * small >= SIMILAR_PERCENT * large and similar(set_of(k), set_of(m)):
                comp[comp == comp[k]] = comp[m]
                yield ids[k], ids[m]


def frequent_shingles(sets: DataFrame) -> np.ndarray:
    """The sorted hashes of the shingles that most of these sets have: a table of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "shingles"):
            h, n = np.unique(np.frombuffer(b"".join(batch["shingles"].to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    counted = sets.select("shingles").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    return np.sort(np.array([r["h"] for r in counted.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()], np.int64).view(np.uint64))


def split_by_prefix(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of large buckets, with a shingle of their sets' first quarters that another component has too in place of the bucket, and the number of classes that have it."""
    own = members.select("doc_id", "component").distinct().join(sets, "doc_id")
    frequent = frequent_shingles(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "shingles"):
            doc, comp, key = [], [], []
            for d, c, raw in zip(*(batch[x].to_pylist() for x in ("doc_id", "component", "shingles")), strict=True):
                h = np.frombuffer(raw, np.uint64)
                last = np.isin(h, frequent, assume_unique=True)
                first = np.concatenate([h[~last], h[last]])[: len(h) - -(-SIMILAR_PERCENT * len(h) // 100) + 1]
                key.append(first.view(np.int64))
                doc.append(np.full(len(first), d))
                comp.append(np.full(len(first), c))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, doc, comp)], names=["key", "doc_id", "component"])

    posted = kept_table(own.mapInArrow(run, "key long, doc_id long, component long"), "prefixes")
    shared = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key", "n")
    return posted.join(shared, "key").withColumn("band", F.lit(NO_BAND).cast("byte"))


def across(members: DataFrame, signed: DataFrame, df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links between components that share a bucket. Pairs are compared within tasks, on full sets; only joining links leave the task."""
    sets = kept_table(sets_of(df, kept_table(members.select(F.col("doc_id").alias(doc_id)).distinct(), "unsettled-ids"), doc_id, text), "unsettled-sets")
    columns = ("key", "band", "doc_id", "component", "n")
    large = members.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        members = members.where(F.col("n") <= BLOCK).select(*columns).union(split_by_prefix(large, sets).select(*columns))
    blocked = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = blocked.select("key", "band", "doc_id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "component")
    dealt = dealt.join(signed.select("doc_id", "signature").join(sets, "doc_id"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out = None, [], []
        for batch in few_rows(batches, 1000):
            for key, band, i, j, *row in zip(*(batch[c].to_pylist() for c in ("key", "band", "i", "j", "own", "doc_id", "component", "signature", "shingles")), strict=True):
                if (key, band, i, j) != group:
                    if group:
                        out += links_across(group[1], rows)
                    group, rows = (key, band, i, j), []
                rows.append(row)
        if group:
            out += links_across(group[1], rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    sorted_rows = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "band", "i", "j")
    return sorted_rows.select("key", "band", "i", "j", "own", "doc_id", "component", "signature", "shingles").mapInArrow(run, "a long, b long")


def other_stars(members: DataFrame) -> DataFrame:
    """Pairs of a bucket's leader with those of its classes that are not in its component."""
    heads = members.where("doc_id = leader").select("key", F.col("component").alias("c"))
    return members.join(heads, "key").where("component != c").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()


def led(keys: DataFrame) -> DataFrame:
    """The members of all buckets of two or more, with the size n of the bucket and its leader: the member that meets most others over all bands."""
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = kept_table(keys.join(sizes, "key"), "bucket-members")
    met = buckets.groupBy("doc_id").agg(F.sum("n").alias("met"))
    leaders = buckets.join(met, "doc_id").groupBy("key").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("m")))["m"].alias("minus"))
    return kept_table(buckets.join(leaders.select("key", (-F.col("minus")).alias("leader")), "key"), "buckets")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``class_id`` (smallest document with the same set), ``component_id`` and ``kept``."""
    signed = kept_table(signatures(df, doc_id, text), "signatures")
    linkable = signed.where("n > 0 and doc_id is not null")
    classes = kept_table(linkable.groupBy("f", "g", "n").agg(F.min("doc_id").alias("class_id")), "classes")
    heads = linkable.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    buckets = led(band_keys(heads))
    verified = lambda pairs: confirmed(alike(pairs, heads), df, doc_id, text)
    star = lambda rows: rows.where("leader != doc_id").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = verified(star(buckets.where(F.col("band") < FIRST_BANDS)))
    found = kept_table(components(links), "components")
    for links_of in (lambda members: verified(other_stars(members)), lambda members: kept_table(across(members, heads, df, doc_id, text), "links")):
        more = links_of(unsettled(buckets, found))
        if not more.isEmpty():
            links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
            found = kept_table(components(links), "components")
    named = signed.join(classes, ["f", "g", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    named = named.join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    out = named.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document of each group, with the columns of the table."""
    out = near_duplicates(df, doc_id, text).where(~F.col("kept")).select("doc_id").distinct()
    return df.join(out, df[doc_id] == out["doc_id"], "left_anti")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
