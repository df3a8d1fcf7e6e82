"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

A word's context is the word just before it in its text, whichever it is; the
end token of the text before stands before the first word. Each context is a
restaurant whose customers are the training tokens seen there; its tables are
the customers of one parent restaurant that all contexts share, whose base is
uniform over the V training words and one unknown word:

    P(w | u) = (c_uw - d t_uw + (theta + d T_u) P(w)) / (theta + c_u)
    P(w)     = (c_w - d' t_w + (theta' + d' T) / (V + 1)) / (theta' + c)

Seating is sampled by Gibbs, one dish of one restaurant at a time: all its
customers leave, and the number of their tables is drawn from its distribution
given the other dishes, which for up to ``EXACT`` customers is exact (by the
generalised Stirling numbers of the Chinese restaurant process); more customers
are seated one after another, from the 65th on in blocks of an eighth of those
seated. The other dishes' tables and the parent's P(w) are those of the sweep
before, as tasks of one sweep don't see each other's changes. After each sweep
discount and strength of both levels are drawn from their distribution given
the seating of all dishes of up to ``EXACT`` customers. The sampled P(w | u) of
the last ``SAMPLES`` sweeps are averaged; in each, a context's sum over all
words is one.

All counts cover all training texts. Tokens are dealt once, in packed blocks by
a hash of the word, so that all customers of a word are in one block. The
``TOP`` most frequent words, a bounded table, are dealt by word and context
instead, and pairs of two of them are counted and scored where the texts are:
no hot word, context or pair lands in one task. Restaurants live in blocks of
contexts: after each sweep a block of words sends one packed message to each
block of contexts, with its share of each restaurant's tables, and gets the
totals back. Only sums over the top words and histograms of bounded size pass
through the driver. Samples come from generators seeded by block and sweep, so
a task that runs again gives the same result. Tables of a sweep go once the
next sweep's are committed.

Words are told apart by a 64-bit hash. A null or empty text has the end token
only. Rows that share an identifier, also null, are one document of several
texts, each with its end. An empty table gives an empty table; further
columns are left out. The tokens of a very long text are dealt as all others
are; its task alone holds its words.
"""

from __future__ import annotations

import functools
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import dropped_tables, flat_words, give_back, kept_table, mixed, scratch, small_batches, table, word_ids
from .sstable import made_folder, opened

#: Words with a short code; words whose pairs are dealt apart. Both only decide how and where a pair is counted.
HEAD, TOP = 1 << 15, 1 << 10
SWEEPS, SAMPLES = 4, 2
#: Discount and strength of contexts and of the parent at the start.
START = {"d": 0.8, "theta": 2.0, "parent_d": 0.75, "parent_theta": 20.0}
#: Most customers of a dish whose tables are drawn exactly.
EXACT = 64
#: Numbers up to this have a bin of their own, larger ones a sixteenth of their power of two.
BINS_FROM, BINS = 256, 1024
#: Training tokens for each block, and the bounds of the number of blocks.
BLOCK_TOKENS, FEWEST_BLOCKS, MOST_BLOCKS = 1_500_000, 16, 1 << 18
#: A task deals its tokens once it holds so many for each block, or so many in all.
DEALT_PER_BLOCK, DEALT_AT_MOST = 1024, 1 << 22
#: A task adds up its counts of words once it holds so many.
COUNTS_AT_ONCE = 1 << 21
END = mixed(np.array([0x656E64], np.uint64))[0]
NO_ID = -(1 << 63)


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


def packed_arrays(**arrays: np.ndarray) -> bytes:
    """Some arrays in one compressed frame, after a line that names them; short, as rows of a few tokens are common where blocks are many."""
    import zstandard

    head = " ".join(f"{name} {x.dtype.str} {len(x)}" for name, x in arrays.items())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.encode(), b"\n", *(x.tobytes() for x in arrays.values())]))


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    at, found = raw.index(b"\n") + 1, {}
    head = iter(raw[: at - 1].decode().split())
    for name, kind, size in zip(head, head, head, strict=True):
        found[name] = np.frombuffer(raw, kind, int(size), at)
        at += found[name].nbytes
    return found


def added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys and the sums of their values."""
    keys, back = np.unique(keys, return_inverse=True)
    return keys, *(np.bincount(back, weights=x, minlength=len(keys)) for x in values)


def frequent_words(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted hashes of the most frequent words, the rank of each (-1 from ``TOP`` on), its count, and the number of tokens. Counts are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            h, n = added(*map(np.concatenate, zip(*held, strict=True)))
            return h, n.astype(np.int64)

        def rows(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for batch in small_batches(batches, text):
            words, counts = flat_words(batch[text], lower=True)
            h, n = np.unique(word_ids(words), return_counts=True)
            held.append((np.append(h, END), np.append(n, len(counts))))
            size += len(h) + 1
            if size > COUNTS_AT_ONCE:
                held = [summed()]
                size = len(held[0][0])
                if size > COUNTS_AT_ONCE // 2:
                    yield rows(*held[0])
                    held, size = [], 0
        if held:
            yield rows(*summed())

    counted = kept_table(df.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "frequent-words")
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    end = int(END.view(np.int64))
    # words by powers of two of their counts, so that few words more than are wanted get sorted
    sizes, least = dict(counted.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()), 0
    for b in sorted(sizes):
        if sum(n for x, n in sizes.items() if x >= b) > HEAD:
            least = b
    found = [(r["h"], r["n"]) for r in counted.where((F.col("h") != end) & (F.col("n") >= 1 << least)).orderBy(F.desc("n"), "h").limit(HEAD - 1).collect()]
    ends = counted.where(F.col("h") == end).first()
    found.insert(0, (end, ends["n"] if ends else 0))
    head = np.array([h for h, _ in found], np.int64).view(np.uint64)
    rank = np.where(np.arange(len(head)) < TOP, np.arange(len(head)), -1)
    order = np.argsort(head)
    return head[order], rank[order], np.array([n for _, n in found], np.int64)[order], total


def places(head: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where the head has each hash (-1: nowhere)."""
    place = np.searchsorted(head, h)
    place[place == len(head)] = 0
    return np.where(head[place] == h, place, -1)


def tokens(text: pa.Array, head: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash and place in the head of each token, ends included, those of the token before, and the text of each."""
    words, counts = flat_words(text, lower=True)
    n, docs = len(words), len(counts)
    h = np.full(n + docs, END, np.uint64)
    h[np.arange(n) + np.repeat(np.arange(docs), counts)] = word_ids(words)
    place = places(head, h)
    before = lambda x, first: np.concatenate([[first], x[:-1]]).astype(x.dtype)
    return h, place, before(h, END), before(place, places(head, np.array([END]))[0]), np.repeat(np.arange(docs), counts + 1)


def coded(name: str, h: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """Words as places in the head; those without one are 65535, and their hashes follow apart."""
    return {f"{name}_place": np.where(place < 0, 65535, place).astype(np.uint16), f"{name}_hash": h[place < 0]}


def decoded(name: str, part: dict[str, np.ndarray], head: np.ndarray) -> np.ndarray:
    place = part[f"{name}_place"]
    far = place == 65535
    h = head[np.where(far, 0, place)]
    h[far] = part[f"{name}_hash"]
    return h


def block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def pair_key(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What a top word is dealt by."""
    return mixed(h + mixed(before))


def pieces(block: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The runs of some ascending block numbers: number, start and end."""
    numbers, first = np.unique(block, return_index=True)
    ends = [*first[1:].tolist(), len(block)] if len(block) else []
    return zip(numbers.tolist(), first.tolist(), ends, strict=True)


#: A message to a block. FILES: where its pairs and tokens are; STATE: its seating; UP: tables for a block of contexts; ROUTE: where that has its contexts; DOWN: totals of contexts; STATS: sums for the driver; TOKENS and COUNTS: what is counted; SUMS: scores of documents.
MESSAGE = "to int, kind int, frm int, data binary"
FILES, STATE, UP, ROUTE, DOWN, STATS, TOKENS, COUNTS, SUMS = range(9)


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    to, kind, frm, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array(frm, pa.int32()), pa.array(data, pa.binary())], names=["to", "kind", "frm", "data"])


def inboxes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """The messages to each block, in order."""
    now, inbox = None, []
    for batch in batches:
        for to, kind, frm, data in zip(*(batch[c].to_pylist() for c in ("to", "kind", "frm", "data")), strict=True):
            if to != now:
                if inbox:
                    yield now, inbox
                now, inbox = to, []
            inbox.append((kind, frm, data))
    if inbox:
        yield now, inbox
    give_back()


def dealt_to_blocks(df: DataFrame, blocks: int) -> DataFrame:
    return df.repartitionById(blocks, "to").sortWithinPartitions("to", "kind", "frm")


def delivered(df: DataFrame, blocks: int, work) -> DataFrame:
    """Hands the messages to each block to ``work``, which gives messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, inbox in inboxes(batches):
            yield from map(messages, work(to, inbox))

    return dealt_to_blocks(df, blocks).mapInArrow(run, MESSAGE)


def of_kind(inbox: list[tuple[int, int, bytes]], kind: int) -> list[bytes]:
    return [data for k, _, data in inbox if k == kind]


def written(folder: str, raw: bytes) -> bytes:
    path = f"{made_folder(folder)}/{uuid.uuid4().hex}"
    with opened(path, write=True) as sink:
        sink.write(raw)
    return path.encode()


def loaded(path: bytes) -> dict[str, np.ndarray]:
    with opened(path.decode()) as source:
        return unpacked(source.read())


def dealt(df: DataFrame, shared, blocks: int, doc_id: str, text: str) -> DataFrame:
    """All tokens but those of two top words, and the training counts of these, to the blocks of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, rank, _ = shared.value
        width = int(rank.max()) + 1
        top = head[np.flatnonzero(rank >= 0)[np.argsort(rank[rank >= 0])]]
        seen, held, n_held = np.zeros(width * width, np.int64), [], 0

        def deal() -> pa.RecordBatch:
            key, h, at, u, u_at, doc, train = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(key)
            key, h, at, u, u_at, doc, train = (x[order] for x in (key, h, at, u, u_at, doc, train))
            rows = []
            for block, a, b in pieces(block_of(key, blocks)):
                docs, first, of = np.unique(doc[a:b], return_index=True, return_inverse=True)
                data = packed_arrays(**coded("w", h[a:b], at[a:b]), **coded("u", u[a:b], u_at[a:b]), docs=docs, train=train[a:b][first], of=of.astype(np.uint16 if len(docs) <= 1 << 16 else np.uint32))
                rows.append((block, TOKENS, 0, data))
            return messages(rows)

        for batch in small_batches(batches, text):
            h, at, u, u_at, of = tokens(batch[text], head)
            docs = pc.fill_null(batch[doc_id].cast(pa.int64()), NO_ID).to_numpy()
            train = ~batch["held_out"].to_numpy(zero_copy_only=False)[of]
            r, s = (np.where(x >= 0, rank[x], -1) for x in (at, u_at))
            both = (r >= 0) & (s >= 0)
            own = both & train
            seen += np.bincount(r[own] * width + s[own], minlength=len(seen))
            rest = ~both
            h, at, u, u_at, of, r, train = (x[rest] for x in (h, at, u, u_at, of, r, train))
            key = h.copy()
            key[r >= 0] = pair_key(h[r >= 0], u[r >= 0])
            held.append((key, h, at, u, u_at, docs[of], train))
            n_held += len(h)
            if n_held >= min(DEALT_PER_BLOCK * blocks, DEALT_AT_MOST):
                yield deal()
                held, n_held = [], 0
        if n_held:
            yield deal()
        at = np.flatnonzero(seen)
        if len(at):
            key = pair_key(top[at // width], top[at % width])
            order = np.argsort(key)
            at, to = at[order], block_of(key[order], blocks)
            yield messages([(block, COUNTS, 0, packed_arrays(w=top[at[a:b] // width], u=top[at[a:b] % width], n=seen[at[a:b]])) for block, a, b in pieces(to)])

    return df.select(doc_id, text, is_held_out(doc_id).alias("held_out")).mapInArrow(run, MESSAGE)


@functools.lru_cache(8)
def log_stirling(d: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers: ways, weighted by the discount, for c customers of a dish (row) to sit at t tables (column)."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, EXACT + 1)
    for c in range(EXACT):
        join = np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)), -np.inf)
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], join + out[c, 1:])
    return out


def seated(n: np.ndarray, scale: np.ndarray, base: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with n customers, where the t-th table but one is opened with weight (scale + d t) base; scale holds the strength and the other dishes' tables."""
    t = np.minimum(n, 1)
    some = np.flatnonzero((n > 1) & (n <= EXACT))
    some = some[np.argsort(n[some], kind="stable")]
    with np.errstate(invalid="ignore"):  # between numbers of more tables than customers
        step = np.diff(log_stirling(d), axis=1)
    for c, a, b in pieces(n[some]):
        more = np.arange(1, c)
        for k in range(a, b, 1 << 16):
            own = some[k : min(b, k + (1 << 16))]
            weight = np.zeros((len(own), c))
            np.cumsum(step[c, 1:c] + np.log((scale[own, None] + d * more) * base[own, None]), axis=1, out=weight[:, 1:])
            weight -= weight.max(1, keepdims=True)
            chance = np.cumsum(np.exp(weight, out=weight), axis=1)
            t[own] += (chance[:, :-1] <= rng.random((len(own), 1)) * chance[:, -1:]).sum(1)
    active, k = np.flatnonzero(n > EXACT), 1
    while len(active):
        step = 1 if k < 64 else k // 8
        now = np.minimum(step, n[active] - k)
        new = (scale[active] + d * t[active]) * base[active]
        chance = new / (new + np.maximum(k - d * t[active], 1e-12))
        t[active] += rng.random(len(active)) < chance if step == 1 else rng.binomial(now, chance)
        k += step
        active = active[n[active] > k]
    return t


def dishes(n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How many dishes have so many customers and tables, for those of 2 to ``EXACT`` customers, as one row."""
    own = (n > 1) & (n <= EXACT)
    return np.bincount(n[own] * (EXACT + 1) + t[own], minlength=(EXACT + 1) ** 2).astype(np.float64)


def binned(x: np.ndarray) -> np.ndarray:
    """How many numbers fall into each bin, and their sum in each, as one row."""
    x = x[x > 0].astype(np.float64)
    octave = np.floor(np.log2(np.maximum(x, BINS_FROM)))
    at = np.where(x < BINS_FROM, x, BINS_FROM + 16 * (octave - 8) + np.floor(16 * (x / 2.0**octave - 1))).astype(np.int64)
    at = np.minimum(at, BINS - 1)
    return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=x, minlength=BINS)]).astype(np.float64)


def log_rising(bins: np.ndarray, theta: float, d: float) -> float:
    """The sum over some numbers x, given in bins, of log(theta (theta + d) ... (theta + (x - 1) d))."""
    count, total = bins.reshape(2, BINS)
    own = np.flatnonzero(count)
    x, start = (total[own] / count[own]).tolist(), theta / d
    rising = np.array([v * math.log(d) + math.lgamma(start + v) - math.lgamma(start) for v in x])
    return float(count[own] @ rising)


def drawn(rng: np.random.Generator, seats: np.ndarray, tables: list[np.ndarray], customers: list[np.ndarray]) -> tuple[float, float]:
    """Discount and strength given the seating, on a grid that is refined around its best point.

    ``seats``: a histogram of dishes; ``tables`` and ``customers``: bins of the totals of restaurants, and of those
    of their dishes beyond ``EXACT``, on which the rest is conditioned.
    """

    def grid(ds: np.ndarray, thetas: np.ndarray) -> np.ndarray:
        own = np.flatnonzero(seats)
        ways = [float(seats[own] @ log_stirling(float(d)).reshape(-1)[own]) for d in ds]
        at = [log_rising(customers[0], th, 1.0) - log_rising(customers[1], th, 1.0) for th in thetas]
        return np.array([[w + log_rising(tables[0], th, d) - log_rising(tables[1], th, d) - c for th, c in zip(thetas, at, strict=True)] for d, w in zip(ds, ways, strict=True)])

    ds, thetas = np.linspace(0.05, 0.95, 13), np.exp(np.linspace(math.log(1e-4), math.log(1e8), 15))
    for _ in range(3):
        best = grid(ds, thetas)
        i, j = np.unravel_index(best.argmax(), best.shape)
        around = lambda x, k: (x[max(0, k - 1)], x[min(len(x) - 1, k + 1)])
        ds, thetas = np.linspace(*around(ds, i), 9), np.exp(np.linspace(*np.log(around(thetas, j)), 9))
    weight = grid(ds, thetas)
    weight = np.exp(weight - weight.max()).reshape(-1)
    i, j = np.unravel_index(rng.choice(len(weight), p=weight / weight.sum()), (len(ds), len(thetas)))
    return float(ds[i]), float(thetas[j])


class Block:
    """The pairs of a block of words (those of held-out texts with no customers) and their present seating."""

    def __init__(self, pairs: dict[str, np.ndarray], top: np.ndarray):
        self.words, self.contexts, self.u = pairs["words"], pairs["contexts"], pairs["u"].astype(np.int64)
        self.of = np.cumsum(pairs["of_step"].astype(np.int64))
        self.n, self.asked = pairs["n"].astype(np.int64), pairs["asked"].astype(np.int64)
        order = np.argsort(top)
        rank = lambda h: np.where((at := places(top[order], h)) >= 0, order[at], -1)
        self.rank, self.context_rank = rank(self.words), rank(self.contexts)
        self.top, self.width = self.rank >= 0, len(top)
        self.t = np.minimum(self.n, 1)
        self.count, self.parent = self.by_word(self.n), self.by_word(self.t)
        self.tables = np.where(self.top, 0, np.minimum(self.parent, 1))
        self.sum = np.zeros(0, np.float32)

    def by_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=x, minlength=len(self.words)).astype(np.int64)

    def restore(self, state: dict[str, np.ndarray]) -> None:
        self.t, self.tables, self.sum = state["t"].astype(np.int64), state["tables"].astype(np.int64), state["sum"]
        self.parent = self.by_word(self.t)

    def state(self) -> bytes:
        small = lambda x: x.astype(np.uint8 if x.max(initial=0) < 256 else np.uint32)
        return packed_arrays(t=small(self.t), tables=small(self.tables), sum=self.sum)

    def p(self, total: dict, fixed: dict) -> np.ndarray:
        """P(w) of each word; that of a top word, whose customers are in many blocks, comes from the driver."""
        p = parent_p(self.parent, self.tables, total, fixed)
        p[self.top] = total["p_top"][self.rank[self.top]]
        return p

    def sweep(self, seed: list[int], tables: np.ndarray, total: dict, fixed: dict) -> None:
        rng, d = np.random.default_rng(seed), total["d"]
        self.t = seated(self.n, total["theta"] + d * np.maximum(tables[self.u] - self.t, 0), self.p(total, fixed)[self.of], d, rng)
        self.parent = self.by_word(self.t)
        own = np.flatnonzero(~self.top)
        scale = total["parent_theta"] + total["parent_d"] * np.maximum(total["T0"] - self.tables[own], 0)
        self.tables[own] = seated(self.parent[own], scale, np.full(len(own), fixed["unknown"]), total["parent_d"], rng)

    def predictive(self, customers: np.ndarray, tables: np.ndarray, total: dict, fixed: dict) -> np.ndarray:
        """The sampled P(w | u) of each pair."""
        d, theta = total["d"], total["theta"]
        return (self.n - d * self.t + (theta + d * tables[self.u]) * self.p(total, fixed)[self.of]) / (theta + customers[self.u])

    def shares(self) -> tuple[np.ndarray, ...]:
        """This block's customers and tables in each of its contexts, and those of dishes beyond ``EXACT`` among them."""
        large = np.flatnonzero(self.n > EXACT)
        by_context = lambda u, x: np.bincount(u, weights=x, minlength=len(self.contexts)).astype(np.int64)
        return *(by_context(self.u, x) for x in (self.n, self.t)), *(by_context(self.u[large], x[large]) for x in (self.n, self.t))

    def sent(self, block: int, blocks: int, first: bool) -> list[tuple[int, int, int, bytes]]:
        customers, tables, large_customers, large_tables = self.shares()
        small = lambda x: x.astype(np.uint16 if (most := x.max(initial=0)) < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)
        rows = []
        for to, a, b in pieces(block_of(self.contexts, blocks)):
            more = {"h": self.contexts[a:b], "c": small(customers[a:b]), "large_c": small(large_customers[a:b])} if first else {}
            rows.append((to, UP, block, packed_arrays(T=small(tables[a:b]), large_T=small(large_tables[a:b]), **more)))
        return [(block, STATE, 0, self.state()), *rows, (block, STATS, 0, packed_arrays(v=self.stats(customers, tables)))]

    def stats(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """What the driver adds up: see ``totals_of``."""
        by_rank = lambda r, x: np.bincount(r[r >= 0], weights=x[r >= 0], minlength=self.width)
        own = ~self.top
        large = own & (self.parent > EXACT)
        sums = [self.parent.sum(), self.tables.sum(), (self.count[own] > 0).sum(), self.n.sum(), self.parent[large].sum(), self.tables[large].sum()]
        return np.concatenate([sums, dishes(self.n, self.t), dishes(self.parent[own], self.tables[own]), by_rank(self.rank, self.parent), by_rank(self.context_rank, customers), by_rank(self.context_rank, tables)]).astype(np.float64)


def parent_p(customers: np.ndarray, tables: np.ndarray, total: dict, fixed: dict) -> np.ndarray:
    d, theta = total["parent_d"], total["parent_theta"]
    return (customers - d * tables + (theta + d * total["T0"]) * fixed["unknown"]) / (theta + total["C0"])


def gathered(df: DataFrame, shared, top: np.ndarray, blocks: int, folder: str) -> DataFrame:
    """Counts the pairs of each block and keeps them and the tokens in files."""

    def work(block: int, inbox: list) -> Iterator[list]:
        head = shared.value[0]
        parts, counts = [unpacked(x) for x in of_kind(inbox, TOKENS)], [unpacked(x) for x in of_kind(inbox, COUNTS)]
        inbox.clear()
        none = np.empty(0, np.uint64)
        w, u = (np.concatenate([none, *(decoded(x, p, head) for p in parts), *(c[x] for c in counts)]) for x in ("w", "u"))
        doc = np.concatenate([none.view(np.int64), *(p["docs"][p["of"]] for p in parts)])
        train = np.concatenate([none.astype(bool), *(p["train"][p["of"]] for p in parts)])
        n = np.concatenate([train.astype(np.int64), *(c["n"] for c in counts)])
        parts = counts = None
        words, of = np.unique(w, return_inverse=True)
        contexts, u = np.unique(u, return_inverse=True)
        pair, back = np.unique(of << 32 | u, return_inverse=True)
        n = np.bincount(back, weights=n, minlength=len(pair)).astype(np.uint32)
        back = back[: len(doc)]
        of = pair >> 32
        pairs = {"words": words, "contexts": contexts, "of_step": np.diff(of, prepend=0).astype(np.uint8), "u": (pair & 0xFFFFFFFF).astype(np.uint32), "n": n, "asked": np.bincount(back, minlength=len(pair)).astype(np.uint32)}
        rows = packed_arrays(doc=doc[np.argsort(back, kind="stable")])
        files = written(folder, packed_arrays(**pairs)) + b"\n" + written(folder, rows)
        yield [(block, FILES, 0, files), *Block(pairs, top).sent(block, blocks, first=True)]

    return delivered(df, blocks, work)


def routed(df: DataFrame, blocks: int, folder: str) -> DataFrame:
    """First totals of all contexts, and where each block of contexts has those of each block of words."""

    def work(block: int, inbox: list) -> Iterator[list]:
        frm, parts = [f for _, f, _ in inbox], [unpacked(x) for _, _, x in inbox]
        h, at = np.unique(np.concatenate([p["h"] for p in parts]), return_inverse=True)
        c, large = (np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=len(h)).astype(np.int64) for k in ("c", "large_c"))
        route = {"at": at.astype(np.uint32), "c": c, "large_c": large, "size": np.array([len(p["h"]) for p in parts])}
        path = written(folder, packed_arrays(**route))
        yield [(block, ROUTE, 0, path), *answers(block, frm, parts, route)]

    return delivered(df.where(F.col("kind") == UP), blocks, work)


def answers(block: int, frm: list[int], parts: list[dict], route: dict[str, np.ndarray]) -> list[tuple[int, int, int, bytes]]:
    at, c = route["at"], route["c"].astype(np.int64)
    tables, large = (np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=len(c)).astype(np.int64) for k in ("T", "large_T"))
    ends = np.cumsum(route["size"]).tolist()
    bins = np.concatenate([binned(x) for x in (tables, large, c, route["large_c"])])
    small = lambda x: x.astype(np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64)
    c, tables = small(c), small(tables)
    return [(block, STATS, 0, packed_arrays(v=bins)), *((f, DOWN, block, packed_arrays(c=c[at[a:b]], T=tables[at[a:b]])) for f, a, b in zip(frm, [0, *ends[:-1]], ends, strict=True))]


def totalled(paths: DataFrame, sent: DataFrame, blocks: int) -> DataFrame:
    """The totals of all contexts after a sweep, back to the blocks of words that have them."""

    def work(block: int, inbox: list) -> Iterator[list]:
        own = [(f, unpacked(x)) for k, f, x in inbox if k == UP]
        yield answers(block, [f for f, _ in own], [p for _, p in own], loaded(of_kind(inbox, ROUTE)[0]))

    return delivered(paths.union(sent.where(F.col("kind") == UP)), blocks, work)


def opened_block(inbox: list, top: np.ndarray) -> tuple[Block, np.ndarray, np.ndarray, bytes]:
    """A block as its last sweep left it, customers and tables in each of its contexts, and the path of its tokens."""
    pairs, rows = of_kind(inbox, FILES)[0].split(b"\n")
    block = Block(loaded(pairs), top)
    block.restore(unpacked(of_kind(inbox, STATE)[0]))
    down = [unpacked(x) for x in of_kind(inbox, DOWN)]
    return block, *(np.concatenate([x[k] for x in down]).astype(np.int64) for k in ("c", "T")), rows


def stats_of(sent: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the STATS messages of blocks of words (``width`` numbers) and of blocks of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.zeros(width + BINS_OF_CONTEXTS)
        for batch in batches:
            for raw in batch["data"].to_pylist():
                x = unpacked(raw)["v"]
                own = v[:width] if len(x) == width else v[width:]
                own += x
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(v[at])], names=["k", "v"])

    out = np.zeros(width + BINS_OF_CONTEXTS)
    for r in sent.where(F.col("kind") == STATS).select("data").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # some thousand numbers
        out[r["k"]] = r["v"]
    return out[:width], out[width:]


BINS_OF_CONTEXTS = 8 * BINS
SUMS_OF_BLOCKS, SEATS = 6, (EXACT + 1) ** 2


def stats_width(width: int) -> int:
    return SUMS_OF_BLOCKS + 2 * SEATS + 3 * width


def model_of(stats: np.ndarray, top_count: np.ndarray) -> dict:
    known, train = stats[2:4]
    known = int(known + (top_count > 0).sum())
    return {"known": known, "train": int(train), "unknown": 1.0 / (known + 1)}


def totals_of(stats: np.ndarray, bins: np.ndarray, sweep: int, before: dict | None, fixed: dict) -> dict:
    """The parent's totals, with the top words' dishes seated here, customers and tables of the top contexts, and discounts and strengths given all seating."""
    rng = np.random.default_rng([0, sweep])
    seats, parent_seats = stats[SUMS_OF_BLOCKS:][: 2 * SEATS].reshape(2, SEATS)
    parent, customers, tables = stats[SUMS_OF_BLOCKS + 2 * SEATS :].reshape(3, -1).astype(np.int64)
    at_top = np.minimum(parent, 1)
    total = dict(START) if before is None else {k: before[k] for k in START}
    if before is not None:
        scale = total["parent_theta"] + total["parent_d"] * np.maximum(before["T0"] - before["at_top"], 0)
        at_top = seated(parent, scale, np.full(len(parent), fixed["unknown"]), total["parent_d"], rng)
    total |= {"C0": stats[0], "T0": stats[1] + float(at_top.sum()), "at_top": at_top, "customers": customers, "tables": tables}
    if before is not None:
        own = bins.reshape(4, 2 * BINS)
        total["d"], total["theta"] = drawn(rng, seats, [own[0], own[1]], [own[2], own[3]])
        large = parent > EXACT
        pairs = [(total["T0"], stats[5] + at_top[large].sum()), (total["C0"], stats[4] + parent[large].sum())]
        total["parent_d"], total["parent_theta"] = drawn(rng, parent_seats + dishes(parent, at_top), *([binned(np.array([x])) for x in pair] for pair in pairs))
    total["p_top"] = parent_p(parent, at_top, total, fixed)
    return total


def base_log(count: np.ndarray, fixed: dict) -> np.ndarray:
    return np.log10((count + 0.5) / (fixed["train"] + 0.5 * (fixed["known"] + 1)))


class Model:
    """A model of the training documents of a table, sampled, with the tokens of all its documents in blocks."""

    def __init__(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        self.df, self.doc_id, self.text, self.spark = df, doc_id, text, df.sparkSession
        self.head, rank, count, n = frequent_words(df.where(~is_held_out(doc_id)), text)
        blocks = min(MOST_BLOCKS, max(FEWEST_BLOCKS, -(-n // BLOCK_TOKENS)))
        at_top = np.flatnonzero(rank >= 0)[np.argsort(rank[rank >= 0])]
        self.blocks, self.top, self.top_count = blocks, self.head[at_top], count[at_top]
        folder, top, width = scratch(self.spark, "pitman-yor"), self.top, stats_width(len(at_top))
        self.shared = self.spark.sparkContext.broadcast((self.head, rank, count))
        parts = kept_table(gathered(dealt(df, self.shared, blocks, doc_id, text), self.shared, top, blocks, folder), "word-blocks")
        routes = kept_table(routed(parts, blocks, folder), "context-blocks")
        stats, bins = stats_of(parts.union(routes), width)
        self.fixed = fixed = model_of(stats, self.top_count)
        self.totals = [totals_of(stats, bins, 0, None, fixed)]
        self.files, paths = (kept_table(x.where(F.col("kind") == kind), "block-files") for x, kind in ((parts, FILES), (routes, ROUTE)))
        self.now, self.down = parts, routes
        for sweep in range(1, SWEEPS + 1):

            def work(number: int, inbox: list, sweep: int = sweep, total: dict = self.totals[-1]) -> Iterator[list]:
                block, customers, tables, _ = opened_block(inbox, top)
                if sweep - 1 > SWEEPS - SAMPLES:
                    p = block.predictive(customers, tables, total, fixed).astype(np.float32)
                    block.sum = block.sum + p if len(block.sum) else p
                block.sweep([zlib.crc32(b"%d" % number), sweep], tables, total, fixed)
                yield block.sent(number, blocks, first=False)

            before = self.now, self.down
            self.now = kept_table(delivered(self.inbox(), blocks, work), "seating")
            self.down = kept_table(totalled(paths, self.now, blocks), "context-totals")
            self.totals.append(totals_of(*stats_of(self.now.union(self.down), width), sweep, self.totals[-1], fixed))
            dropped_tables(*before)
        self.of_top = self.spark.sparkContext.broadcast(self.log_p_of_top())

    def inbox(self) -> DataFrame:
        """What a block of words needs: its files, its last seating, and the last totals of its contexts."""
        return self.files.union(self.now.where(F.col("kind") == STATE)).union(self.down.where(F.col("kind") == DOWN))

    def averager(self):
        top, last, fixed = self.top, self.totals[-1], self.fixed

        def averaged(inbox: list) -> tuple[Block, np.ndarray, bytes]:
            block, customers, tables, rows = opened_block(inbox, top)
            p = block.predictive(customers, tables, last, fixed)
            return block, (p + (block.sum if len(block.sum) else 0)) / SAMPLES, rows

        return averaged

    def log_p_of_top(self) -> np.ndarray:
        """log10 P(w | u) of all pairs of top words: a table of bounded size."""
        width, averaged = len(self.top), self.averager()

        def top_pairs(number: int, inbox: list) -> Iterator[list]:
            block, p, _ = averaged(inbox)
            r, s = block.rank[block.of], block.context_rank[block.u]
            own = (r >= 0) & (s >= 0)
            yield [(0, COUNTS, number, packed_arrays(at=(r[own] * width + s[own]).astype(np.uint32), p=np.log10(p[own]).astype(np.float32)))]

        unseen = [x["p_top"][:, None] * ((x["theta"] + x["d"] * x["tables"]) / (x["theta"] + x["customers"])) for x in self.totals[-SAMPLES:]]
        log_p = np.log10(np.mean(unseen, axis=0)).astype(np.float32).reshape(-1)
        for r in delivered(self.inbox(), self.blocks, top_pairs).select("data").collect():
            own = unpacked(r["data"])
            log_p[own["at"]] = own["p"]
        return log_p

    def scores(self) -> DataFrame:
        """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every document."""
        shared, of_top, fixed, blocks, top_count, averaged, doc_id, text = self.shared, self.of_top, self.fixed, self.blocks, self.top_count, self.averager(), self.doc_id, self.text

        def sums(doc: np.ndarray, base: np.ndarray, score: np.ndarray, known: np.ndarray) -> list[tuple[int, int, int, bytes]]:
            docs, n, known, base, score = added(doc, np.ones(len(doc)), known, base, score)
            to = block_of(mixed(docs.astype(np.int64).view(np.uint64)), blocks)
            order = np.argsort(to, kind="stable")
            docs, n, known, base, score = docs[order], n[order].astype(np.uint32), known[order].astype(np.uint32), base[order], score[order]
            return [(b, SUMS, 0, packed_arrays(doc=docs[x:y], n=n[x:y], known=known[x:y], base=base[x:y], score=score[x:y])) for b, x, y in pieces(to[order])]

        def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (head, _, count), log_p = shared.value, of_top.value
            base = base_log(count, fixed)
            for docs, _, at, _, pair in top_tokens(batches, shared.value, doc_id, text):
                if len(at):
                    yield messages(sums(docs, base[at], log_p[pair].astype(np.float64), count[at] > 0))

        def of_pairs(number: int, inbox: list) -> Iterator[list]:
            block, p, rows = averaged(inbox)
            count = np.where(block.top, top_count[block.rank], block.count)[block.of]
            doc, many = loaded(rows)["doc"], lambda x: np.repeat(x, block.asked)
            if len(doc):
                yield sums(doc, many(base_log(count, fixed)), many(np.log10(p)), many(count > 0))

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows(held: list[bytes]) -> pa.RecordBatch:
                parts = [unpacked(x) for x in held]
                docs, *values = added(*(np.concatenate([p[k] for p in parts]) for k in ("doc", "n", "known", "base", "score")))
                return pa.RecordBatch.from_arrays([pa.array(docs), *(pa.array(x.astype(np.int64)) for x in values[:2]), *map(pa.array, values[2:])], names=names)

            now, held = None, []
            for batch in batches:
                for to, raw in zip(batch["to"].to_pylist(), batch["data"].to_pylist(), strict=True):
                    if to != now and held:
                        yield rows(held)
                        held = []
                    now = to
                    held.append(raw)
            if held:
                yield rows(held)

        names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        both = self.df.select(doc_id, text).mapInArrow(of_texts, MESSAGE).union(delivered(self.inbox(), blocks, of_pairs))
        out = both.repartitionById(blocks, "to").sortWithinPartitions("to").mapInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
        out = out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
        return out.select("doc_id", is_held_out().alias("held_out"), "n_tokens", "n_known", F.lit(fixed["train"]).cast("long").alias("train_tokens"), "base_score", "score")

    def token_scores(self) -> DataFrame:
        """``doc_id``, ``word``, ``context`` (hashes) and ``log10_p`` of every token, end tokens included."""
        shared, of_top, averaged, doc_id, text = self.shared, self.of_top, self.averager(), self.doc_id, self.text
        names = ["doc_id", "word", "context", "log10_p"]

        def rows(doc: np.ndarray, word: np.ndarray, context: np.ndarray, log_p: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(word.view(np.int64)), pa.array(context.view(np.int64)), pa.array(log_p.astype(np.float64))], names=names)

        def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head = shared.value[0]
            for docs, _, at, u_at, pair in top_tokens(batches, shared.value, doc_id, text):
                yield rows(docs, head[at], head[u_at], of_top.value[pair])

        def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, inbox in inboxes(batches):
                block, p, at = averaged(inbox)
                many = lambda x, block=block: np.repeat(x, block.asked)
                yield rows(loaded(at)["doc"], many(block.words[block.of]), many(block.contexts[block.u]), many(np.log10(p)))

        kinds = "doc_id long, word long, context long, log10_p double"
        both = self.df.select(doc_id, text).mapInArrow(of_texts, kinds).union(dealt_to_blocks(self.inbox(), self.blocks).mapInArrow(of_pairs, kinds))
        return both.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def top_tokens(batches: Iterator[pa.RecordBatch], shared: tuple[np.ndarray, ...], doc_id: str, text: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The tokens that are a top word after a top word: document, hash, places in the head of word and context, and place of the pair in the table of top pairs."""
    head, rank, _ = shared
    width = int(rank.max()) + 1
    for batch in small_batches(batches, text):
        h, at, _, u_at, of = tokens(batch[text], head)
        docs = pc.fill_null(batch[doc_id].cast(pa.int64()), NO_ID).to_numpy()
        r, s = (np.where(x >= 0, rank[x], -1) for x in (at, u_at))
        own = (r >= 0) & (s >= 0)
        yield docs[of[own]], h[own], at[own], u_at[own], r[own] * width + s[own]


def scored(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the training documents of a table and scores all of them; see ``Model.scores``."""
    return Model(df, doc_id, text).scores()


def perplexity(scores: DataFrame) -> float:
    """10 to the mean negative log10 probability of a held-out token."""
    r = scores.where("held_out").agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    return 10 ** (-r["s"] / r["n"])


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
