"""Quality rules, BPE, shards, near and substring dedup, decontamination, language model: against brute force and on hard tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hushtable.llm import byte_bpe, decontaminate, graph, minhash, pitman_yor, quality, sstable, substrings
from hushtable.llm.common import scratch

from . import brute
from .conftest import WORDS, prose

P = pytest.importorskip("public_tokenizers")
RANKS, WORD_BPE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(autouse=True)
def few_blocks(monkeypatch):
    monkeypatch.setattr(pitman_yor, "FEWEST_BLOCKS", 3)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_quality(table, docs, empty, nulls):
    got = by_id(quality.judged(table).select("doc_id", "quality.*"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for d, t in docs:
        assert got[d][:-1] == brute.quality(t), t
        assert not (got[d][-2] and got[d][-1])
    assert quality.accepted(table).columns == table.columns
    assert quality.accepted(empty).count() == 0 == quality.judged(empty).count()
    assert quality.judged(nulls).count() == 7


def test_quality_rules_reject_noise(spark):
    clean = prose(random.Random(1), 200)
    rows = [(0, clean), (1, " ".join(f"{w}***" for w in clean.split())), (2, " ".join(f"{w.upper()}!!" for w in clean.split())), (3, clean.replace(" ", " | "))]
    assert {r["doc_id"] for r in quality.accepted(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_quality_is_native(table):
    plan = quality.judged(table)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_byte_bpe(table, docs, empty, nulls):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=brute.ranks(RANKS), special_tokens={})
    got = by_id(byte_bpe.tokenized(table), "n_tokens", "ids_sha256", "decoded_sha256")
    for d, t in docs:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        assert got[d] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert byte_bpe.tokenized(empty).count() == 0
    assert sorted(r["n_tokens"] for r in byte_bpe.tokenized(nulls).collect())[:3] == [0, 0, 0]


def test_byte_bpe_hard_texts():
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=brute.ranks(RANKS), special_tokens={})
    rng = random.Random(2)
    hard = ["".join(rng.choice("aA .,!\n\t's日本😀é \x85<|endoftext|>=") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    ids, sizes = byte_bpe.encode_texts(byte_bpe.encoder_of(RANKS, P.PATTERN), pa.array(hard))
    for t, x in zip(hard, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert x.tolist() == enc.encode_ordinary(t), repr(t)


def test_byte_bpe_offsets_and_split_characters(spark):
    rows = spark.createDataFrame([(0, "héllo 日本語 😀 x"), (1, None), (2, "ab")], "doc_id long, text string")
    for r in byte_bpe.encode(rows, RANKS, P.PATTERN, keep=("doc_id", "text"), offsets=True).collect():
        ids, starts, ends = (np.frombuffer(r[c], "<i4") for c in ("ids", "starts", "ends"))
        table, text, at = byte_bpe.token_bytes(RANKS).to_pylist(), r["text"] or "", 0
        for i, a, b in zip(ids, starts, ends, strict=True):
            part = text.encode()[at : at + len(table[i])]
            assert table[i] == part and part in text[a:b].encode() and b - a <= max(1, len(part))
            at += len(part)
        assert at == len(text.encode())
    apart = byte_bpe.decode(byte_bpe.encode(rows, RANKS, P.PATTERN), RANKS)
    at_once = byte_bpe.encode(rows, RANKS, P.PATTERN, decoded=True)
    assert by_id(apart, "decoded", "n_split") == by_id(at_once, "decoded", "n_split") and by_id(apart, "decoded")[0][0].decode() == "héllo 日本語 😀 x"
    assert byte_bpe.decoded_text("日".encode()[:2]) == "�"


def test_shards(spark, table, docs, empty, nulls):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    manifest = sstable.write_shards(table, scratch(spark, "t"), WORD_BPE, 2)
    got = by_id(sstable.read_shards(manifest), "start", "n_tokens", "ids_crc32", "ids")
    start = 0
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert got[d] == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    asked = spark.createDataFrame([(1,), (7,), (7,), (999,), (None,)], "doc_id long")
    assert {r["doc_id"]: bytes(r["ids"]) for r in sstable.lookup(manifest, asked).collect()} == {k: got[k][-1] for k in (1, 7)}
    assert sstable.read_shards(sstable.write_shards(empty, scratch(spark, "t"), WORD_BPE, 2)).count() == 0
    rows = sorted(sstable.read_shards(sstable.write_shards(nulls, scratch(spark, "t"), WORD_BPE, 2)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 5, 5, 6, 7, 7] and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:], strict=False))


def test_special_tokens_in_texts_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = ["a <|endoftext|> b", "x<|endoftext|>y<|startoftext|>", "<|ENDOFTEXT|> <|endoftext |>", "plain words", None, "", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = by_id(sstable.read_shards(sstable.write_shards(df, scratch(spark, "t"), WORD_BPE, 2)), "ids")
    assert [np.frombuffer(got[k][0], "<u4").tolist() for k in range(len(texts))] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    tokenizer.encode_special_tokens = True
    got = by_id(sstable.read_shards(sstable.write_shards(df, scratch(spark, "t"), WORD_BPE, 2, special_as_text=True)), "ids")
    assert [np.frombuffer(got[k][0], "<u4").tolist() for k in range(len(texts))] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_shards_of_bounded_size(spark, table, docs, monkeypatch):
    whole = by_id(sstable.read_shards(sstable.write_shards(table, scratch(spark, "t"), WORD_BPE, 2)), "start", "ids")
    monkeypatch.setattr(sstable, "SHARD_ENTRIES", 3)
    manifest = sstable.write_shards(table, scratch(spark, "t"), WORD_BPE, 2)
    assert manifest.count() >= len(docs) / 3 and manifest.agg({"n_entries": "max"}).first()[0] == 3
    assert by_id(sstable.read_shards(manifest), "start", "ids") == whole
    asked = table.select("doc_id").union(spark.createDataFrame([(-5,), (10**9,)], "doc_id long"))
    assert by_id(sstable.lookup(manifest, asked), "ids") == {k: v[1:] for k, v in whole.items()}


def test_shard_format(tmp_path):
    with open(tmp_path / "s", "wb") as f:
        w = sstable.ShardWriter(f, 2)
        keys = sorted(random.Random(1).sample(range(-50_000, 50_000), 3000))
        for k in keys:
            w.add(sstable.key_of(k), np.arange(200, dtype="<u2").tobytes())
        w.close()
    with sstable.opened(str(tmp_path / "s")) as source:
        shard = sstable.Shard(source)
        assert len(shard.index) > 3 and [k for k, _ in shard.entries()] == keys
        assert all(len(shard.get(k)) == 1 for k in keys[::50]) and shard.get(60_000) == []
        other = [k for k in range(-50_000, 50_000, 97) if k not in set(keys)]
        assert not any(shard.get(k) for k in other)
        passed = sum(all(shard.bloom[p >> 3] >> (p & 7) & 1 for p in sstable.probes(sstable.key_of(k), shard.bits)) for k in other)
        assert passed < 0.05 * len(other)


def test_near_duplicates(table, docs, empty, nulls):
    want = brute.groups(docs)
    got = by_id(minhash.near_duplicates(table), "n_shingles", "component_id", "kept")
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}
    kept = minhash.first_of_groups(table)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in want.items() if c == d}
    assert minhash.near_duplicates(empty).count() == 0
    rows = minhash.near_duplicates(nulls).collect()
    assert len(rows) == 7 and all(r["kept"] for r in rows if r["doc_id"] is None or r["n_shingles"] == 0)


def test_near_duplicates_without_a_hub(spark, monkeypatch):
    """A chain of edits, where most members aren't linked with the leader, and blocks smaller than the buckets."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(9)
    w, docs = prose(rng, 150, 800).split(), []
    for k in range(40):
        docs.append((k, " ".join(w)))
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + "q"
    want = brute.groups(docs)
    got = by_id(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), "n_shingles", "component_id")
    assert got == want


def test_prefix_filter_loses_no_pair(spark, monkeypatch):
    """Long documents of one common passage and own words, of which some are alike: one bucket, in which few pairs are compared."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "FREQUENT_FROM", 5)
    rng, docs = random.Random(14), []
    passage = prose(rng, 120, 800)
    for k in range(24):
        own = prose(rng, 60, 800)
        docs.append((2 * k, f"{passage} {own}"))
        if k % 3 == 0:
            docs.append((2 * k + 1, f"{passage} {own[: len(own) * 4 // 5]} {prose(rng, 12, 800)}"))
    want = brute.groups(docs)
    assert 1 < len({c for _, c in want.values()}) < len(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert by_id(minhash.near_duplicates(df), "n_shingles", "component_id") == want
    members = spark.createDataFrame([(1, 0, d, d, len(docs)) for d, _ in docs], "key long, band byte, doc_id long, component long, n long")
    posted = minhash.split_by_prefix(members, minhash.sets_of(df, df.select("doc_id"))).collect()
    keys = {}
    for r in posted:
        keys.setdefault(r["key"], set()).add(r["doc_id"])
    pairs = {(a, b) for own in keys.values() for a in own for b in own if a < b}
    shingles = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in docs for w in [brute.words(t, True)]}
    links = {(a, b) for a in shingles for b in shingles if a < b and 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b])}
    assert links and links <= pairs and len(pairs) < len(docs) * (len(docs) - 1) / 4


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5), (None, 3), (1000, 700), (1000, 701), (1000, 702)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("batches", [1, 2, 6])
def test_substrings(table, docs, batches):
    got = by_id(substrings.deduplicated(table, batches), "n_words", "n_removed", "text")
    assert got == brute.repeated_windows(docs)


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings_frequent_fingerprints(table, docs, monkeypatch, batches):
    """Fingerprints with more rows than a task holds."""
    monkeypatch.setattr(substrings, "GROUP_ROWS", 1)
    monkeypatch.setattr(substrings, "MERGED_ROWS", 7)
    assert by_id(substrings.deduplicated(table.repartition(20), batches), "n_words", "n_removed", "text") == brute.repeated_windows(docs)


def test_substrings_hard_tables(table, docs, empty, nulls):
    assert substrings.deduplicated(empty).count() == 0
    rows = substrings.deduplicated(nulls).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in rows) == [(-1, 0, 0), (-1, 80, 0), (5, 80, 80), (5, 80, 80), (6, 0, 0), (7, 0, 0), (7, 6, 0)]
    out = substrings.cleaned(table)
    assert out.columns == table.columns
    want = {d: t for d, t in docs if (x := brute.repeated_windows(docs)[d])[1] == 0}
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert want.items() <= got.items() and all(t is None or r == 0 or k for d, t in got.items() for _, r, k in [brute.repeated_windows(docs)[d]])


def test_substring_runs_are_compacted(spark, table, docs, monkeypatch):
    """The runs hold every window once, before and after they are merged; history is neither shuffled nor sorted again."""
    monkeypatch.setattr(substrings, "MOST_RUNS", 2)
    index, seen = substrings.WindowIndex(spark, scratch(spark, "t"), 4), 0
    for k in range(6):
        batch = table.where(f"doc_id >= {k * 10} and doc_id < {k * 10 + 10}")
        index.add(batch).count()
        seen += 1
        here = {tuple(w[i : i + 20]) for d, t in docs if d < k * 10 + 10 for w in [brute.words(t)] for i in range(len(w) - 19)}
        rows = [tuple(r) for r in index.windows().collect()]
        assert len(rows) == len(set(rows)) == len(here)
    assert len(index.runs) <= 2 < seen
    plan = index.dealt(substrings.window_rows(spark.createDataFrame(docs, "doc_id long, text string")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_decontamination(spark, empty, nulls):
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randint(8, 60), 800)) for k in range(20)] + [(20, None), (21, ""), (22, items_text := "Ünïcode, is it?"), (23, "abc")]
    docs, want = [], set()
    for d in range(120):
        text = prose(rng, rng.randint(20, 400), 800)
        if d % 3 == 0:
            k = rng.randrange(20)
            item = items[k][1]
            n = int(len(item.encode()) * decontaminate.EDITS) // 3
            for _ in range(n if d % 2 else 0):
                p = rng.randrange(len(item))
                item = item[:p] + "q" + item[p + 1 :]
            text = f"{text[: len(text) // 2]} {item.upper() if d % 4 == 0 and 'ß' not in item else item}. {text[len(text) // 2 :]}"
            want.add((d, k))
        docs.append((d, text))
    docs += [(500, f"so {items_text.upper()} yes"), (501, None), (502, ""), (503, "x abc y")]
    want |= {(500, 22), (503, 23)}
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, item_id long, edits long")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert {x for x in got if x[1] != 23} == {x for x in want if x[1] != 23} and (503, 23) in got
    bench = bench.where("item_id <> 23")
    clean = decontaminate.decontaminated(df, bench)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, i in want if i != 23}
    assert decontaminate.contaminated(empty, bench).count() == 0 == decontaminate.contaminated(df, bench.limit(0)).count()
    assert decontaminate.decontaminated(nulls, bench).count() == 7


def test_grams_that_repeat_are_counted_in_pieces(monkeypatch):
    rng = random.Random(3)
    items = decontaminate.Items([1, 2, 3], ["ab" * 100, prose(rng, 30, 50), "a" * 150])
    texts = pa.array([prose(rng, 40, 50) + " " + "a" * 4000 + " " + items.texts[1], None, "", "ba" * 2000, prose(rng, 60, 50)])
    want = sorted(items.search(texts))
    assert {(d, i) for d, i, _ in want} == {(0, 1), (0, 2), (3, 0)}
    monkeypatch.setattr(decontaminate, "SHARED_AT_ONCE", 500)
    assert sorted(items.search(texts)) == want


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    rng = random.Random(6)
    items = [(k, prose(rng, 20, 800)) for k in range(15)]
    df = spark.createDataFrame([(k, f"{prose(rng, 50)} {t} {prose(rng, 50)}") for k, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 2000)
    assert len(decontaminate.blocks_of(bench)) > 5
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()} == {(k, k) for k in range(15)}
    assert decontaminate.decontaminated(df, bench).count() == 0


def test_decontamination_against_brute_force(spark):
    """All items against all documents of a small table, by the least edits over all parts of the document."""
    rng = random.Random(12)
    items = [(k, prose(rng, rng.randint(3, 25), 800)) for k in range(25)] + [(25, "aaaa aaaa aaaa"), (26, "ab"), (27, "Zeit! und RAUM"), (28, "ééé ßß")]
    docs = []
    for d in range(60):
        text = prose(rng, rng.randint(0, 120), 800)
        if d % 2:
            part = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(part) // 8))):  # some within the budget, some beyond
                p = rng.randrange(len(part))
                part[p : p + rng.randint(0, 1)] = rng.choice(["", "q", "zz", "é"])
            cut = rng.randint(0, len(text))
            text = f"{text[:cut]} {''.join(part)} {text[cut:]}"
        docs.append((d, text))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(df, bench).collect()}
    want = brute.close_items(docs, items, decontaminate.EDITS)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(want[k] <= got[k] for k in got)


def test_long_documents_are_searched_whole(monkeypatch):
    rng = random.Random(13)
    items = decontaminate.Items([1, 2], [prose(rng, 30, 800), prose(rng, 30, 800)])
    text = f"{prose(rng, 40_000, 800)} {items.texts[0]} {'.' * 100_000} {prose(rng, 40_000, 800)} {items.texts[1].replace(' ', ' ,,, ' * 2000, 1)}"
    want = [(0, 0, 0), (0, 1, 0)]
    assert sorted(items.search(pa.array([text]))) == want
    monkeypatch.setattr(decontaminate, "GRAMS_AT_ONCE", 100)
    assert sorted(items.search(pa.array([text]))) == want


def test_pitman_yor(spark, table, docs, empty):
    held_out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    want = brute.unigrams(docs, held_out)
    got = by_id(pitman_yor.scored(table), "n_tokens", "n_known", "train_tokens", "base_score", "held_out", "score")
    for d, w in want.items():
        assert got[d][:3] == w[:3] and got[d][3] == pytest.approx(w[3]) and got[d][4] == held_out[d]
        assert got[d][5] < 0
    assert pitman_yor.scored(empty).count() == 0


def test_pitman_yor_arrays_survive_packing():
    arrays = {"h": np.array([1, 2**63], np.uint64), "u": np.array([3, 4], np.uint8), "none": np.empty(0, np.int64), "train": np.array([True, False])}
    got = pitman_yor.unpacked(pitman_yor.packed_arrays(**arrays))
    assert list(got) == list(arrays) and all(got[k].dtype == x.dtype and got[k].tolist() == x.tolist() for k, x in arrays.items())


@pytest.mark.parametrize(("per_block", "at_most"), [(1, 1), (1 << 20, 7), (1 << 20, 1 << 22)])
def test_pitman_yor_is_the_same_however_tokens_are_dealt(spark, table, monkeypatch, per_block, at_most):
    want = by_id(pitman_yor.scored(table), "n_tokens", "n_known", "base_score", "score")
    monkeypatch.setattr(pitman_yor, "DEALT_PER_BLOCK", per_block)
    monkeypatch.setattr(pitman_yor, "DEALT_AT_MOST", at_most)
    got = by_id(pitman_yor.scored(table), "n_tokens", "n_known", "base_score", "score")
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_pitman_yor_ties_in_identifiers(nulls):
    rows = {r["doc_id"]: r["n_tokens"] for r in pitman_yor.scored(nulls).collect()}
    assert rows == {None: 82, 5: 162, 6: 1, 7: 8}


@pytest.mark.parametrize("top", [1 << 10, 4])
def test_pitman_yor_probabilities_sum_to_one(spark, monkeypatch, top):
    """Over all known words, the end and an unknown word, after each word: asked for by held-out texts of every pair of words."""
    monkeypatch.setattr(pitman_yor, "TOP", top)
    rng = random.Random(8)
    docs = [(k, prose(rng, 60, 12)) for k in range(40)]
    words = sorted({w for d, t in docs if zlib.crc32(str(d).encode()) % 5 != 1 for w in brute.words(t, True)})
    contexts = [*words, "notaword"]
    held = [d for d in range(10_000, 20_000) if zlib.crc32(str(d).encode()) % 5 == 1][: len(contexts)]
    asked = [(d, " ".join(f"{c} {w}" for w in [*words, "notaword"])) for d, c in zip(held, contexts, strict=True)] + [(held[0], c) for c in contexts]
    model = pitman_yor.Model(spark.createDataFrame(docs + asked, "doc_id long, text string"))
    rows = model.token_scores().collect()
    p = {}
    for r in rows:
        assert p.setdefault((r["context"], r["word"]), pytest.approx(r["log10_p"], abs=1e-4)) == r["log10_p"]
    whole = [c for c in {c for c, _ in p} if sum(x == c for x, _ in p) == len(words) + 2]
    assert len(whole) >= len(contexts)
    for c in whole:
        assert sum(10**x.expected for (k, _), x in p.items() if k == c) == pytest.approx(1, abs=1e-4)
    sums = {}
    for r in rows:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["log10_p"]
    assert all(x[0] == pytest.approx(sums[d], rel=1e-5) for d, x in by_id(model.scores(), "score").items())


def test_tables_follow_their_distribution():
    """Up to EXACT customers the draw is from the weights of all seatings of a dish, told over one by one."""
    scale, base, d, n = 3.0, 0.2, 0.4, 6
    weight = {}

    def seat(sizes):
        if sum(sizes) == n:
            ways = weight.setdefault(len(sizes), [])
            ways.append(np.prod([np.prod([k - d for k in range(1, m)]) for m in sizes]) * np.prod([(scale + d * k) * base for k in range(1, len(sizes))]))
            return
        for k in range(len(sizes)):
            seat([m + (i == k) for i, m in enumerate(sizes)])
        seat([*sizes, 1])

    seat([1])
    total = sum(map(sum, weight.values()))
    got = pitman_yor.seated(np.full(200_000, n), np.full(200_000, scale), np.full(200_000, base), d, np.random.default_rng(1))
    for t, ways in weight.items():
        assert (got == t).mean() == pytest.approx(sum(ways) / total, abs=0.005)
    many = pitman_yor.seated(np.array([1, 2, 50, 100_000]), np.full(4, 20.0), np.full(4, 0.01), 0.5, np.random.default_rng(0))
    assert many[0] == 1 and (many >= 1).all() and (many <= [1, 2, 50, 100_000]).all()


def test_discount_and_strength_are_found_again():
    """Of restaurants seated by the Chinese restaurant process with known values, where all dishes are different."""
    rng = np.random.default_rng(3)
    for d, theta in ((0.5, 3.0), (0.8, 0.5)):
        customers, tables, dishes = [], [], []
        for _ in range(400):
            sizes = []
            for k in range(60):
                new = (theta + d * len(sizes)) / (theta + k)
                if rng.random() < new:
                    sizes.append(1)
                else:
                    sizes[rng.choice(len(sizes), p=(np.array(sizes) - d) / (k - d * len(sizes)))] += 1
            customers.append(60)
            tables.append(len(sizes))
            dishes += sizes
        dishes, none = np.array(dishes), pitman_yor.binned(np.empty(0))
        got = [pitman_yor.drawn(rng, pitman_yor.dishes(dishes, np.ones(len(dishes), int)), [pitman_yor.binned(np.array(tables)), none], [pitman_yor.binned(np.array(customers)), none]) for _ in range(5)]
        assert np.mean([x for x, _ in got]) == pytest.approx(d, abs=0.06) and np.mean([x for _, x in got]) == pytest.approx(theta, rel=0.5)


def test_pitman_yor_against_plain_gibbs(spark, monkeypatch):
    """Mean scores of a small table against a sampler that seats one customer after another at tables of its own."""
    fixed = dict(pitman_yor.START, d=0.6, theta=1.5, parent_d=0.4, parent_theta=2.0)
    monkeypatch.setattr(pitman_yor, "START", fixed)
    drawn = iter([])
    monkeypatch.setattr(pitman_yor, "drawn", lambda rng, seats, tables, customers: next(drawn))
    monkeypatch.setattr(pitman_yor, "SWEEPS", 12)
    monkeypatch.setattr(pitman_yor, "SAMPLES", 9)
    drawn = iter([(fixed["d"], fixed["theta"]), (fixed["parent_d"], fixed["parent_theta"])] * 12)
    rng = random.Random(21)
    docs = [(k, prose(rng, rng.randint(0, 25), 20)) for k in range(40)]
    held_out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    got = by_id(pitman_yor.scored(spark.createDataFrame(docs, "doc_id long, text string")), "score", "n_tokens")
    want = brute.pitman_yor(docs, held_out, fixed, 300, 200)
    off = [abs(got[d][0] - want[d]) / got[d][1] for d in want]
    assert max(off) < 0.06 and sum(off) / len(off) < 0.015


def test_pitman_yor_beats_the_base_on_held_out_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in pitman_yor.scored(df).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_pitman_yor_takes_every_preceding_word_as_context(spark):
    """More pairs than there were contexts: after each first word its own second word is likelier than another's."""
    rng, pairs = random.Random(9), range(300)
    train = [d for d in range(200) if zlib.crc32(str(d).encode()) % 5 != 1]
    ask = [d for d in range(10_000, 20_000) if zlib.crc32(str(d).encode()) % 5 == 1][: 2 * len(pairs)]
    texts = [" ".join(f"a{k} b{k}" for k in rng.sample(pairs, 60)) for _ in train]
    asked = [f"a{k} b{k}" for k in pairs] + [f"a{k} b{(k + 1) % len(pairs)}" for k in pairs]
    df = spark.createDataFrame([*zip(train, texts, strict=True), *zip(ask, asked, strict=True)], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in pitman_yor.scored(df).collect()}
    assert all(score[ask[k]] > score[ask[k + len(pairs)]] + 0.5 for k in pairs)


def test_pitman_yor_is_the_same_however_rows_are_dealt(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, prose(rng, 12, 60)) for k in range(60)], "doc_id long, text string").cache()
    one, many = (by_id(pitman_yor.scored(df.repartition(n)), "n_tokens", "n_known", "base_score", "score") for n in (1, 30))
    assert one.keys() == many.keys() and all(np.allclose(one[k], many[k]) for k in one)
