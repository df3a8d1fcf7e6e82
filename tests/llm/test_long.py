"""Very long texts: every operator works on the whole of them."""

import random
import zlib

import pytest
from hushtable.llm import byte_bpe, chat, decontaminate, html_text, minhash, pitman_yor, quality, sstable, substrings, warc
from hushtable.llm.common import scratch

from . import brute

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def text():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijéß") for _ in range(rng.randint(2, 9))) for _ in range(30_000)]
    return " ".join(rng.choice(words) for _ in range(500_000))


@pytest.fixture(scope="module")
def long(spark, text):
    return spark.createDataFrame([(0, text[:4000]), (1, text), (2, None)], "doc_id long, text string").cache()


def test_quality(long, text):
    row = quality.judged(long).where("doc_id = 1").select("quality.*").first()
    assert row["n_words"] == 500_000 and row["word_chars"] == len(text) - 499_999


def test_tokens(spark, long, text):
    from tokenizers import Tokenizer

    vocabulary = P.path("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in sstable.read_shards(sstable.write_shards(long, scratch(spark, "t"), vocabulary, 2)).collect()}
    assert got[1]["n_tokens"] == 1 + len(Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False).ids)
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    decoded = {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.encode(long, ranks, P.PATTERN, decoded=True).collect()}
    assert decoded == {0: text[:4000], 1: text, 2: ""}


def test_items(spark, long, text):
    bench = spark.createDataFrame([(7, text[-300:-100]), (8, text[1_000_000:1_000_200]), (9, text[100:300])], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(long, bench).collect()} == {(0, 9), (1, 7), (1, 8), (1, 9)}


def test_copies(long, text):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(long).collect()}
    assert got[1] == (len({tuple(w[i : i + 5]) for w in [text.split()] for i in range(len(w) - 4)}), 1) and got[0][1] == 0
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.deduplicated(long).collect()}
    assert cut[1] == (500_000, brute.repeated_windows([(0, text[:4000]), (1, text)])[1][1]) and cut[1][1] > 400


def test_score(long, text):
    row = {r["doc_id"]: r for r in pitman_yor.scored(long).collect()}
    assert row[1]["n_tokens"] == 500_001 and row[1]["score"] < 0
    assert row[1]["held_out"] == (zlib.crc32(b"1") % 5 == 1)


def test_pages_and_turns(spark, long, text):
    pages = long.selectExpr("doc_id as page_id", "'http://a.b/' as url", "concat('<html><article><p>', text, '</p></article></html>') as html")
    assert {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()} == {0: text[:4000].strip(), 1: text, 2: ""}
    rows = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(warc.with_responses(pages), scratch(spark, "w")), payload=True).collect()}
    assert len(rows[1]["payload"]) == len(f"<html><article><p>{text}</p></article></html>".encode())
    turns = long.selectExpr("doc_id as conv_id", "0 as turn", "'assistant' as role", "text")
    vocabulary = P.path("byte_bpe_50k.json")
    assert {r["conv_id"]: r["loss_chars"] for r in chat.read_tree(*chat.write_tree(turns, scratch(spark, "c"), vocabulary), vocabulary).collect()} == {0: 4000, 1: len(text), 2: 0}
