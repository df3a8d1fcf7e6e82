"""Properties of the small formats and algorithms, over generated inputs."""

import io

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("hypothesis")
from hushtable.llm import chat, common, decontaminate, minhash, sstable, substrings, warc
from hypothesis import given, settings, strategies as st

from . import brute

TEXT = st.text(st.sampled_from("ab<|\\>\n é日"), max_size=40)


@given(TEXT, TEXT)
def test_turns_can_be_read_back(role, text):
    segment = "".join(chat.turn_parts(role, text))
    assert chat.parsed_turn(segment) == (role, text)
    assert segment.count(chat.OPEN) == segment.count(chat.CLOSE) == 1


class Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@settings(deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.integers(-(1 << 63), (1 << 63) - 1)), st.lists(st.integers(0, 65535), max_size=30), max_size=60))
def test_shards_hold_what_was_put_in(entries):
    out = Memory()
    writer = sstable.ShardWriter(out, 2)
    keys = sorted(entries, key=lambda k: (k is not None, k or 0))
    for k in keys:
        writer.add(sstable.key_of(k), np.array(entries[k], "<u2").tobytes())
    writer.close()
    shard = sstable.Shard(out)
    assert [(k, v.tolist()) for k, v in shard.entries()] == [(k, entries[k]) for k in keys]
    assert all([x.tolist() for x in shard.get(k)] == [entries[k]] for k in keys)


@settings(deadline=None)
@given(st.lists(st.binary(max_size=400), max_size=30))
def test_archives_hold_what_was_put_in(payloads):
    records = [warc.record(k, f"http://x/{k}", p, None, False, warc.base32(__import__("hashlib").sha1(p).digest())) for k, p in enumerate(payloads)]
    raw, places = warc.archive(records)
    assert list(warc.records_of(raw)) == records and len(places) == len(records)
    assert [warc.parsed(r)["payload"] for r in records] == payloads


def edits(item, part):
    row = [0] * (len(part) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(part):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(deadline=None, max_examples=200)
@given(st.text("abc", min_size=1, max_size=25), st.text("abc", max_size=40), st.integers(0, 6))
def test_banded_alignment(item, part, k):
    """With a band over the whole part the alignment is exact; any band never finds fewer edits."""
    x, y = (np.frombuffer(t.encode(), np.uint8) for t in (item, part))
    best = edits(item, part)
    wide = decontaminate.aligned(x, y, k, len(part) + len(item) + 1)
    assert wide >= min(best, k + 1)
    if best == 0 <= k:
        assert wide == 0
    assert decontaminate.aligned(x, y, k, 3) >= wide


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab \t\n\x0b\x1c\x85\xa0é"), max_size=30)), max_size=8))
def test_words_and_windows(texts):
    words, counts = common.flat_words(pa.array(texts, pa.string()))
    want = [brute.words(t) for t in texts]
    assert words.to_pylist() == [w for ws in want for w in ws] and counts.tolist() == list(map(len, want))
    ids = common.word_ids(words)
    for size in (1, 2, 3):
        h, of, at = common.windows(ids, counts, size)
        places = [(d, i, tuple(ws[i : i + size])) for d, ws in enumerate(want) for i in range(len(ws) - size + 1)]
        assert list(zip(of.tolist(), at.tolist(), strict=True)) == [p[:2] for p in places]
        assert len(set(h.tolist())) == len({p[2] for p in places})


@settings(deadline=None, max_examples=100)
@given(st.lists(st.text(st.sampled_from("ab "), max_size=120), max_size=6))
def test_equal_windows_have_equal_fingerprints(texts):
    words, counts = common.flat_words(pa.array(texts, pa.string()))
    fp, of, at, h = substrings.grams_of(common.word_ids(words), counts)
    want = [brute.words(t) for t in texts]
    by_window = {}
    for f, d, i, x in zip(fp.tolist(), of.tolist(), at.tolist(), h.tolist(), strict=True):
        by_window.setdefault(tuple(want[d][i : i + substrings.WINDOW]), set()).add((f, x))
    assert all(len(v) == 1 for v in by_window.values()) and len(fp) == sum(max(0, len(w) - substrings.WINDOW + 1) for w in want)


@settings(deadline=None, max_examples=50)
@given(st.lists(st.text(st.sampled_from("abc "), max_size=60), max_size=6))
def test_signatures_are_minima_of_sets(texts):
    h, sizes = minhash.shingle_sets(pa.array(texts, pa.string()))
    want = []
    for t in texts:
        w = brute.words(t, True)
        want.append(len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
    assert sizes.tolist() == want
    signature = minhash.minima(h, sizes)
    a, b = minhash.multipliers(minhash.BANDS * minhash.ROWS)
    ends = np.cumsum(sizes)
    for k, n in enumerate(sizes.tolist()):
        own = h[ends[k] - n : ends[k]]
        assert (signature[k] == (((own[:, None] * a + b).min(0) >> np.uint64(32)) if n else 0)).all()
