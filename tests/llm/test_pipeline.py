"""The pipeline's stages against brute force, on the smallest table and on hard ones."""

import hashlib
import re

import corpus_pipeline
import numpy as np
import pytest
from hushtable.llm import decontaminate, quality

from . import brute

P = pytest.importorskip("public_tokenizers")
AT = "/root/testdata/sf0.001"


def verdict(text):
    """The quality rules, from their definitions."""
    text = text or ""
    w, (n, chars, symbols, dup, _, failed) = brute.words(text), brute.quality(text)
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    if failed:
        return False
    values = {
        "mean_word_chars": chars / n, "symbols_per_word": symbols / n, "stop_words": len({x for x in w if x in quality.STOP_WORDS}), "dup_line_share": dup / len(lines),
        "bullet_line_share": sum(bool(re.match("[-*•] ", x.lstrip(" "))) for x in lines) / len(lines), "ellipsis_line_share": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines) / len(lines),
        "exclaimed_word_share": (len(text) - len(text.replace("!!", ""))) / 2 / n, "pipe_word_share": text.count("|") / n, "letter_share": sum(c.isalpha() for c in text) / chars,
    }
    return all((r.low is None or values[r.metric] >= r.low) and (r.high is None or values[r.metric] <= r.high) for r in quality.RULES)


def plain(text):
    return re.sub(r"[\x00-\x7f]", lambda m: m[0] if m[0].isalnum() else " ", (text or "").lower())


def test_pipeline(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{AT}/documents.parquet").collect()]
    items = [re.sub(" +", " ", plain(r["text"])).strip() for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    good = [(d, t) for d, t in rows if verdict(t)]
    groups = brute.groups(good)
    single = [(d, t) for d, t in good if groups[d][1] == d]
    cut = brute.repeated_windows(single)
    texts = {d: t if cut[d][1] == 0 else cut[d][2] for d, t in single if cut[d][1] == 0 or cut[d][2]}
    clean = {d: t for d, t in texts.items() if not any(i in re.sub(" +", " ", plain(t)) for i in items)}
    assert len(rows) > len(good) > len(single) and len(texts) > len(clean)
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=brute.ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for d, t in clean.items():
        ids = np.array(enc.encode_ordinary(t), "<u4").tobytes()
        want[d] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = corpus_pipeline.run(spark, AT).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["table", "empty", "nulls"])
def test_stages_on_hard_tables(spark, request, name):
    df = request.getfixturevalue(name)
    for stage, run in corpus_pipeline.STAGES[:-1]:
        out = run(spark, df, AT)
        assert out.columns == df.columns, stage
        out.write.format("noop").mode("overwrite").save()
    assert corpus_pipeline.STAGES[-1][1](spark, df, AT).count() == df.count()


def test_stages_keep_every_clean_document(spark):
    """Documents of good quality that are no copies and hold no benchmark item go through all filters."""
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    labels = spark.read.parquet(f"{AT}/labels.parquet").where("quality = 1")
    long = docs.join(labels, "doc_id", "left_semi").where("size(split(text, ' ')) > 80")
    assert quality.accepted(long).count() == long.count()
    assert decontaminate.decontaminated(long, spark.read.parquet(f"{AT}/benchmark.parquet").where("false")).count() == long.count()
