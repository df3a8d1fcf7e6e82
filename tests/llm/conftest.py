import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, n int, component long, ids string, quality string, held_out string, _of string"


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice(WORDS[:vocabulary]) for _ in range(n))


_rng = random.Random(7)
WORDS = ["the", "of", "and", "to", *("".join(_rng.choice("abdeiklmnorstuéß") for _ in range(_rng.randint(2, 9))) for _ in range(800))]


def texts():
    """Prose with exact and near copies, shared passages, periodic, short, empty and null texts."""
    rng = random.Random(11)
    out = [prose(rng, rng.randint(60, 300), 800) for _ in range(30)]
    out += [out[3], out[3], out[4]]
    for k in range(12):
        w = out[5].split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    passage = prose(rng, 60)
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(6)]
    out += ["x y z " * 40, "a " * 200, "one two three", "ONE two THREE", "", "   \n\t ", None, None, "line\nline\nother\n\nline", f"{prose(rng, 20_000, 800)}", "é" * 3000, "  a  b\x0b\x1cc\x85d\xa0e "]
    return out


@pytest.fixture(scope="session")
def docs():
    return list(enumerate(texts()))


@pytest.fixture(scope="session")
def table(spark, docs):
    """The texts, with further columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), -1, "k", -2, -3, "i", "q", "h", "o") for d, t in docs], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nulls(spark):
    """Null identifiers and repeated rows."""
    text = prose(random.Random(3), 80)
    rows = [(None, text), (None, None), (5, text), (5, text), (6, None), (7, ""), (7, "another text of a few words")]
    return spark.createDataFrame([(d, t, *[None] * 11) for d, t in rows], SCHEMA)
