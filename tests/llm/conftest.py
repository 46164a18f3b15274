import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; they must not clash with columns of the input.
CLASHING = "doc_id long, text string, source string, family long, component string, rs string, shingles string, bucket string, kept int, side int, toxic_score string, quality_score string, votes_bad string, pieces string, cluster string, n_tokens string, score string"


@pytest.fixture(scope="session")
def docs(spark):
    """A function from (id, text[, source]) rows to a documents table."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def clashing(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "s", 5, "x", "x", "x", "x", 0, 9, "x", "x", "x", "x", "x", "x", "x") for i, t in rows], CLASHING)

    return make


def word_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, nulls, empties, one very long text, ties."""
    rng = random.Random(4)
    base = [word_text(rng, rng.randrange(3, 160)) for _ in range(40)]
    passage = word_text(rng, 60)
    rows = list(base)
    for t in base[:12]:
        ws = t.split()
        for k in range(4):
            cut = list(ws)
            for _ in range(k):
                cut[rng.randrange(len(cut))] = f"e{rng.randrange(9)}"
            rows.append(" ".join(cut))
    rows += [f"{word_text(rng, 20)} {passage} {word_text(rng, 10)}" for _ in range(8)]
    rows += [None, "", " \t\n", "one two", "ONE two", "ab" * 400, word_text(rng, 6000), "é ü 中文 😀 " * 40]
    rng.shuffle(rows)
    return list(enumerate(rows))
