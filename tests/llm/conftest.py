import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Seeded texts with copies, near copies, shared passages, odd rows."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeéöñ") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, line = words(60), " ".join(words(30))
    texts = []
    for i in range(60):
        w = words(rng.randint(1, 150))
        if i % 7 == 0:
            k = rng.randint(0, len(w))
            w[k:k] = passage[rng.randint(0, 20) : rng.randint(40, 60)]
        text = " ".join(w)
        if i % 5 == 0:
            changed = line.split()
            if i % 10 == 0:
                changed[rng.choice([0, 29])] = rng.choice(vocab)
            text += "\n" + " ".join(changed) + "\n\n" + line.upper()
        texts.append(text)
    base = words(120)
    for i in range(40):
        w = base[:]
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += texts[:6] + ["", "\n\n", "one", "a b c d", "a b c d e", None, "x " * 400, "x " * 500, "tab\tand\r\nfeed  double", "é" * 50, "  lead and trail  "]
    return list(enumerate(texts))
