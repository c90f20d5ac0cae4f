import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns that an operator might use as names of its own
CLASHING = ["id", "_id", "n", "hi", "lo", "key", "link", "shard", "place", "copy", "ids", "kept", "label", "_kept", "rank"]


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, lang, source]) as documents, with extra columns of clashing names if asked for."""

    def make(rows, clashing=False):
        full = [(r[0], r[1], *(r[2:] or ("en", "a")), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if clashing:
            df = df.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHING])
        return df

    return make


WORDS = "the and of to in that was for with his they this have from one had word all were when".split()


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = [rng.choice(WORDS) if rng.random() < 0.3 else f"w{rng.randrange(vocabulary)}x" for _ in range(n)]
    return " ".join(words)


LONG = prose(99, 60_000, 20_000)
ODD = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "a b c d",
    "\x00 \x0b\x0c\r\n\t x",
    "naïve Ünï côdé 日本語 🙂 Привет",
    "x" * 3000,
    "no\u00a0break\u2003space\x85next",
]
