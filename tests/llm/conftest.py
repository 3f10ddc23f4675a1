import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a table of documents from (doc_id, text[, lang[, source]])."""

    def make(*rows):
        return spark.createDataFrame([(r[0], r[1], *(list(r[2:]) + [None] * 2)[:2], len(r[1] or "")) for r in rows], SCHEMA)

    return make


@pytest.fixture
def prose():
    """Makes texts of invented words; the same seed gives the same text."""

    def make(seed, words=60, vocabulary=400):
        rng = random.Random(seed)
        pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(vocabulary)]
        return " ".join(rng.choice(pool) for _ in range(words))

    return make


#: Columns whose names the operators use themselves.
CLASHING = ("n_words", "kept", "score", "size", "root", "key", "node", "first", "digest", "copies", "doc", "rate", "ids", "n_tokens", "target", "shard")


@pytest.fixture
def clashing():
    from pyspark.sql import functions as F

    return lambda df: df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
