import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, component_id string, kept string, quality_score string, id string, salt string"


def rows(texts):
    return [(i, t, "en", "s", None, "clash", "clash", "clash", "clash", "clash", "clash") for i, t in texts]


def edge_texts():
    """Nulls, empty and very long texts, repeated rows, odd characters."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(60_000))
    return [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id\tat all"), (4, long), (5, "漢字🎉  <|endoftext|> <s> \x00 ﬁ é\r\n"), (6, "x" * 50_000), (-7, "   "), (8, "one")]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(edge_texts()), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
