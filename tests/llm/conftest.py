"""Tables with the awkward rows that every operator must take."""
import random

import pytest

SCHEMA = "doc_id long, text string, key string, fp long, id long, n_words long, hashes string, shard int"


def edge_rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "épsilon", "ζ", "the", "of", "x|y", "9"]
    long_text = " ".join(rng.choice(words) for _ in range(30_000))
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "   ", "one", "one", long_text, long_text, passage + " tail a", "head " + passage, passage,
             "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q", "\n\nline\nline\n", "😀 emoji text"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, "no id"), (None, passage), (3, "one"), (3, "one"), (7, "shares the id of another text")]
    return [(i, t, "k", 1, 2, 3, None, 4) for i, t in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def work(spark):
    from patchlens.llm.common import Handoff
    return Handoff(spark)
