import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, key string, shard int, block int, component string"


def make_docs() -> list[tuple]:
    """Exact and near copies, shared passages, nulls, empty and long texts, ties; columns that clash with inner names."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "straße", "日本", "naïve"]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    shared, base, hot = words(30), words(120), words(60)
    texts = [None, "", " \t\n ", "one", "one two three", "123 456 !!!", " ".join(words(6000))]
    for i in range(30):
        near = list(base)
        for _ in range(i % 4):
            near[rng.randrange(len(near))] = "changed"
        texts += [" ".join(near), "\n".join(words(rng.randrange(5, 80)))]
        if i % 3 == 0:
            body = words(40)
            texts.append("  ".join(body[:20] + shared[: 10 + i] + body[20:]))
    texts += [" ".join(hot)] * 40 + [" ".join(hot).upper()] * 5 + ["One two three"] * 3
    ids = rng.sample(range(-50, 5000), len(texts))
    return [(d, t, ("en", "fr", None)[d % 3], (None, "a", "b", "c")[min(3, d % 7)], len(t or ""), 1, "k", 2, 3, "x") for d, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
