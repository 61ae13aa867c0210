"""The learned reranker on planted relevance: held out, against shared terms, and against numpy."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import ranker, retrieval


def planted(n, seed):
    """Queries; a relevant text has most of a query's words in order with others between, an irrelevant one all of them, scattered."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(n):
        query = rng.sample(words, rng.randrange(4, 9))
        good = []
        for w in query[: len(query) - rng.randrange(0, 2)]:
            good += [w, *([rng.choice(words)] if rng.random() < 0.3 else [])]
        filler = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        at = rng.randrange(len(filler))
        relevant = filler[:at] + good + filler[at:]
        worse = []
        for _ in range(5):
            scattered = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
            for w in query:
                scattered.insert(rng.randrange(len(scattered)), w)
            worse.append(" ".join(scattered))
        out.append((" ".join(query), " ".join(relevant), worse))
    return out


def plain(query, text):
    """The features in plain Python."""
    asked, own = (re.findall("[a-z0-9]+|[一-鿿]{2,}", (t or "").lower()) for t in (query, text))
    share = lambda a, b, n=lambda t: 1: sum(n(t) for t in a & b) / sum(n(t) for t in a) if a else 0.0
    pairs = lambda x, d: {f"{a} {b}" for a, b in zip(x, x[d:], strict=False)}
    return [
        share(set(asked), set(own)), share(set(asked), set(own), len), share(pairs(asked, 1), pairs(own, 1)),
        share(pairs(asked, 1), pairs(own, 1) | pairs(own, 2)), sum(t in asked for t in own) / max(1, len(own)),
        float(bool(query) and query.lower() in (text or "").lower()), 1 / (1 + math.log1p(len(own))),
    ]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(q, good, bad) for q, good, worse in planted(150, 1) for bad in worse]
    return ranker.fit_ranker(spark.createDataFrame(rows, "query string, better string, worse string").repartition(4))


def test_features_and_scores_equal_plain_python(spark, fitted):
    cases = [("A b", "a B c"), ("", "x"), (None, "x"), ("x y z", None), ("测试 报告", "测试报告 测试 x 报告"), ("a a b", "a b a b"), ("q", "")]
    cases += [(q, t) for q, good, worse in planted(20, 5) for t in (good, *worse)]
    df = spark.createDataFrame(cases, "query string, text string").repartition(3)
    score = fitted.score(F.col("query"), F.col("text"))
    for r in df.select("*", ranker.features(F.col("query"), F.col("text")).alias("x"), score.alias("score")).collect():
        want = plain(r.query, r.text)
        assert np.allclose(r.x, want) and abs(r.score - 1 / (1 + math.exp(-np.clip(np.dot(want, fitted.weights), -30, 30)))) < 1e-9


def test_weights_are_the_optimum(fitted):
    x = np.array([np.subtract(plain(q, good), plain(q, bad)) for q, good, worse in planted(150, 1) for bad in worse])
    p = 1 / (1 + np.exp(-x @ fitted.weights))
    assert np.abs(x.T @ (1 - p) / len(x) - 1e-3 * fitted.weights).max() < 1e-6


def test_held_out_ranking_beats_shared_terms(spark, fitted):
    def first(scorer):
        right = 0
        for i, (query, good, worse) in enumerate(planted(12, 2)):
            texts = [*worse[:i % 5], good, *worse[i % 5 :]]
            rows = spark.createDataFrame([(k, t, k + 1, 0.0) for k, t in enumerate(texts)], "id int, text string, seq int, docname_score double")
            best = retrieval.rerank(rows, query, scorer, keep=3).orderBy("seq").first()
            right += best.text == good
        return right

    assert first(fitted.score) >= 11 > 6 > first(retrieval.token_overlap)


def test_no_pairs(spark):
    model = ranker.fit_ranker(spark.createDataFrame([], "query string, better string, worse string"))
    assert not model.weights.any()
