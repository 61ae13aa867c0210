"""A learned reranker: a linear model over features of query and text, fitted on pairs of a better and a worse text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .embedding import terms

#: What a query and a text are compared by.
FEATURES = ("terms", "letters", "pairs", "near_pairs", "density", "phrase", "shortness")
#: Pairs that a model is fitted on, at most.
PAIRS = 50_000


def _neighbours(found: Column, apart: int) -> Column:
    """Each term joined with the one ``apart`` places on."""
    after = F.transform(found, lambda _, i: F.get(found, i + apart))
    joined = F.zip_with(found, after, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(joined, lambda x: x.isNotNull()))


def _share(asked: Column, own: Column, weight=None) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, t: s + (weight(t) if weight else F.lit(1.0)))
    return F.when(F.size(asked) > 0, total(F.array_intersect(asked, own)) / total(asked)).otherwise(0.0)


def features(query: Column, text: Column) -> Column:
    """array<double> of FEATURES: shares of the query's terms, of their letters, of its pairs of neighbours that the text holds
    side by side and at most one term apart; the share of the text that is the query's terms; whether it holds the query
    as it is; how short it is. A null text has none of anything."""
    low = F.coalesce(F.lower(text), F.lit(""))

    def measured(asked, own):
        distinct = F.array_distinct(asked)
        pairs, side = _neighbours(asked, 1), _neighbours(own, 1)
        near = F.array_union(side, _neighbours(own, 2))
        held = F.size(F.filter(own, lambda t: F.array_contains(distinct, t)))
        phrase = F.lower(F.coalesce(query, F.lit("")))
        return F.array(
            _share(distinct, own),
            _share(distinct, own, lambda t: F.length(t).cast("double")),
            _share(pairs, side),
            _share(pairs, near),
            held / F.greatest(F.size(own), F.lit(1)),
            ((phrase != "") & low.contains(phrase)).cast("double"),
            1 / (1 + F.log1p(F.size(own).cast("double"))),
        )

    return let(terms(F.coalesce(query, F.lit(""))), lambda asked: let(terms(low), lambda own: measured(asked, own)))


@dataclass
class Ranker:
    """Weights of FEATURES; a text's score is their sum through the logistic function."""

    weights: np.ndarray

    def score(self, query: Column, text: Column) -> Column:
        """A scorer for ``rerank`` and ``search``, in the JVM alone: the weights are constants of the expression."""
        held = F.array(*(F.lit(float(w)) for w in self.weights))
        total = F.aggregate(
            F.zip_with(features(query, text), held, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x
        )
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def fit_ranker(pairs: DataFrame, ridge: float = 1e-3, rounds: int = 50) -> Ranker:
    """Weights by which the better text of each pair (query, better, worse) most likely comes before the worse: logistic
    regression on the differences of their features, by Newton steps. Features are made on the executors; of more than
    PAIRS pairs those of smallest hash are fitted on."""
    mark = F.xxhash64("query", "better", "worse")
    drawn = pairs.orderBy(mark, "query", "better", "worse").limit(PAIRS) if pairs.count() > PAIRS else pairs
    apart = F.zip_with(
        features(F.col("query"), F.col("better")), features(F.col("query"), F.col("worse")), lambda a, b: a - b
    )
    rows = drawn.select(apart.alias("x")).toArrow()["x"].combine_chunks()
    x = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if len(rows) else np.zeros((0, len(FEATURES)))
    w = np.zeros(len(FEATURES))
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (1 - p) / len(x) - ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return Ranker(w)
