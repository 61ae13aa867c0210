"""Trained vectors against numpy, and rules from a table against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.functions import rules
from docquarry.operators import metadata, retrieval, rulebook, trained
from docquarry.operators.embedding import HashedTerms
from docquarry.plans.fixtures import fx, stored

FOLDER = "/root/testdata/sf0.001"


def terms_of(text):
    return re.findall("[a-z0-9]+|[一-鿿]{2,}", (text or "").lower())


def matrix(texts):
    """The BM25 matrix with rows of unit length, the features of its columns, and their weights."""
    feature = lambda t: zlib.crc32(t.encode()) & 0xFFFF
    counts = [Counter(map(feature, terms_of(t))) for t in texts]
    average = sum(sum(c.values()) for c in counts) / len(texts)
    df = Counter(f for c in counts for f in c)
    idf = {f: math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for f, n in df.items()}
    columns = sorted(df)
    out = np.zeros((len(texts), len(columns)))
    for i, c in enumerate(counts):
        for f, n in c.items():
            out[i, columns.index(f)] = idf[f] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(c.values()) / average))
        out[i] /= np.linalg.norm(out[i]) or 1.0
    return out, columns, idf


def planted(n=240, seed=3):
    """Texts of common and rare words; every fourth has a copy with a third of its words replaced and all in another order."""
    rng = random.Random(seed)
    common, rare = [f"the{i}" for i in range(25)], [f"word{i}" for i in range(4000)]
    texts = []
    for _ in range(n):
        texts.append([rng.choice(common) if rng.random() < 0.7 else rng.choice(rare) for _ in range(rng.randrange(30, 120))])
    pairs = []
    for i in range(0, n, 4):
        copy = [rng.choice(common + rare) if rng.random() < 0.33 else w for w in texts[i]]
        rng.shuffle(copy)
        pairs.append((i, len(texts)))
        texts.append(copy)
    return [" ".join(t) for t in texts], pairs


@pytest.fixture(scope="module")
def fitted(spark):
    texts, pairs = planted()
    docs = stored(spark.createDataFrame(list(enumerate([*texts, None, "", "zzz unseen"])), "id long, text string").repartition(4))
    some = docs.where(F.col("id") < len(texts))
    return texts, pairs, docs, some, trained.fit_terms(some, stored, dims=48, rounds=6)


def test_weights_and_directions(fitted):
    texts, _, _, _, model = fitted
    a, columns, idf = matrix(texts)
    assert all(abs(model.idf[f] - w) < 1e-9 for f, w in idf.items()) and np.count_nonzero(model.idf) == len(idf)
    assert np.allclose(model.matrix.T @ model.matrix, np.eye(48), atol=1e-8)
    held = np.linalg.norm(a @ model.matrix[columns]) ** 2
    best = (np.linalg.svd(a, compute_uv=False)[:48] ** 2).sum()
    assert 0.95 * best < held <= best + 1e-9


def test_vectors(fitted):
    texts, _, docs, _, model = fitted
    a, columns, _ = matrix(texts)
    rows = {r.id: r for r in model.embed(docs.withColumn("other", F.lit(1))).collect()}
    assert len(rows) == len(texts) + 3 and rows[0].other == 1
    for i in (0, 7, len(texts) - 1):
        want = a[i] @ model.matrix[columns]
        assert np.allclose(rows[i].dense, want / np.linalg.norm(want), atol=1e-5)
        assert {f: round(w, 4) for f, w in rows[i].sparse.items()} == {columns[j]: round(a[i, j], 4) for j in np.flatnonzero(a[i])}
    assert rows[len(texts)].dense is None and rows[len(texts) + 1].dense is None and rows[len(texts)].sparse == {}


def test_near_copies_are_found(fitted):
    """Of planted near copies the trained vectors put more first than the surrogate does."""
    _, pairs, _, some, model = fitted

    def recall(provider):
        rows = stored(provider.embed(some).select("id", "dense"))
        asked = rows.where(F.col("id").isin([a for a, _ in pairs])).select(F.col("id").alias("query_id"), F.col("dense").alias("vector"))
        found = retrieval.dense_top_k_many(rows, asked, 2, "id").where("query_id <> id").collect()
        return len({(r.query_id, r.id) for r in found} & set(pairs)) / len(pairs)

    mine, theirs = recall(model), recall(HashedTerms(48))
    assert mine > 0.9 and mine > theirs + 0.1, (mine, theirs)


def test_no_documents(spark):
    none = spark.createDataFrame([(1, None)], "id long, text string")
    model = trained.fit_terms(none, stored, dims=4)
    assert model.embed(none).first().dense is None and trained.term_statistics(none).count() == 0


def test_ten_thousand_rules(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé需") for _ in range(rng.randrange(3, 7))) for _ in range(10_000)]
    given = []
    for i, w in enumerate(words):
        kind, fold = rng.choice("xyz"), rng.random() < 0.3
        pattern = (w, f"{w}|{w[::-1]}", rf"{w[0]}\d+{w[1]}", rf"{re.escape(w[:2] + '.')}|{w}")[i % 4 if i % 50 == 2 else (0, 1, 3)[i % 3]]
        given.append((kind, i * 3, pattern, fold, f"v{i}"))
    rng.shuffle(given)
    texts = ["".join(rng.choice("abcdeéABCE需 1.") for _ in range(rng.randrange(0, 60))) for _ in range(150)] + [None, ""]
    book = rulebook.Rulebook.read(spark.createDataFrame(given, rulebook.RULES))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r for r in df.select("id", *(book.column(spark, k, F.col("text")).alias(k) for k in ("x", "y", "z", "none"))).collect()}
    ordered = sorted(given, key=lambda r: r[1])
    for i, text in enumerate(texts):
        for kind in "xyz":
            first = (r[4] for r in ordered if r[0] == kind and text is not None and re.search(r[2].lower() if r[3] and rulebook.keywords(r[2]) else r[2], text.lower() if r[3] and rulebook.keywords(r[2]) else text, re.I if r[3] else 0))
            assert got[i][kind] == next(first, None)
        assert got[i].none is None
    with pytest.raises(ValueError):
        rulebook.Rulebook.read(spark.createDataFrame(given, rulebook.RULES), most=100)


def test_fixed_rules_as_a_table(spark):
    """The library's own rules, read from a table, decide as its expressions do."""
    rows = [("artifact", i, p, False, v) for i, (p, v) in enumerate(rules.ARTIFACT_RULES)]
    rows += [("evidence", i, p, False, v) for i, (p, v) in enumerate(rules.EVIDENCE_RULES)]
    rows += [("status", i, "|".join(ws), False, v) for i, (v, ws) in enumerate(rules.STATUS_RULES)]
    rows += [("term", i, "|".join(ws), True, v) for i, (v, ws) in enumerate(rules.TERM_RULES)]
    book = rulebook.Rulebook.read(spark.createDataFrame(rows, rulebook.RULES))
    docs = fx(spark, FOLDER)
    pairs = {
        "artifact": (F.col("body"), rules.first_match(F.col("body"), rules.ARTIFACT_RULES)),
        "evidence": (F.col("body"), rules.first_match(F.col("body"), rules.EVIDENCE_RULES)),
        "status": (F.col("body"), rules.first_keyword(F.col("body"), rules.STATUS_RULES)),
        "term": (F.col("file_path"), metadata.term_of(F.col("file_path"))),
    }
    for kind, (text, want) in pairs.items():
        got = docs.select(book.column(spark, kind, text).alias("got"), want.alias("want")).collect()
        assert len(got) == 200 and all(r.got == r.want for r in got) and any(r.got for r in got)
