"""Language ID against a prediction in plain Python, machine by machine, and the machines against their optimum."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from docquarry.llm import langid, queries

FOLDER = "/root/testdata/sf0.01"


def grams(text):
    """Buckets of the byte 2- and 3-grams, counted in a dict: one byte after another."""
    fold = [0] * 256
    for b in range(256):
        if 97 <= b <= 122 or b >= 128:
            fold[b] = b
        elif 65 <= b <= 90:
            fold[b] = b + 32
    data = [fold[b] for b in b" " + text.encode() + b" "]
    found, mask = Counter(), (1 << 32) - 1
    for i in range(len(data) - 1):
        two = data[i] * 257 + data[i + 1]
        if data[i] or data[i + 1]:
            found[(two * 2654435761 & mask) >> 20] += 1
        if i + 2 < len(data) and (data[i] or data[i + 2]):  # not a lone letter between blanks
            found[((two * 263 + data[i + 2] + 77) * 2246822519 & mask) >> 20] += 1
    return found


def sure(margin):
    return 1 / (1 + math.exp(-4 * max(-10, min(10, margin))))


def predicted(model, text):
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    found = grams(text)
    norm = math.sqrt(sum(found.values()))
    row = {g: math.sqrt(n) / norm for g, n in found.items()}

    def margin(w):
        return sum(w[g] * v for g, v in row.items()) + w[-1]

    family, score = 0, 1.0
    if model.roots is not None:
        margins = [margin(w) for w in model.roots]
        family = margins.index(max(margins))
        score = sure(max(margins))
    langs = model.families[family]
    votes, worst = dict.fromkeys(langs, 0.0), dict.fromkeys(langs, math.inf)
    for (a, b), w in model.pairs.items():
        if a in langs:
            m = margin(w)
            for lang, side in ((a, m), (b, -m)):
                votes[lang] += (side > 0) + 0.25 * math.tanh(side) / len(langs)
                worst[lang] = min(worst[lang], side)
    best = max(langs, key=lambda x: votes[x])
    return best, score * (1.0 if math.isinf(worst[best]) else sure(worst[best]))


def test_registered_query_equals_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs, ~langid.held_out())
    assert len(model.families) > 1 and model.pairs
    got = {r.doc_id: r for r in queries.op3_language_id(spark, FOLDER).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right, of = Counter(), Counter()
    for r in rows:
        lang, score = predicted(model, r.text)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-4
        if got[r.doc_id].held_out:
            of[r.lang] += 1
            right[r.lang] += got[r.doc_id].lang_pred == r.lang
    assert len(of) == 4 and all(right[x] >= 0.97 * of[x] for x in of), (right, of)


def test_odd_texts_equal_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.where("doc_id < 400"), F.lit(True), per_language=60)
    texts = ["a", "É", " b ", "日本語", "x" * 5000, "1 2 3", "", None, "the\x00end", "Straße und Öl", "\n\n.", "ÀÉÎ" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.identify(rows, model).collect():
        lang, score = predicted(model, r.text)
        assert r.language.lang_pred == lang and abs(r.language.score - score) < 1e-4


def test_machines_are_near_their_optimum():
    """The primal objective is within a few percent of the dual one, which bounds the optimum from below."""
    rng = np.random.default_rng(3)
    for n, shift in ((200, 0.3), (400, 0.1)):
        y = np.where(rng.random(n) < 0.3, 1.0, -1.0)
        x = rng.normal(size=(n, 40)) + shift * y[:, None]
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        weight = np.where(y > 0, n / (2 * (y > 0).sum()), n / (2 * (y < 0).sum()))
        w = langid.fit_svm(x, y, epochs=200)
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
        primal = w @ w / 2 + (weight * slack**2).sum()
        alpha = 2 * weight * slack  # the dual variables that the optimum would have
        v = np.r_[(alpha * y) @ x, (alpha * y).sum()]
        dual = alpha.sum() - v @ v / 2 - (alpha**2 / (4 * weight)).sum()
        assert dual <= primal * (1 + 1e-6) and primal - dual < 0.02 * primal
        few = langid.fit_svm(x, y)
        slack = np.maximum(0, 1 - y * (x @ few[:-1] + few[-1]))
        assert few @ few / 2 + (weight * slack**2).sum() < 1.1 * primal


def test_counts_of_grams_agree():
    found = defaultdict(int, grams("Straße 1"))
    raw = np.frombuffer(b" " + "Straße 1".encode() + b" ", np.uint8)
    counted = np.bincount(langid._grams(raw), minlength=langid.DIM)
    assert {int(i): int(counted[i]) for i in np.flatnonzero(counted)} == dict(found)
