"""Inverted index and vector cells: the same rows as by scoring everything, and less read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import cells, postings, retrieval, textindex
from docquarry.plans.fixtures import stored

SPARSE = "id long, sparse map<bigint,float>"


def zipf(n, seed, vocabulary=300, length=40):
    """Rows in which every one holds the same few tokens, and some hold rare ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        held = {0: float(rng.randrange(1, 40)), 1: 1.0}
        for _ in range(rng.randrange(0, length)):
            t = int(rng.paretovariate(0.7)) % vocabulary
            held[t] = held.get(t, 0.0) + rng.choice((0.5, 1.0, 2.0))
        out.append((i, held))
    return [*out, (n, {}), (n + 1, None), (n + 2, out[3][1]), (n + 3, out[3][1])]


def best(rows, queries, k):
    out = set()
    for q, asked in queries:
        scores = []
        for i, own in rows:
            if own and asked and asked.keys() & own.keys():
                scores.append((-sum(w * own.get(t, 0.0) for t, w in asked.items()), i))
        out |= {(q, i, round(-s, 5), r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize(("per_segment", "k"), [(100_000, 10), (200, 10), (200, 3), (200, 5000)])
def test_postings_find_what_scoring_finds(spark, per_segment, k):
    rows, queries = zipf(1500, 1), zipf(12, 2, length=15)
    docs = stored(spark.createDataFrame(rows, SPARSE).repartition(3))
    asked = stored(spark.createDataFrame(queries, SPARSE).withColumnRenamed("id", "query_id"))
    index = stored(postings.build_postings(docs, postings.segment_of("id", len(rows), per_segment), "id"))
    sizes = index.agg(F.max("n"), F.max(F.size("held")), F.count_distinct("segment")).first()
    assert sizes[0] == sizes[1] <= per_segment and (sizes[2] > 1) == (per_segment == 200)
    found = postings.sparse_top_k_postings(index, docs, asked, k, stored, "id")
    got = {(r.query_id, r.id, round(r.score, 5), r["rank"]) for r in found.rows.collect()}
    assert got == best(rows, queries, k)
    read, held = found.reach.agg(F.sum("n_read"), F.sum("n_held")).first()
    assert read < 0.7 * held if k <= 10 and per_segment > 200 else read <= held


def test_postings_edges(spark):
    docs = stored(spark.createDataFrame([(1, {5: 2.0}), (2, {6: 1.0}), (3, {})], SPARSE))
    index = stored(postings.build_postings(docs, F.lit(0), "id"))
    asked = spark.createDataFrame([(1, {5: 1.0, 9: 1.0}), (2, {9: 1.0}), (3, {}), (4, None), (5, {6: -1.0})], SPARSE)
    found = postings.sparse_top_k_postings(index, docs, asked.withColumnRenamed("id", "query_id"), 2, stored, "id")
    assert [tuple(r) for r in found.rows.collect()] == [(1, 1, 2.0, 1)]
    none = stored(postings.build_postings(docs.where("false"), F.lit(0), "id"))
    assert postings.sparse_top_k_postings(none, docs.where("false"), asked.withColumnRenamed("id", "query_id"), 2, stored, "id").rows.count() == 0


def clustered(n, seed=5, dims=24, groups=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    x = centres[rng.integers(0, groups, n)] + rng.normal(0, 0.12, (n, dims))
    return [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    rows = clustered(6000)
    rows += [(7000 + i, rows[11][1]) for i in range(30)]
    odd = [(8000, None), (8001, [0.0] * 24), (8002, [float("nan")] * 24), (8003, [None] + [1.0] * 23)]
    df = spark.createDataFrame(rows + odd, "id long, dense array<double>").repartition(4)
    index = cells.VectorCells(spark, f"{tmp_path_factory.mktemp('cells')}/index").build(df, "id", per_cell=100)
    asked = spark.createDataFrame([(i, v) for i, v in rows[:40]] + [(99, None), (98, [1.0])], "query_id long, vector array<double>")
    return df, index, asked


@pytest.mark.parametrize("block", [8192, 50])
def test_cells_find_what_scoring_finds(laid, block):
    df, index, asked = laid
    want = {tuple(r) for r in retrieval.dense_top_k_many(df, asked, 8, "id").collect()}
    top, reach = index.top_k(asked, 8, stored, block=block)
    assert {(r.query_id, r.id, r.score, r["rank"]) for r in top.collect()} == want and len(want) == 320
    read, held, n = reach.agg(F.sum("n_read"), F.sum("n_held"), F.count("*")).first()
    assert n == 40 and read < 0.3 * held


def test_cells_with_a_fixed_number_of_probes(laid):
    df, index, asked = laid
    want = {(r.query_id, r.id) for r in retrieval.dense_top_k_many(df, asked, 8, "id").collect()}
    top, reach = index.top_k(asked, 8, stored, probes=2)
    got = {(r.query_id, r.id) for r in top.collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert reach.agg(F.sum("n_read") / F.sum("n_held")).first()[0] < 0.15


def test_cells_grow(spark, laid, tmp_path):
    rows = clustered(800, seed=6)
    schema = "id long, dense array<double>"
    index = cells.VectorCells(spark, f"{tmp_path}/index").build(spark.createDataFrame(rows[:500], schema), "id", per_cell=50)
    index.append(spark.createDataFrame(rows[500:], schema), "id")
    asked = spark.createDataFrame([(i, v) for i, v in rows[490:520]], "query_id long, vector array<double>")
    want = {tuple(r) for r in retrieval.dense_top_k_many(spark.createDataFrame(rows, schema), asked, 5, "id").collect()}
    assert {(r.query_id, r.id, r.score, r["rank"]) for r in index.top_k(asked, 5, stored)[0].collect()} == want
    with pytest.raises(ValueError):
        index.build(spark.createDataFrame(rows, schema), "id")
    with pytest.raises(ValueError):
        cells.VectorCells(spark, f"{tmp_path}/other").build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema), "id")


def test_substrings_equal_a_scan(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé需求") for _ in range(rng.randrange(0, 12))) for _ in range(400)] + [None, "", "ab", "aaaaaa"] * 3
    rows = stored(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, path string"))
    asked = ["abc", "aaaa", "需求a", "é需求é", "ab", "", "zzz", "a" * 20, "b%_"]
    for per_segment in (4096, 50):
        index = stored(textindex.build_grams(rows, "path", per_segment))
        assert index.agg(F.max(F.size("held"))).first()[0] <= max(per_segment * 2, 100)
        for a in asked:
            got = sorted(r.id for r in textindex.find_substring(index, rows, "path", a).collect())
            assert got == [i for i, t in enumerate(texts) if t is not None and a in t]
        many = spark.createDataFrame([(a, a) for a in asked if len(a) >= 3], "query_id string, asked string")
        got = {(r.query_id, r.id) for r in textindex.find_substrings(index, rows, "path", many).collect()}
        assert got == {(a, i) for a in asked if len(a) >= 3 for i, t in enumerate(texts) if t and a in t}


def test_many_substrings_meet_few_texts(spark):
    """Queries that share a frequent start meet texts by what they ask, not each other's texts."""
    rows = stored(spark.createDataFrame([(i, f"Doc {i} oc {i % 7}") for i in range(3000)] + [(9000, None), (9001, "oc")], "id long, path string"))
    index = stored(textindex.build_grams(rows, "path"))
    asked = [f"oc {i}" for i in range(0, 3000, 5)] + ["oc x", "Doc", "c 2 oc 2"]
    many = spark.createDataFrame([(a, a) for a in asked], "query_id string, asked string")
    found = textindex.find_substrings(index, rows, "path", many)
    got = sorted((r.query_id, r.id) for r in found.collect())
    assert got == sorted((a, i) for a in asked for i in range(3000) if a in f"Doc {i} oc {i % 7}")
    assert {"id", "path", "query_id", "asked"} == set(found.columns)
    assert "contains" not in found._jdf.queryExecution().optimizedPlan().toString().lower()  # met by keys alone
