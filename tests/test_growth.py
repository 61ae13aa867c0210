"""What a query shuffles, writes and holds grows no faster than its input."""

import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.operators import batch, cells, filters, retrieval
from docquarry.operators.embedding import HashedTerms, embed_query
from docquarry.plans import queries as plans
from docquarry.plans.fixtures import metadata, stored

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def written(monkeypatch):
    """The tables that a query writes, by their plans."""
    seen = []

    def write(df):
        seen.append(df)
        return stored(df)

    monkeypatch.setattr(plans, "stored", write)
    return seen


def test_trace_expand_writes_no_texts(spark, written):
    assert plans.trace_expand(spark, FOLDER).count() > 0
    assert set(written[0].columns) == {"chunk_uuid", "project_id", "trace_links", "req_ids", "design_ids", "test_ids"}


@pytest.mark.parametrize("same_project", [False, True])
def test_a_frequent_id_is_cut_to_two_chunks_before_links_meet_it(spark, same_project):
    rows = [(f"{i:04d}", f"p{i % 2}", ["FR-1"], [], ["TC-1"] if i > 500 else None) for i in range(1000)]
    store = spark.createDataFrame(rows, "chunk_uuid string, project_id string, req_ids array<string>, design_ids array<string>, test_ids array<string>")
    links = spark.createDataFrame([("TC-1",), ("FR-9",), ("TC-1",)], "to string")
    got = {(r.chunk_uuid, r.own_field, r.to, r._hit) for r in retrieval.first_holders(store.repartition(5), links, same_project).collect()}
    if same_project:
        assert got == {("0502", "test_ids", "TC-1", 1), ("0504", "test_ids", "TC-1", 2), ("0501", "test_ids", "TC-1", 1), ("0503", "test_ids", "TC-1", 2)}
    else:
        assert got == {("0501", "test_ids", "TC-1", 1), ("0502", "test_ids", "TC-1", 2)}


def test_relaxed_recall_cuts_documents_of_its_project_only(spark, written):
    assert plans.relaxed_recall(spark, FOLDER).count() > 0
    assert set(written[0].columns) == {"chunk_uuid", *filters.EQUAL_FIELDS, "quality_level", "_confidence_overall"}
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "= src3)" in plan[plan.index("Generate ") :]  # below the cutting


@pytest.mark.parametrize("block", [1024, 8])
@pytest.mark.parametrize(("per_round", "k"), [(10_000, 5), (3, 5), (10_000, 500)])
def test_sparse_scores_are_cut_to_k_in_each_task(spark, monkeypatch, block, per_round, k):
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", per_round)
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rows = [(i, {t: float((i * 7 + t) % 5 - 1) for t in range(i % 9)} | {-(1 << 62): 0.5}) for i in range(300)]
    rows += [(300, {}), (301, None), (302, {1: None, 2: 2.0}), (303, {1: None}), (304, rows[8][1])]
    asked = [(i, {t: float(t - 2) for t in range(i, i + 3)}) for i in range(9)]
    asked += [(20, {-(1 << 62): 1.0}), (21, {}), (22, None), (23, {999: 1.0}), (24, {1: None, 2: 1.0}), (25, {t: 1.0 for t in range(200)})]
    schema = "id long, sparse map<bigint,float>"
    store = spark.createDataFrame(rows, schema).repartition(6)
    queries = spark.createDataFrame(asked, schema).withColumnRenamed("id", "query_id")
    want = set()
    for q, wanted in asked:
        wanted = {t: w for t, w in (wanted or {}).items() if w is not None}
        held = [(i, {t: w for t, w in (own or {}).items() if w is not None}) for i, own in rows]
        scores = sorted((-sum(w * own[t] for t, w in wanted.items() if t in own), i) for i, own in held if wanted.keys() & own.keys())
        want |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(scores[:k])}
    found = retrieval.sparse_top_k_many(store, queries, k, "id")
    got = found.collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert Counter(found.dtypes) == Counter([("query_id", "bigint"), ("id", "bigint"), ("score", "double"), ("rank", "int")])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs of rows and queries stay in their task


def test_sparse_without_rows_or_queries(spark):
    schema = "id long, sparse map<bigint,float>"
    store, none = spark.createDataFrame([(1, {1: 1.0})], schema), spark.createDataFrame([], schema)
    assert retrieval.sparse_top_k_many(store, none.withColumnRenamed("id", "query_id"), 3, "id").count() == 0
    assert retrieval.sparse_top_k_many(none, store.withColumnRenamed("id", "query_id"), 3, "id").count() == 0


def test_search_in_batches_shuffles_no_store(spark):
    rows = stored(HashedTerms(16).embed(metadata(spark, FOLDER)))
    asked = [("a", "《概要设计》 latency FR-1"), ("b", "latency module")]
    given = [(q, text, *embed_query(spark, HashedTerms(16), text)) for q, text in asked]
    queries = stored(spark.createDataFrame(given, "query_id string, query string, dense array<double>, sparse map<bigint,float>"))
    plan = []

    def write(df):
        plan.append(df._jdf.queryExecution().sparkPlan().toString())
        return stored(df)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = batch.search_many(rows, queries, write, phase="design", quality_level=["high"])
        plan.append(hits._jdf.queryExecution().sparkPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plan) == 3 and all("BroadcastHashJoin [chunk_uuid" in p and "SortMergeJoin [chunk_uuid" not in p for p in plan[1:])


def test_searches_write_what_they_read(spark, written):
    plans.search_batch(spark, FOLDER)
    assert set(written[0].columns) == set(plans.SEARCHED)


@pytest.mark.parametrize("turn", [1 << 15, 7])
def test_a_query_goes_to_a_group_of_cells_once(spark, tmp_path, monkeypatch, turn):
    """On vectors that fill their space evenly every query reads every cell."""
    monkeypatch.setattr(cells, "QUERIES", turn)
    x = np.random.default_rng(3).normal(size=(3000, 24))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, dense array<double>").repartition(3)
    index = cells.VectorCells(spark, f"{tmp_path}/index").build(df, "id", per_cell=20)
    asked = df.where("id < 40").select(F.col("id").alias("query_id"), F.col("dense").alias("vector"))
    routed = []

    def write(rows):
        routed.append(stored(rows))
        return routed[-1]

    top, reach = index.top_k(asked, 5, write)
    assert {tuple(r) for r in top.collect()} == {tuple(r) for r in retrieval.dense_top_k_many(df, asked, 5, "id").collect()}
    n, pairs = routed[-1].count(), routed[-1].agg(F.sum(F.size("cells"))).first()[0]
    assert n <= 40 * 13 and pairs > 5 * n and len(index.centres()) == 150
    assert reach.agg(F.min("n_held"), F.max("n_held")).first() == (3000, 3000)


def test_cells_make_groups_of_a_block():
    group, parts = cells._grouped(np.array([3, 3, 3, 25, 0, 4, 0, 10, 1]), 10)
    assert group.tolist() == [0, 0, 0, 1, 2, 2, 2, 3, 4] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1, 1]


def test_distances_to_centres_are_held_a_block_at_a_time(monkeypatch):
    x, centres = np.random.default_rng(4).normal(size=(5000, 4)), np.random.default_rng(5).normal(size=(500, 4))
    monkeypatch.setattr(cells, "NUMBERS", 50_000)
    tracemalloc.start()
    cell, own = cells._nearest(x, centres)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = x @ centres.T
    assert (cell == near.argmax(axis=1)).all() and np.allclose(own, near.max(axis=1)) and most < near.nbytes / 10


@pytest.mark.parametrize("block", [1024, 4, 1])
def test_sparse_blocks_of_any_size_agree(monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows, asked = ([{int(t): float(rng.integers(-2, 3)) for t in rng.integers(0, 30, rng.integers(0, 12))} for _ in range(n)] for n in (200, 9))
    lists = [(pa.array([list(r) for r in some], pa.list_(pa.int64())), pa.array([list(r.values()) for r in some], pa.list_(pa.float64()))) for some in (rows, asked)]
    line, token, weight = retrieval._entries(*lists[1])
    known, column = np.unique(token, return_inverse=True)
    order = np.lexsort((line, column))
    shared = SimpleNamespace(value=(known, np.searchsorted(column[order], np.arange(len(known) + 1)), line[order], weight[order], pa.array(range(9))))
    batch_ = pa.RecordBatch.from_arrays([pa.array(range(200)), *lists[0]], names=["id", "tokens", "weights"])
    found = pa.Table.from_batches(retrieval._token_top_k(shared, 4, "id")([batch_.slice(0, 90), batch_.slice(90)])).to_pylist()
    want = set()
    for q, a in enumerate(asked):
        scores = sorted((-sum(w * r[t] for t, w in a.items() if t in r), i) for i, r in enumerate(rows) if a.keys() & r.keys())
        want |= {(q, i, -s) for s, i in scores[:4]}
    assert {(r["query_id"], r["id"], r["score"]) for r in found} == want and len(found) == len(want) > 30
