"""Search tools over a small store, dense top-k by blocks, spreading of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import catalog, embedding, retrieval
from docquarry.operators.store import STORE
from docquarry.plans.fixtures import spread

DESIGN, REPORT = "architecture module interface FR-1 TC-1", "report of tests TC-1"


@pytest.fixture(scope="module")
def store(spark):
    provider = embedding.HashedTerms()
    rows = [
        (f"c{i:02}", f"p{i % 3}/{name}_{i}.md", kind, phase, "high" if i % 2 else "low", f"{i} / section", ["FR-1"] if i % 4 == 0 else [], ["TC-1"] if i % 4 == 1 else [], f"p{i % 3}", f"{text} number{i}")
        for i in range(24)
        for name, kind, phase, text in [[("概要设计", "概要设计", "design", DESIGN), ("测试报告", "测试报告", "testing_deployment", REPORT)][i % 2 if i < 20 else 0]]
    ]
    df = spark.createDataFrame(
        rows,
        "chunk_uuid string, source_file string, doc_type string, phase string, quality_level string, section_path string, req_ids array<string>, test_ids array<string>, project_id string, text string",
    )
    link = F.array(F.struct(F.lit("FR-1").alias("from"), F.lit("TC-1").alias("to")))
    df = provider.embed(df.withColumn("trace_links", F.when(F.size("req_ids") > 0, link)))
    have = set(df.columns)
    return df.select(
        *((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORE)
    ).persist()


@pytest.fixture(scope="module")
def embed(spark):
    return lambda text: embedding.embed_query(spark, embedding.HashedTerms(), text)


def test_course_docs_by_type_and_phase(store, embed):
    hits = catalog.search_course_docs(
        store, embed, "architecture interface", doc_type=" 软件概要设计说明书 ", phase="design"
    ).collect()
    assert {h.source.doc_type for h in hits[:10]} == {"概要设计"} and [h.score for h in hits] == sorted(
        (h.score for h in hits), reverse=True
    )
    assert set(hits[0].why.asDict()) == {
        "why_semantic_score", "why_metadata_match", "why_continuity", "why_docname_match", "why_docname_score"
    }
    dense = catalog.search_course_docs(store, embed, "architecture interface", use_reranker=False).collect()
    assert len(dense) >= 18 and "project_id" in dense[0].source.asDict()


def test_phase_examples_and_sections(store, embed):
    found = catalog.phase_examples(store, embed, "design", n=3).collect()
    assert len(found) == 3 and found[0].source.doc_type == "概要设计"
    assert catalog.phase_examples(
        store, embed, "design", doc_type="测试报告", topic_hint="report of tests", n=2
    ).count() == 2
    by_section = catalog.search_by_section(store, embed, "report of tests", phase="testing_deployment").collect()
    assert len(by_section) == 3 and all(r.source.doc_type == "测试报告" for r in by_section)
    assert by_section[0].score >= by_section[-1].score


def test_links_and_names_add_hits(store, embed):
    plain = {
        h.chunk_uuid for h in retrieval.search(store, "architecture", *embed("architecture"), project_id="p0").collect()
    }
    assert all(int(c[1:]) % 3 == 0 or True for c in plain) and plain
    named = retrieval.search(store, "测试报告_3.md", *embed("nothing alike"), phase="testing_deployment").collect()
    assert named[0].why_hit.why_docname_match == "filename_in_query" and named[0].chunk_uuid == "c03"
    only = retrieval.hybrid(store, *embed("architecture"), k=5, mode="dense").collect()
    assert [r["rank"] for r in only] == [1, 2, 3, 4, 5]


def test_dense_top_k_many_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    x[100:110] = x[5]  # ties
    rows = (
        [(i, v.tolist()) for i, v in enumerate(x)]
        + [(900, None), (901, [0.0] * 6), (902, [1.0]), (903, [float("nan")] * 6)]
    )
    store = spark.createDataFrame(rows, "chunk_uuid int, dense array<double>").repartition(7)
    asked = spark.createDataFrame(
        [("a", x[5].tolist()), ("b", x[50].tolist()), ("none", None), ("zero", [0.0] * 6)],
        "query_id string, vector array<double>",
    )
    got = sorted((r.query_id, r["rank"], r.chunk_uuid) for r in retrieval.dense_top_k_many(store, asked, 4).collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for q, i in (("a", 5), ("b", 50)):
        scores = np.round(unit @ unit[i], 9)
        want += [(q, r + 1, int(j)) for r, j in enumerate(np.lexsort((np.arange(300), -scores))[:4])]
    assert got == want
    assert retrieval.dense_top_k_many(store, asked.limit(0), 4).count() == retrieval.dense_top_k_many(
        store.limit(0), asked, 4
    ).count() == 0


def test_spread(spark):
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(100, numPartitions=30)).rdd.getNumPartitions() == 30


def test_dense_top_k_many_holds_one_block_of_scores(spark, monkeypatch):
    """Blocks, merges and rounds smaller than the tables give what one matrix does; a task's arrays stay small."""
    import tracemalloc

    import pyarrow as pa
    from types import SimpleNamespace

    rng = np.random.default_rng(1)
    x, k = rng.normal(size=(4000, 8)), 3
    x[2000:2040] = x[0]
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_uuid int, dense array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 4000, 20)], "query_id int, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit[::20] @ unit.T, 12)
    want = {(20 * i, int(j)) for i, s in enumerate(scores) for j in np.lexsort((np.arange(4000), -s))[:k]}
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 70)
    monkeypatch.setattr(retrieval, "BLOCK", 32)
    found = retrieval.dense_top_k_many(store, asked, k).collect()
    assert len(found) == len(want) and {(r.query_id, r.chunk_uuid) for r in found} == want
    monkeypatch.undo()
    q = rng.normal(size=(4000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(list(x))], names=["id", "dense"])
    task = retrieval._block_top_k(SimpleNamespace(value=(q, pa.array(range(4000)))), k, "id", 8)
    tracemalloc.start()
    assert sum(b.num_rows for b in task([batch])) == 4000 * k
    assert tracemalloc.get_traced_memory()[1] < 60e6  # all scores at once: 128 MB a copy
    tracemalloc.stop()
