"""Search in batches equals single searches."""

import pytest
from pyspark.sql import functions as F

from docquarry.operators import batch, retrieval
from docquarry.operators.embedding import HashedTerms, embed_query
from docquarry.plans.fixtures import metadata, stored

FOLDER = "/root/testdata/sf0.001"
ASKED = [
    ("a", "《概要设计》 latency FR-1"), ("b", "latency module"), ("c", "软件需求规格说明书_12.md 12ms"), ("d", "no such words zzz"), ("e", ""),
    ("f", "\"测试报告\" TC-2 SD-1"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return stored(HashedTerms(16).embed(metadata(spark, FOLDER)))


@pytest.mark.parametrize(
    "params",
    [
        {"phase": "design", "quality_level": ["high"]},
        {"term": "春季", "project_id": "src0", "use_reranker": False, "same_project": True},
        {"mode": "dense", "doc_type": "概要设计"},
    ],
)
def test_batch_equals_single_searches(spark, rows, params):
    vectors = {q: embed_query(spark, HashedTerms(16), text) for q, text in ASKED}
    given = [(q, text, *vectors[q]) for q, text in ASKED]
    queries = stored(spark.createDataFrame(given, "query_id string, query string, dense array<double>, sparse map<bigint,float>"))
    hits = batch.search_many(rows, queries, stored, **params).collect()
    got = {q: [] for q, _ in ASKED}
    for r in sorted(hits, key=lambda r: (r.query_id, r.place)):
        got[r.query_id].append((r.chunk_uuid, r.composite_score, r.why_hit, r.metadata.section_path))
    for q, text in ASKED[:4] if "mode" in params else ASKED:
        single = retrieval.search(rows, text, *vectors[q], **params).collect()
        assert [(r.chunk_uuid, r.composite_score, r.why_hit, r.metadata.section_path) for r in single] == got[q]
    assert len(hits) > 60


def test_file_names_of_many_queries(spark, rows):
    queries = spark.createDataFrame(ASKED, "query_id string, query string")
    many = batch.docname_recall_many(rows, queries).collect()
    for q, text in ASKED:
        got = {(r.chunk_uuid, r._score, r.docname_score, r.docname_reason) for r in many if r.query_id == q}
        assert got == {tuple(r) for r in retrieval.docname_recall(rows, text).collect()}
    assert {r.query_id for r in many} == {"a", "c", "f"}


def test_no_queries(spark, rows):
    none = spark.createDataFrame([], "query_id string, query string, dense array<double>, sparse map<bigint,float>")
    assert batch.search_many(rows, none, stored).count() == 0
    one = none.unionByName(spark.createDataFrame([("x", "latency", [0.0] * 16, {})], none.schema))
    assert batch.search_many(rows.where(F.lit(False)), stored(one), stored).count() == 0
