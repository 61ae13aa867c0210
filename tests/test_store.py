"""The store: snapshots, commits in one step, writers at the same time, failures in between."""

import threading

import pytest
from pyspark.sql import functions as F

from docquarry import service
from docquarry.operators import store as stores
from docquarry.operators.store import ChunkStore, Conflict
from docquarry.sources import shared

SCHEMA = "chunk_uuid string, document_id string, source_file string, chunk_index int, text string, phase string, dense array<float>"


def rows(spark, name: str, n: int = 3, word: str = "x"):
    return spark.createDataFrame(
        [(f"{name}-{i}", name, name, i, f"{word} {i}", "design", [1.0, 2.0]) for i in range(n)], SCHEMA
    )


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "source_file string")


def texts(store, version=None):
    return sorted((r.source_file, r.text) for r in store.read(version).collect())


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, f"{tmp_path}/store", buckets=4)


def test_read_is_a_scan(spark, store):
    store.commit(rows(spark, "a"))
    store.commit(rows(spark, "b"), named(spark, "b"))
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan
    assert store.read().count() == 6 and store.exists()


def test_replacing_touches_only_folders_that_hold_it(spark, store):
    names = [f"f{i}" for i in range(12)]
    for n in names:
        store.commit(rows(spark, n))
    before = store.snapshot()
    after = store.commit(rows(spark, "f3", 2, "new"), named(spark, "f3", "unknown"))
    assert len(set(before.folders) - set(after.folders)) == 1 and after.version == before.version + 1
    assert texts(store) == sorted([(n, f"x {i}") for n in names if n != "f3" for i in range(3)] + [("f3", "new 0"), ("f3", "new 1")])
    merged = store.merge_folders(1)
    assert len(merged.folders) <= 4 and texts(store) == texts(store, after.version)
    assert store.delete("f4") == 3 and store.delete("f4") == 0 and len(texts(store)) == 32


def test_snapshots_and_vacuum(spark, store):
    store.commit(rows(spark, "a", 2))
    reader = store.read()
    store.commit(rows(spark, "a", 1, "new"), named(spark, "a"))
    assert reader.count() == 2 and texts(store) == [("a", "new 0")] and len(texts(store, 1)) == 2
    assert store.vacuum() >= 1 and texts(store) == [("a", "new 0")] and store.vacuum() == 0
    with pytest.raises(FileNotFoundError):
        store.snapshot(1)


@pytest.mark.parametrize("step", ["put_if_absent", "_report"])
def test_a_failure_before_the_step_changes_nothing(spark, store, monkeypatch, step):
    service.upload(store, "a.md", b"# A\n" + b"alpha text. " * 20)
    before = store.snapshot(), texts(store)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(shared if step == "put_if_absent" else ChunkStore, step, fail)
        with pytest.raises(OSError):
            service.upload(store, "a.md", b"# B\n" + b"beta text. " * 20)
    assert (store.snapshot(), texts(store)) == before and store.reports().count() == 1
    service.upload(store, "a.md", b"# C\n" + b"gamma text. " * 20)
    assert all("gamma" in t for _, t in texts(store)) and store.reports().count() == 2
    assert store.vacuum() > 0 and all("gamma" in t for _, t in texts(store))


def test_writers_at_the_same_time(spark, store):
    """All of them write one file and one of their own; the versions are one after the other, and nothing is lost or mixed."""
    store.commit(rows(spark, "shared", 4, "w0"))
    errors = []

    def write(k):
        try:
            own = rows(spark, f"own{k}").unionByName(rows(spark, "shared", k, f"w{k}"))
            ChunkStore(spark, store.path).commit(own, named(spark, "shared", f"own{k}"))
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and store.snapshot().version == 5
    got = texts(store)
    assert [t for f, t in got if f.startswith("own")] == [f"x {i}" for _ in range(4) for i in range(3)]
    of = [t.split()[0] for f, t in got if f == "shared"]
    assert len(set(of)) == 1 and len(of) == int(of[0][1:])


def test_a_writer_that_expects_a_version_is_told(spark, store):
    base = store.commit(rows(spark, "a"))
    store.commit(rows(spark, "b"))
    with pytest.raises(Conflict):
        store.commit(rows(spark, "c"), expect=base.version)
    assert {f for f, _ in texts(store)} == {"a", "b"}


def test_the_step_is_taken_once(spark, tmp_path):
    path = f"{tmp_path}/m/1.json"
    assert shared.put_if_absent(spark, path, b"one") and not shared.put_if_absent(spark, path, b"two")
    assert shared.read_bytes(path) == b"one" and shared.names(f"{tmp_path}/m") == ["1.json"]
    (tmp_path / "m" / "x.tmp").write_bytes(b"two")
    assert not shared.rename_if_absent(spark, f"{tmp_path}/m/x.tmp", f"file://{path}")
    assert shared.rename_if_absent(spark, f"{tmp_path}/m/x.tmp", f"file://{tmp_path}/m/2.json")
    assert shared.read_bytes(path) == b"one" and shared.read_bytes(f"{tmp_path}/m/2.json") == b"two"


def test_a_document_of_many_chunks_is_in_many_buckets(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "TOGETHER", 8)
    store.commit(rows(spark, "long", 200).unionByName(rows(spark, "short", 8)))
    held = store._folders(store.snapshot().folders).groupBy("source_file").agg(F.count_distinct("bucket").alias("n"))
    assert {r.source_file: r.n for r in held.collect()} == {"long": 4, "short": 1}
    store.commit(gone=named(spark, "long"))
    assert {f for f, _ in texts(store)} == {"short"}
    copy = store.compact(f"{store.path}-copy", 2)
    assert texts(copy) == texts(store) and copy.snapshot().buckets == 2


def test_empty_store(spark, store):
    assert not store.exists() and store.read().count() == 0 and store.reports().count() == 0 and store.delete("x") == 0
    store.commit(rows(spark, "a", 0))
    assert not store.exists() and store.read().count() == 0
    with pytest.raises(ValueError):
        ChunkStore(spark, store.path, dims=3).commit(rows(spark, "a"))


def scanned(df) -> int:
    """Rows that the scan of a plan gives on, after row groups were skipped."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = df.select("*")
        again.collect()
        leaf = again._jdf.queryExecution().executedPlan().collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_filters_skip_row_groups(spark, store):
    """Files are sorted by the filter fields, and Bloom filters tell what other fields hold."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "16384")
    conf.set("parquet.block.size.row.check.min", "100")
    conf.set("parquet.page.size.row.check.min", "100")
    try:
        many = spark.range(20_000).selectExpr(
            "md5(CAST(id AS STRING)) AS chunk_uuid", "concat('doc', id DIV 50) AS document_id", "concat('f', id DIV 50) AS source_file",
            "CAST(id % 50 AS INT) AS chunk_index", "concat('phase', id % 7) AS phase", "concat('type', id % 11) AS doc_type", "repeat(md5(CAST(-id AS STRING)), 4) AS text",
        )
        store.commit(many)
    finally:
        for name in ("parquet.block.size", "parquet.block.size.row.check.min", "parquet.page.size.row.check.min"):
            conf.unset(name)
    rows = store.read()
    of_one = "c4ca4238a0b923820dcc509a6f75849b"  # of 1
    ids = range(20_000)
    for condition, matching in (
        ("phase = 'phase3'", sum(i % 7 == 3 for i in ids)),
        ("phase = 'phase3' AND doc_type = 'type4'", sum(i % 7 == 3 and i % 11 == 4 for i in ids)),
        ("source_file = 'f77'", 50),
        (f"chunk_uuid = '{of_one}'", 1),
    ):
        found = rows.where(condition)
        assert found.count() == matching and scanned(found.select("chunk_uuid", "phase", "source_file")) < 20_000 / 2


def test_sparse_search_over_the_stores_postings(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/store", buckets=3, indexed=True)
    asked = spark.createDataFrame([("q", {1: 1.0, 2: 3.0})], "query_id string, sparse map<bigint,float>")
    assert store.sparse_top_k(asked, 5).rows.count() == 0

    def batch(name, n, weight):
        return rows(spark, name, n).withColumn(
            "sparse", F.create_map(F.lit(1), F.col("chunk_index") + F.lit(weight), F.lit(2), F.lit(1.0)).cast("map<bigint,float>")
        )

    store.commit(batch("a", 40, 1))
    store.commit(batch("b", 30, 100).unionByName(rows(spark, "none", 5).withColumn("sparse", F.lit(None).cast("map<bigint,float>"))))
    got = store.sparse_top_k(asked, 3).rows.orderBy("rank").collect()
    assert [(r.chunk_uuid, r.score) for r in got] == [("b-29", 132.0), ("b-28", 131.0), ("b-27", 130.0)]
    store.commit(batch("b", 1, 500), named(spark, "b"))
    got = store.sparse_top_k(asked, 2).rows.orderBy("rank").collect()
    assert [(r.chunk_uuid, r.score) for r in got] == [("b-0", 503.0), ("a-39", 43.0)]
    assert ChunkStore(spark, store.path).snapshot().indexed and store.merge_folders(1).indexed
    store.vacuum()
    assert store.sparse_top_k(asked, 100).rows.count() == 41
    with pytest.raises(ValueError):
        ChunkStore(spark, f"{tmp_path}/plain").sparse_top_k(asked, 1)
