"""The chunk store: keyed buckets of Parquet files under one manifest a version; ingest reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared
from .embedding import check_dimension
from .postings import Found, build_postings, sparse_top_k_postings

EDGES = T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType())]))
_STRINGS = T.ArrayType(T.StringType())
STORE = T.StructType([T.StructField(n, t) for n, t in (
    ("chunk_uuid", T.StringType()), ("document_id", T.StringType()), ("source_file", T.StringType()), ("file_path", T.StringType()), ("chunk_index", T.IntegerType()), ("course", T.StringType()), ("chunk_id", T.StringType()),
    ("year", T.IntegerType()), ("term", T.StringType()), ("project_id", T.StringType()), ("doc_type", T.StringType()), ("phase", T.StringType()), ("section_path", T.StringType()), ("artifact_type", T.StringType()),
    ("evidence_type", T.StringType()), ("status", T.StringType()), ("quality_level", T.StringType()), ("req_ids", _STRINGS), ("design_ids", _STRINGS), ("test_ids", _STRINGS), ("impl_refs", _STRINGS), ("keywords", _STRINGS),
    ("trace_links", EDGES), ("is_arch", T.BooleanType()), ("is_biz", T.BooleanType()), ("_confidence_overall", T.DoubleType()), ("_needs_review", T.BooleanType()), ("text", T.StringType()),
    ("dense", T.ArrayType(T.FloatType())), ("sparse", T.MapType(T.LongType(), T.FloatType())), ("version", T.LongType()),
)])


REPORT = """source_file string, document_id string, status string, error string, pages int, chunks_total long, chunks_summary_scoped long, chunks_inserted long,
needs_review_count long, has_term_pct double, has_phase_pct double, has_doc_type_pct double, needs_review_items array<struct<chunk_id:string,reason:string>>,
elapsed_seconds double"""
#: Chunks of one document that stay in one bucket; longer documents go on in the next ones.
TOGETHER = 4096
#: Rows of a file are sorted by these fields, so that a filter skips row groups by their statistics.
CLUSTERED = ("phase", "doc_type", "term", "project_id", "source_file", "chunk_index")
#: Fields whose Parquet Bloom filters let an equality skip row groups that their order does not.
BLOOM = ("source_file", "chunk_uuid", "document_id", "project_id")
_FOLDERS = "commit string, bucket int"
POSTINGS = "token long, level int, most double, n long, held array<struct<id:string,weight:double>>"


def document_key(path: Column) -> Column:
    """Deterministic document id: a path names one document, whatever it holds now."""
    return F.substring(F.sha2(path, 256), 1, 32)


def chunk_key(document_id: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", document_id, index.cast("string")), 256), 1, 32)


def upsert(stored: DataFrame, new: DataFrame, key: str = "chunk_uuid", version: str = "version") -> DataFrame:
    """Union in which the highest version of each key stays (the new row on a tie)."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def delete_by_source(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose source_file is not in ``gone`` (source_file); rows without one stay."""
    return stored.join(gone.select("source_file").distinct(), "source_file", "left_anti").select(*stored.columns)


def ingest_report(chunks: DataFrame, by: str = "document_id", shown: int = 20) -> DataFrame:
    """One row per document: chunk counts, the first ``shown`` review items and the share of filled fields, in one
    aggregation. The chunk ids of one document, which was one row itself, are gathered."""

    def filled(name):
        return F.bround(100 * F.count_if(F.coalesce(F.col(name), F.lit("")) != "") / F.count("*"), 1)

    summary = (
        F.col("section_path").contains("小结")
        | F.col("section_path").contains("总结")
        | F.col("section_path").contains("结论")
    )
    item = F.when(F.col("_needs_review"), F.struct("chunk_index", "chunk_id"))
    totals = chunks.groupBy(by).agg(
        F.count("*").alias("chunks_total"), F.count_if(summary).alias("chunks_summary_scoped"), F.count("*").alias("chunks_inserted"), F.count_if("_needs_review").alias("needs_review_count"),
        filled("term").alias("has_term_pct"), filled("phase").alias("has_phase_pct"), filled("doc_type").alias("has_doc_type_pct"), F.collect_list(item).alias("_items"),
    )
    named = F.transform(
        F.slice(F.array_sort("_items"), 1, shown),
        lambda x: F.struct(x.chunk_id.alias("chunk_id"), F.lit("low_confidence").alias("reason")),
    )
    return totals.withColumn("needs_review_items", named).drop("_items")


def batch_totals(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("chunks_inserted"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.sum("needs_review_count"), F.lit(0)).alias("total_review"),
    )


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Snapshot:
    """What one version of a store consists of: folders ``commit=<id>/bucket=<n>`` of chunks, and folders of reports."""

    version: int
    buckets: int
    folders: tuple[str, ...] = ()
    reports: tuple[str, ...] = ()
    indexed: bool = False


@dataclass
class ChunkStore:
    """A folder of chunks in buckets, and of manifests, one for each version, which name the folders that make it up.

    Folders are written once and never changed. A commit writes new folders beside the old ones, then puts the next
    manifest in place in one step that only one writer of a version can win; before that step nobody sees any of it.
    Readers take the newest manifest once and keep to its folders. A chunk's bucket follows from its document, so that
    replacing a document rewrites the few folders that hold it (copy on write), new documents add folders, and no
    other file is touched. Writers that lose the step start over from the manifest that won, with the new folders they
    have written already; replacing wins over what it replaces, whoever comes last. ``buckets`` holds for a new store:
    about one for each GB to come; the first manifest fixes it. So it is with ``indexed``: every folder of chunks then
    has a folder of postings, written before the commit, and comes and goes with it.
    """

    spark: SparkSession
    path: str
    dims: int | None = None
    buckets: int = 16
    indexed: bool = False

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an older one that has not been vacuumed."""
        found = [int(n[:-5]) for n in shared.names(f"{self.path}/manifests") if n.endswith(".json")]
        if not found and version is None:
            return Snapshot(0, self.buckets, indexed=self.indexed)
        told = json.loads(shared.read_bytes(self._manifest(max(found) if version is None else version)))
        return Snapshot(told["version"], told["buckets"], tuple(told["folders"]), tuple(told["reports"]), told["indexed"])

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:020d}.json"

    def exists(self) -> bool:
        return bool(self.snapshot().folders)

    def _folders(self, folders) -> DataFrame:
        """Chunks of some folders, with the columns commit and bucket."""
        schema = T.StructType([*STORE.fields, *T.StructType.fromDDL(_FOLDERS).fields])
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*(f"{self.path}/data/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The chunks of a snapshot: a scan of its folders, without a shuffle."""
        return self._folders(self.snapshot(version).folders).select(*STORE.fieldNames())

    def reports(self, version: int | None = None) -> DataFrame:
        """The report rows of all commits of a snapshot."""
        found = [f"{self.path}/reports/{r}" for r in self.snapshot(version).reports]
        rows = self.spark.read.schema(REPORT)
        return rows.parquet(*found) if found else self.spark.createDataFrame([], REPORT)

    def reports_of(self, done: Snapshot) -> DataFrame:
        """The report rows of the commit that ``done`` came of."""
        return self.spark.read.schema(REPORT).parquet(f"{self.path}/reports/{done.reports[-1]}")

    def _write(self, rows: DataFrame, indexed: bool) -> list[str]:
        """Write chunks (with the column bucket) to a new commit; returns its folders."""
        commit = f"commit={uuid.uuid4().hex}"
        # rebalancing splits a bucket that grew large and joins small ones
        dealt = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *CLUSTERED)
        writer = dealt.write.partitionBy("bucket")
        for field in BLOOM:
            writer = writer.option(f"parquet.bloom.filter.enabled#{field}", "true")
        writer.parquet(f"{self.path}/data/{commit}")
        folders = sorted(f"{commit}/{f}" for f in shared.folders(f"{self.path}/data/{commit}", 1))
        if indexed and folders:
            held = self._folders(folders).select("bucket", "chunk_uuid", "sparse")
            postings = build_postings(held, F.col("bucket")).withColumnRenamed("segment", "bucket")
            # a row for each bucket, so that one without tokens has a folder too
            marks = held.groupBy("bucket").agg(F.count("*").alias("n"))
            every = postings.unionByName(marks, allowMissingColumns=True)
            laid = every.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "level")
            laid.write.partitionBy("bucket").parquet(f"{self.path}/postings/{commit}")
        return folders

    def commit(
        self,
        chunks: DataFrame | None = None,
        gone: DataFrame | None = None,
        report: Callable[[DataFrame], DataFrame] | None = None,
        expect: int | None = None,
        retries: int = 8,
    ) -> Snapshot:
        """Add ``chunks``, in one step with the removal of all older chunks of the files in ``gone`` (source_file) and with
        the rows that ``report`` makes of the chunks as written.

        Vectors of another length than the store's raise; missing columns are null. With ``expect``, a version, the
        commit raises ``Conflict`` if the store has moved on from it; without, it is tried again on what won.
        """
        base = self.snapshot()
        added: list[str] = []
        if chunks is not None:
            if self.dims:
                check_dimension(chunks, self.dims)
            added = self._write(self._typed(chunks, base), base.indexed)
        written = self._folders(added)
        told = [self._report(report(written.select(*STORE.fieldNames())))] if report else []
        for _ in range(retries):
            if expect is not None and base.version != expect:
                raise Conflict(f"version {base.version} where {expect} was expected")
            touched, kept = self._without(base, gone) if gone is not None else (set(), [])
            folders = [f for f in base.folders if f not in touched] + kept + added
            done = Snapshot(base.version + 1, base.buckets, tuple(folders), (*base.reports, *told), base.indexed)
            content = json.dumps(done.__dict__).encode()
            if shared.put_if_absent(self.spark, self._manifest(done.version), content):
                return done
            base = self.snapshot()
        raise Conflict(f"other writers committed first {retries} times")

    def _typed(self, chunks: DataFrame, base: Snapshot) -> DataFrame:
        have = set(chunks.columns) - {"version"}
        rows = chunks.select(
            *(
                (F.lit(base.version + 1) if f.name == "version" else F.col(f.name) if f.name in have else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in STORE
            )
        )
        place = F.xxhash64("document_id", F.floor(F.coalesce("chunk_index", F.lit(0)) / TOGETHER))
        return rows.withColumn("bucket", F.pmod(place, F.lit(base.buckets)).cast("int"))

    def _without(self, base: Snapshot, gone: DataFrame) -> tuple[set[str], list[str]]:
        """(folders of ``base`` that hold chunks of ``gone``, new folders with the rest of their chunks)."""
        names = gone.select("source_file").distinct()
        rows = self._folders(base.folders)
        held = rows.select("commit", "bucket", "source_file").join(names, "source_file", "left_semi")
        touched = [f"commit={r[0]}/bucket={r[1]}" for r in held.select("commit", "bucket").distinct().collect()]
        if not touched:
            return set(), []
        rest = self._folders(touched).join(names, "source_file", "left_anti").select(*STORE.fieldNames(), "bucket")
        return set(touched), self._write(rest, base.indexed)

    def _report(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        schema = T.StructType.fromDDL(REPORT)
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)).write.parquet(
            f"{self.path}/reports/{name}"
        )
        return name

    def staged(self, df: DataFrame) -> DataFrame:
        """``df`` as a table beside the store, until the next ``vacuum``."""
        path = f"{self.path}/staging/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def sparse_top_k(self, queries: DataFrame, k: int, version: int | None = None) -> Found:
        """The ``k`` best chunks of a snapshot for every query (query_id, sparse), over its postings."""
        held = self.snapshot(version)
        if not held.indexed:
            raise ValueError("the store has no postings")
        if not held.folders:
            found = self.spark.createDataFrame([], f"{POSTINGS}, {_FOLDERS}")
        else:
            reader = self.spark.read.schema(f"{POSTINGS}, {_FOLDERS}").option("basePath", f"{self.path}/postings")
            found = reader.parquet(*(f"{self.path}/postings/{f}" for f in held.folders)).where("token IS NOT NULL")
        segments = found.withColumn("segment", F.concat_ws("/", "commit", F.col("bucket").cast("string")))
        rows = self._folders(held.folders).select("chunk_uuid", "sparse")
        return sparse_top_k_postings(segments, rows, self.staged(queries), k, self.staged)

    def delete(self, source_file: str) -> int:
        """Remove all chunks of a file; returns how many there were."""
        n = self.read().where(F.col("source_file") == source_file).count()
        if n:
            self.commit(gone=self.spark.createDataFrame([(source_file,)], "source_file string"))
        return n

    def merge_folders(self, most: int = 8) -> Snapshot:
        """Rewrite the buckets of more than ``most`` folders into one folder each, in one commit."""
        base = self.snapshot()
        of = {}
        for f in base.folders:
            of.setdefault(f.rpartition("=")[2], []).append(f)
        many = [f for fs in of.values() if len(fs) > most for f in fs]
        if not many:
            return base
        new = self._write(self._folders(many).select(*STORE.fieldNames(), "bucket"), base.indexed)
        while True:
            if not set(many) <= set(base.folders):
                raise Conflict("a folder that was merged has been replaced")
            folders = (*(f for f in base.folders if f not in set(many)), *new)
            done = Snapshot(base.version + 1, base.buckets, folders, base.reports, base.indexed)
            if shared.put_if_absent(self.spark, self._manifest(done.version), json.dumps(done.__dict__).encode()):
                return done
            base = self.snapshot()

    def vacuum(self, keep: int = 1) -> int:
        """Remove all but the newest ``keep`` manifests and every folder that these do not name, what failed commits left
        included; returns how many. For times without writers and without readers of older versions."""
        versions = sorted(int(n[:-5]) for n in shared.names(f"{self.path}/manifests") if n.endswith(".json"))
        held = [self.snapshot(v) for v in versions[-keep:]]
        live = {f"data/{f}" for s in held for f in s.folders} | {f"reports/{r}" for s in held for r in s.reports}
        live |= {f"postings/{f}" for s in held for f in s.folders if s.indexed}
        there = [f"{part}/{f}" for part in ("data", "postings") for f in shared.folders(f"{self.path}/{part}", 2)]
        there += [f"{part}/{f}" for part in ("reports", "staging") for f in shared.folders(f"{self.path}/{part}", 1)]
        dead = [f for f in there if f not in live]
        for folder in dead:
            shared.remove(f"{self.path}/{folder}")
        for v in versions[:-keep]:
            shared.remove_file(self._manifest(v))
        return len(dead)

    def compact(self, target: str, buckets: int | None = None) -> ChunkStore:
        """The current chunks as a new store, of another number of buckets if given."""
        held = self.snapshot()
        new = ChunkStore(self.spark, target, self.dims, buckets or held.buckets, held.indexed)
        new.commit(self.read())
        return new
