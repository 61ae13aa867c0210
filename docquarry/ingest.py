"""Ingestion: files -> pages -> chunks -> metadata -> vectors -> store, and the report of it."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.chunking import chunk_documents
from .operators.embedding import HashedTerms
from .operators.lines import first_heading
from .operators.metadata import with_metadata
from .operators.store import REPORT, ChunkStore, batch_totals, chunk_key, document_key, ingest_report
from .sources import shared
from .sources.files import full_text, read_files

COUNTS = ["chunks_total", "chunks_inserted", "chunks_summary_scoped", "needs_review_count"]


def chunk_files(files: DataFrame, override: dict | None = None, recompute: bool = False) -> DataFrame:
    """Chunks with metadata of parsed files (file_path, file_name, pages, error). The document id follows from the path
    and a chunk's id from document and place, so ingesting a file again replaces its chunks."""
    docs = files.where("error IS NULL AND size(pages) > 0").select(
        "file_path",
        F.col("file_path").alias("source_file"),
        full_text(F.col("pages")).alias("body"),
        F.size("pages").alias("pages"),
    )
    docs = docs.withColumns(
        {"document_id": document_key(F.col("file_path")), "first_heading": first_heading(F.col("body"))}
    )
    chunks = with_metadata(chunk_documents(docs), override=override, recompute=recompute)
    return chunks.withColumn("chunk_uuid", chunk_key(F.col("document_id"), F.col("chunk_index")))


def ingest(
    store: ChunkStore, files: DataFrame, provider=None, override: dict | None = None, recompute: bool = False
) -> DataFrame:
    """Write all files to the store; returns one report row per file: status ok, empty or error.

    Files are parsed once, into a table beside the store. Chunks, the removal of older chunks of the files that parsed,
    and the report are one commit: a reader sees a document's old text or its new one, and a job that fails leaves
    the store as it was. Files that failed or are empty change nothing, and no files make no commit.
    """
    began, staged = time.monotonic(), f"{store.path}/staging/{uuid.uuid4().hex}"
    files.write.parquet(staged)
    files = store.spark.read.schema(files.schema).parquet(staged)
    status = F.when(F.col("error").isNotNull(), "error").when(F.size("pages") == 0, "empty").otherwise("ok")
    rows = files.select(
        F.col("file_path").alias("source_file"),
        document_key(F.col("file_path")).alias("document_id"),
        status.alias("status"),
        "error",
        F.size("pages").alias("pages"),
    )

    def report(chunks: DataFrame) -> DataFrame:
        told = rows.join(ingest_report(chunks, by="source_file"), "source_file", "left").fillna(0, COUNTS)
        return told.withColumn("elapsed_seconds", F.lit(round(time.monotonic() - began, 3)))

    try:
        if files.isEmpty():
            return store.spark.createDataFrame([], REPORT)
        chunks = (provider or HashedTerms()).embed(chunk_files(files, override, recompute))
        done = store.commit(chunks, rows.where("status = 'ok'").select("source_file"), report)
        return store.reports_of(done)
    finally:
        shared.remove(staged)


def ingest_directory(store: ChunkStore, folder: str, **options) -> DataFrame:
    """All documents below a folder in one job."""
    return ingest(store, read_files(store.spark, folder), **options)


__all__ = ["batch_totals", "chunk_files", "ingest", "ingest_directory"]
