"""The service functions (upload, batch, list, delete, search, health) over a store and a folder of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .ingest import ingest
from .operators.catalog import search_documents
from .operators.embedding import HashedTerms, embed_query
from .operators.filters import normalize_value
from .operators.store import ChunkStore
from .sources.files import SUFFIXES, back_up, list_files, parse_files


def upload(
    store: ChunkStore, name: str, content: bytes, project_id=None, term=None, year=None, sources: str | None = None
) -> DataFrame:
    """Ingest one file; other types and empty files raise."""
    if not name.lower().endswith(SUFFIXES):
        raise ValueError("only PDF, DOCX and Markdown files are supported")
    if not content:
        raise ValueError("the file is empty")
    return upload_batch(store, {name: content}, project_id, term, year, sources)


def upload_batch(
    store: ChunkStore, files: dict[str, bytes], project_id=None, term=None, year=None, sources: str | None = None
) -> DataFrame:
    """Ingest several files in one job; a file that fails is a row with an error. Names are kept for the rules. With
    ``sources``, a folder, the files are kept there as they came."""
    rows = store.spark.createDataFrame(
        [(n, bytearray(c)) for n, c in files.items()], "file_path string, content binary"
    )
    if sources:
        back_up(rows, sources)
    override = {"project_id": normalize_value(project_id), "term": normalize_value(term), "year": year}
    return ingest(store, parse_files(rows), override=override)


def delete_file(store: ChunkStore, source_file: str) -> int:
    """Delete a file's chunks; returns how many."""
    if not source_file.strip():
        raise ValueError("source_file is empty")
    return store.delete(source_file.strip())


def search_store(store: ChunkStore, query: str, provider=None, **params) -> DataFrame:
    provider = provider or HashedTerms()
    return search_documents(store.read(), lambda q: embed_query(store.spark, provider, q), query, **params)


def health() -> dict:
    return {"status": "ok"}


__all__ = ["delete_file", "health", "list_files", "search_store", "upload", "upload_batch"]
