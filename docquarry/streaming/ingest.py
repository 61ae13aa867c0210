"""Streaming ingestion: a folder is listed again and again, and keyed state by path tells what has changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..ingest import ingest
from ..operators.store import ChunkStore
from ..sources.files import parse_files
from ..sources.listing import NAME, DocumentFiles, fetch
from ..sources.shared import open_path

CHANGED = "file_path string, content binary, digest string, modified long"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Changes(StatefulProcessor):
    """State of a path: the digest, time and length it had when it was last taken. A file whose time and length are those is
    not opened; one whose content has the same digest is not put out."""

    def __init__(self, folder: str):
        self.folder = folder

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string, modified long, length long")
        self.files, _ = open_path(self.folder)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        path, seen = key[0], list(rows)  # one row a listing
        now = max(seen, key=lambda r: r.modified)
        last = self.last.get() if self.last.exists() else None
        if last is not None and (last[1], last[2]) == (now.modified, now.length):
            return
        content = fetch(self.files, path)
        if content is None:  # gone since it was listed
            return
        digest = hashlib.sha256(content).hexdigest()
        self.last.update((digest, now.modified, now.length))
        if last is None or last[0] != digest:
            yield Row(file_path=path, content=bytearray(content), digest=digest, modified=now.modified)

    def close(self) -> None:
        pass


def changed_files(spark: SparkSession, folder: str, depth: int = 1) -> DataFrame:
    """file_path, content, digest, modified of every file that is new or holds other content than when it was last taken.

    Nothing depends on the order or lateness of modification times: a file put there with an old time is taken, one
    that goes back to earlier content is taken again, and equal files under different paths are all taken. A change
    that keeps both the time (to the nanosecond) and the length goes unseen; files that vanish are not told of.
    """
    spark.dataSource.register(DocumentFiles)
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)  # keyed state needs it
    listing = spark.readStream.format(NAME).option("path", folder).option("depth", depth).load()
    return listing.groupBy("path").transformWithState(Changes(folder), CHANGED, "Update", "None")


def start_ingest(
    store: ChunkStore, folder: str, checkpoint: str, provider=None, override: dict | None = None, depth: int = 1, **trigger
) -> StreamingQuery:
    """Ingest each micro-batch, as one commit. A batch that is run again after a failure replaces its own chunks. With a
    trigger of ``processingTime`` the folder is listed at that interval."""

    def batch(files: DataFrame, number: int) -> None:
        ingest(store, parse_files(files.select("file_path", "content")), provider, override)

    return (
        changed_files(store.spark, folder, depth)
        .writeStream.outputMode("update")
        .foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


__all__ = ["changed_files", "start_ingest"]
