"""Small helpers that the training-data operators share: the shared folder, written tables, hashes."""

from __future__ import annotations

import ctypes
import math
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset in a local session a temporary one. A cluster has no
    folder that all its machines share unless it is named, so there an unset one is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("docquarry.local.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("docquarry.local.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docquarry/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder: the table read back, and its path. Lineage ends there and lost executors
    cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The same where the table stays until the caller clears the shared folder."""
    return written(df, name)[0]


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder (file, hdfs, s3, gs: what pyarrow opens)."""
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def discard(path: str) -> None:
    """Remove a table of the shared folder that a later one has replaced."""
    files, base = open_folder(path)
    files.delete_dir(base)


def join_groups(
    rows: DataFrame, groups: DataFrame, key: str, count: str, stored: bool = False, hot: int = 1000
) -> DataFrame:
    """``rows`` with the columns of ``groups``: an inner join on ``key`` that no key makes uneven.

    ``groups`` holds each key once and in ``count`` how many of ``rows`` have it. Keys of more than one ``hot``-th of all
    rows (fewer than ``hot`` of them, so their table is small at any size) are broadcast; all others, none of them large,
    are joined by shuffle. ``rows`` is read twice and should be a written table; ``groups`` is written here unless it is
    ``stored`` already. Null keys find nothing.
    """
    groups = groups if stored else materialize(groups, "groups")
    total = groups.agg(F.sum(count)).first()[0] or 0
    limit = max(total // hot, 100)
    large = F.broadcast(groups.where(F.col(count) > limit).drop(count))
    small = groups.where(F.col(count) <= limit).drop(count)
    rest = rows.join(large.select(key), key, "left_anti")
    return rows.join(large, key).unionByName(rest.join(small, key))


def spread(table: DataFrame) -> DataFrame:
    """A scanned table over all cores, before work that keeps a core busy: a scan of one row group is one task. Scans of
    at least as many partitions stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let whole texts go to Python ``rows`` at a time where the session has Spark's default of 10,000: an executor holds a batch
    for each task several times over, outside its heap. A setting of the user's own stays."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(rows))


_tidied = [0.0]


def tidy(every: float = 0.0) -> None:
    """Hand memory that a task has freed back to the machine, at most once in ``every`` seconds. A worker process outlives its
    tasks, and what its allocators keep for later would add up over the stages of a job."""
    if time.monotonic() - _tidied[0] >= every:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)
        _tidied[0] = time.monotonic()


def pieces(rows: int, each: int) -> int:
    """How many pieces of about ``each`` rows; at least one."""
    return max(1, math.ceil(rows / each))


def lower_ascii(c):
    """Lower-case A-Z only. Pure ASCII strings take the byte-wise path of ``lower``; others are translated."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
