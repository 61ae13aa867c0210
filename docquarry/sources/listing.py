"""A Spark data source that lists the files of a folder on the executors, in batches and as a stream.

``spark.read.format("document_files").load(folder)`` gives path, modified (nanoseconds) and length of every file, those
without a byte too; hidden names (``_``, ``.``) and what is below them are left out. The planner opens folders down to
``depth`` levels and makes a task of each that it finds there, which lists all below it.
``spark.readStream.format("document_files")`` lists the folder anew for every micro-batch, since a path that was seen
before may hold something else now; what has changed is for keyed state to tell (``streaming.ingest``).
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .shared import open_path

NAME, LISTED = "document_files", "path string, modified long, length long"


@dataclass
class Below(InputPartition):
    """Files of one folder, or of all folders below it too."""

    folder: str
    deep: bool

    def __post_init__(self):
        self.value = None


def _shown(name: str) -> bool:
    return not name.startswith(("_", "."))


def cut(folder: str, depth: int) -> list[Below]:
    """Parts of a folder that tasks list: each folder at ``depth`` with all below it, those above with their own files."""
    files, base = open_path(folder)
    if files.get_file_info(base).type == fs.FileType.File:
        return [Below(base, False)]
    parts, level = [], [base]
    for _ in range(depth):
        parts += [Below(f, False) for f in level]
        found = (x for f in level for x in files.get_file_info(fs.FileSelector(f, allow_not_found=True)))
        level = sorted(x.path for x in found if x.type == fs.FileType.Directory and _shown(x.base_name))
    return parts + [Below(f, True) for f in level]


def files_of(folder: str, part: Below) -> Iterator[pa.RecordBatch]:
    """path, modified, length of a part's files, folder by folder."""
    files, _ = open_path(folder)
    waiting = [part.folder]
    while waiting:
        at = waiting.pop()
        info = files.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, allow_not_found=True))
        shown = [x for x in found if _shown(x.base_name)]
        if part.deep:
            waiting += [x.path for x in shown if x.type == fs.FileType.Directory]
        rows = [(x.path, x.mtime_ns or 0, x.size) for x in shown if x.type == fs.FileType.File]
        for i in range(0, len(rows), 10_000):
            paths, times, sizes = zip(*rows[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(times, pa.int64()), pa.array(sizes, pa.int64())],
                names=["path", "modified", "length"],
            )


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return Listing(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Relisting(self.options)


class Listing(DataSourceReader):
    def __init__(self, options):
        self.folder, self.depth = options["path"], int(options.get("depth", "1"))

    def partitions(self):
        return cut(self.folder, self.depth)

    def read(self, partition):
        return files_of(self.folder, partition)


class Relisting(DataSourceStreamReader):
    """Offsets are times of listing: each micro-batch is the whole folder as it is when the batch is planned."""

    def __init__(self, options):
        self.folder, self.depth = options["path"], int(options.get("depth", "1"))

    def initialOffset(self):
        return {"listed": 0}

    def latestOffset(self):
        return {"listed": time.time_ns()}

    def partitions(self, start, end):
        return [] if start == end else cut(self.folder, self.depth)

    def read(self, partition):
        return files_of(self.folder, partition)


def listed(spark: SparkSession, folder: str, depth: int = 1) -> DataFrame:
    spark.dataSource.register(DocumentFiles)
    return spark.read.format(NAME).option("path", folder).option("depth", depth).load()


def by_bytes(files: DataFrame, most: int = 64 << 20) -> DataFrame:
    """``files`` (path, length, ...) dealt to tasks of about ``most`` bytes: each listing task sums the lengths of its files as it
    goes and starts another bin whenever the sum has grown by ``most``; a file of more has a bin of its own."""
    schema = T.StructType([*files.schema.fields, T.StructField("_bin", T.LongType())])

    def run(batches):
        total = 0
        for batch in batches:
            lengths = batch.column("length").to_pylist()
            bins = []
            for n in lengths:
                bins.append(total // most)
                total += n + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int64())], names=schema.fieldNames())

    binned = files.mapInArrow(run, schema).withColumn("_task", F.spark_partition_id())
    return binned.repartition("_task", "_bin").drop("_task", "_bin")


def contents(files: DataFrame, folder: str) -> DataFrame:
    """``files`` with the column content; a file that has gone since it was listed is left out."""
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])

    def run(batches):
        store, _ = open_path(folder)
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                content = fetch(store, path)
                if content is not None:
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(i, 1).columns, pa.array([content], pa.binary())], names=schema.fieldNames()
                    )

    return files.mapInArrow(run, schema)


def fetch(store: fs.FileSystem, path: str) -> bytes | None:
    try:
        with store.open_input_stream(path, compression=None) as source:
            return source.read()
    except FileNotFoundError:
        return None


def modified_at(modified: Column) -> Column:
    return F.timestamp_micros((modified / 1000).cast("long"))
