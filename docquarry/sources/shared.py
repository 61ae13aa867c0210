"""Files of a folder that several drivers share: opened, listed, and put in place so that of two writers one wins."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def open_path(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder (file, hdfs, s3, gs: what pyarrow opens)."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


def put_if_absent(spark: SparkSession, path: str, content: bytes) -> bool:
    """Write a file whole unless it is there already; False if it is. Readers see all of it or nothing. The file is
    written under another name and linked (local) or renamed without overwriting (Hadoop: atomic on HDFS)."""
    files, base = open_path(path)
    aside = f"{base}.{uuid.uuid4().hex}.tmp"
    files.create_dir(base.rpartition("/")[0], recursive=True)
    with files.open_output_stream(aside, compression=None) as out:
        out.write(content)
    try:
        if isinstance(files, fs.LocalFileSystem):
            os.link(aside, base)
            return True
        return rename_if_absent(spark, aside, path)
    except FileExistsError:
        return False
    finally:
        if files.get_file_info(aside).type == fs.FileType.File:
            files.delete_file(aside)


def rename_if_absent(spark: SparkSession, aside: str, path: str) -> bool:
    """Hadoop's rename, which refuses a target that exists. ``aside`` is a path in the file system of ``path``."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    never = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(target.getParent(), aside.rpartition("/")[2]), target, never)
    except Exception as error:
        if "FileAlreadyExists" not in str(error):
            raise
        return False
    return True


def names(folder: str) -> list[str]:
    """Names of a folder's files; none if it is missing."""
    files, base = open_path(folder)
    listed = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(x.base_name for x in listed if x.type == fs.FileType.File)


def read_bytes(path: str) -> bytes:
    files, base = open_path(path)
    with files.open_input_stream(base, compression=None) as source:
        return source.read()


def remove(folder: str) -> None:
    files, base = open_path(folder)
    if files.get_file_info(base).type == fs.FileType.Directory:
        files.delete_dir(base)


def remove_file(path: str) -> None:
    files, base = open_path(path)
    files.delete_file(base)


def folders(folder: str, depth: int) -> list[str]:
    """Folders ``depth`` levels below ``folder``, relative to it."""
    files, base = open_path(folder)
    found = [""]
    for _ in range(depth):
        below = []
        for f in found:
            listed = files.get_file_info(fs.FileSelector(f"{base}/{f}".rstrip("/"), allow_not_found=True))
            below += [f"{f}/{x.base_name}".lstrip("/") for x in listed if x.type == fs.FileType.Directory]
        found = below
    return found
