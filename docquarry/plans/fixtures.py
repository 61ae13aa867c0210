"""The inputs that the registered queries share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_documents
from ..operators.lines import first_heading
from ..operators.metadata import with_metadata

FILE_PATH = """'/corpus/' || CAST(2020 + doc_id % 5 AS STRING) || '/' || CASE doc_id % 3 WHEN 0 THEN '春季' WHEN 1 THEN '夏季' ELSE 'misc' END || '/' || source || '/' ||
CASE doc_id % 6 WHEN 0 THEN '软件需求规格说明书' WHEN 1 THEN '概要设计' WHEN 2 THEN '测试报告' WHEN 3 THEN '用户手册' WHEN 4 THEN '开发计划' ELSE 'notes' END || '_' || CAST(doc_id AS STRING) || '.md'"""
BODY = """'# Doc ' || CAST(doc_id AS STRING) || chr(10) || 'FR-' || CAST(doc_id % 7 AS STRING) || ' TC-' || CAST(doc_id % 5 AS STRING) || ' SD-' || CAST(doc_id % 4 AS STRING) || ' latency 12ms' || chr(10) ||
'## 目标' || chr(10) || text || chr(10) || '## 总结' || chr(10) || substring(text, 1, 120)"""
#: Documents with paths, headings and identifiers, in Spark and DuckDB alike.
FX = f"SELECT doc_id, lang, source, {FILE_PATH} AS file_path, {BODY} AS body FROM documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before expressions that keep a core busy: a scan of one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).selectExpr(
        "doc_id", "lang", "source", f"{FILE_PATH} AS file_path", f"{BODY} AS body"
    )


def chunks(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Chunks of ``docs`` (columns of ``fx`` and others; else all documents)."""
    docs = fx(spark, sf_dir) if docs is None else docs
    return chunk_documents(docs.withColumn("first_heading", first_heading(F.col("body"))))


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names (a temporary one where it is unset in a local session; a
    cluster needs one that its machines share)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docquarry-")
    return f"{folder.rstrip('/')}/docquarry/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in a ``new_folder``."""
    path = new_folder(df.sparkSession, "store")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def metadata(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Chunks with all metadata and a printable key."""
    return with_metadata(chunks(spark, sf_dir, docs)).withColumns(
        {
            "chunk_uuid": F.concat(
                F.lpad(F.col("doc_id").cast("string"), 9, "0"),
                F.lit("-"),
                F.lpad(F.col("chunk_index").cast("string"), 5, "0"),
            ),
            "source_file": F.col("file_path"),
        }
    )
