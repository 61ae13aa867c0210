"""Operator 1: contiguous shards of near-equal bytes, cut from global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .prefix import prefix_sums


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the table, ordered by id, into ``shards`` runs of near-equal size.

    A row's size is its UTF-8 bytes plus 1, so a null or empty text has size 1. The cuts are equal steps of the
    total size; a row goes to the shard that holds its middle byte, so a shard misses its target by half a row on
    either side at most. Output: id, ``size``, ``text_crc32`` (of the UTF-8 bytes; 0 for null), ``shard``, ``slot``
    (row number in the shard, from 0), ``position`` (row number in the table). Only these narrow columns are
    shuffled. Null ids come last; repeated rows each keep a slot of their own; an empty table gives no rows;
    other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        ),
        "sizes",
    )
    total = rows.agg(F.sum("size")).first()[0] or 1
    placed = prefix_sums(rows, ["doc_id", "text_crc32"], "size").withColumn(
        "shard", F.expr(f"CAST(least({shards - 1}, ((2 * before_size + size) * {shards}) DIV (2 * {total})) AS INT)")
    )
    first = placed.groupBy("shard").agg(F.min("position").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("_first")).alias("slot"), "position"
    )
