"""Operator 8: mix sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, join_groups, materialize
from .prefix import prefix_sums

GOLDEN = 0.6180339887498949
CHUNK = 1 << 14


@dataclass
class Mix:
    """``docs``: doc_id, size, source_size, target, taken, copies. ``pieces``: slot, source, doc_id, first_word,
    words - the mixture in the order of its slots."""

    docs: DataFrame
    pieces: DataFrame


def source_targets(sources: DataFrame, weights, share: float, most: float) -> DataFrame:
    """src, source, source_size, start (words of the sources before), target and words (its whole part).

    ``sources``: source, source_size. They are numbered by code point, null last, and get ``weights`` in turn. The targets
    share ``share`` times all words by weight; none exceeds ``most`` times its source, and the excess is shared again
    by weight. So target = min(most * size, level * weight) for one level: in the order of size / weight, prefix sums
    give what is left once the smaller ones have all they can take, and the first source that need not be cut sets the
    level. Any number of sources is handled; the driver sees that one row.
    """
    ordered = prefix_sums(sources, ["source"], "source_size").withColumnsRenamed(
        {"position": "src", "before_source_size": "start"}
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    ratio = F.col("source_size") / F.col("weight")
    filled = prefix_sums(
        ordered.withColumn("weight", weight.cast("long")).withColumn("_ratio", ratio),
        ["_ratio", "src"],
        "source_size",
        "weight",
    )
    size, heavy = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    left = F.lit(min(share, most) * (size or 0)) - most * F.col("before_source_size")
    over = F.lit(heavy or 0) - F.col("before_weight")
    first = (
        filled.where(left * F.col("weight") / over <= most * F.col("source_size"))
        .orderBy("position")
        .select("position", left.alias("left"), over.alias("over"))
        .first()
    )
    target = most * F.col("source_size")
    if first:
        target = F.when(F.col("position") < first.position, target).otherwise(
            F.lit(first.left) * F.col("weight") / F.lit(first.over)
        )
    return filled.select("src", "source", "source_size", "start", target.cast("double").alias("target")).withColumn(
        "words", (F.col("target") + 1e-6).cast("long")
    )


def mix_sources(
    docs: DataFrame,
    weights=(5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    slots: int = 1 << 18,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mix:
    """Take words of all sources so that each source's share meets its target.

    Sizes are words (maximal runs of characters other than space and \\t-\\r; null text: 0). Sources, ordered by
    code point with null last, get ``weights`` in turn; targets share ``share`` times all words and stop at
    ``most`` times their source. Every source's documents are shuffled by a seeded hash into one stream of words
    (prefix sums; no source is gathered in a task) and cut into blocks of equal words. Slot t of the schedule maps
    the golden-ratio point frac((t + 1/2) * phi) through the cumulative targets to a source; its rank among the
    slots of that source names the block it takes, going round the stream as often as needed.

    At most ``slots`` slots are scheduled at every input size; blocks grow instead. Sources of a block and more, so at
    most ``slots`` of them, take part in the schedule; blocks that the points left out and sources of less than a block
    have slots of their own after it, so every source meets its target to the word, however small. The target cuts
    the last block, so no document is taken more than ``most`` times over. Reruns agree. Rows without words, null ids
    and null sources are legal; repeated rows are taken one by one; an empty table gives no rows; extra columns are
    ignored.
    """
    spark = docs.sparkSession
    source = F.col(source_col)
    key = F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            source.alias("source"),
            key.alias("_source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    groups = materialize(
        rows.groupBy("_source", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")),
        "mix-sources",
    )
    sources = materialize(source_targets(groups, weights, share, most), "mix-targets")
    words = sources.agg(F.sum("words")).first()[0] or 0
    n_slots = max(1, min(slots, words))
    block = max(1, -(-words // n_slots))

    named = (
        groups.select("_source", "source", "_n")
        .join(sources, groups["source"].eqNullSafe(sources["source"]))
        .select("_source", "_n", "src", "source_size", "target", "words", "start")
    )
    mark = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 16)
    keyed = join_groups(rows, named, "_source", "_n").drop("_source").withColumn("_key", mark)
    stream = prefix_sums(keyed, ["src", "_key", "doc_id", "size"], "size").withColumn(
        "at", F.col("before_size") - F.col("start")
    )
    stream = materialize(stream.drop("_key", "before_size", "start"), "mix-stream")
    rounds = F.expr(
        f"transform(sequence(0, {int(np.ceil(most)) - 1}), e -> named_struct('lo', at + e * source_size, 'hi', least(at + size + e * source_size, words)))"
    )
    turn = (
        stream.where("size > 0")
        .select("position", "doc_id", "src", "source", F.explode(rounds).alias("t"))
        .where("t.lo < t.hi")
        .select("position", "doc_id", "src", "source", "t.lo", "t.hi")
    )
    cut = turn.select("*", F.explode(F.expr(f"sequence(lo DIV {block}, (hi - 1) DIV {block})")).alias("rank"))
    # at most n_slots rows
    large = sources.where(F.col("words") >= block).select("src", "words").orderBy("src").toArrow()
    src, limits = (large.column(c).to_numpy().astype(np.int64) for c in (0, 1))
    n_slots = -(-int(limits.sum()) // block)
    planned = schedule(spark, src, limits, n_slots)
    gaps, n_slots = left_out(planned, src, limits, n_slots, block)
    small = sources.where((F.col("words") > 0) & (F.col("words") < block)).select(
        (n_slots + F.col("src")).alias("slot"), "src", F.lit(0).cast("long").alias("rank")
    )
    planned = planned.unionByName(gaps).unionByName(small)
    lo, hi = F.greatest("lo", F.col("rank") * block), F.least("hi", (F.col("rank") + 1) * block)
    parts = cut.join(planned, ["src", "rank"]).select(
        "slot", "source", "position", "doc_id", (lo - F.col("lo")).alias("first_word"), (hi - lo).alias("words")
    )
    took = parts.groupBy("position").agg(
        F.sum("words").alias("taken"), F.count_if(F.col("first_word") == 0).alias("copies")
    )
    out = stream.join(took, "position", "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        "position",
    )
    return Mix(out, parts.select("slot", "source", "doc_id", "first_word", "words"))


def schedule(spark: SparkSession, src: np.ndarray, limits: np.ndarray, n_slots: int) -> DataFrame:
    """(slot, src, rank): the source of each slot and the slot's rank among those of its source. Ranks are counted
    in chunks of slots and shifted by the counts of the chunks before."""
    edges = np.cumsum(limits, dtype=np.float64) / max(1, limits.sum())

    def chunk(batches):
        for batch in batches:
            for c in batch.column(0).to_pylist():
                slot = np.arange(c * CHUNK, min(n_slots, (c + 1) * CHUNK), dtype=np.int64)
                at = np.minimum(np.searchsorted(edges, (slot + 0.5) * GOLDEN % 1.0, side="right"), len(edges) - 1)
                order = np.argsort(at, kind="stable")
                run = at[order]
                rank = np.empty(len(slot), np.int64)
                rank[order] = np.arange(len(slot)) - np.searchsorted(run, run, side="left")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), c, np.int64)), pa.array(slot), pa.array(src[at]), pa.array(rank)],
                    names=["chunk", "slot", "src", "_r"],
                )

    if not len(src):
        return spark.createDataFrame([], "slot long, src long, rank long")
    local = spark.range(-(-n_slots // CHUNK)).mapInArrow(chunk, "chunk long, slot long, src long, _r long")
    counts = local.groupBy("src", "chunk").count()  # a row for each source and chunk of CHUNK slots
    shift = counts.select(
        "src", "chunk", (F.sum("count").over(Window.partitionBy("src").orderBy("chunk")) - F.col("count")).alias("_s")
    )
    return local.join(shift, ["src", "chunk"]).select("slot", "src", (F.col("_r") + F.col("_s")).alias("rank"))


def left_out(planned: DataFrame, src: np.ndarray, limits: np.ndarray, n_slots: int, block: int) -> tuple[
    DataFrame, int
]:
    """(slot, src, rank) of the blocks for which ``planned`` has no slot, numbered from ``n_slots`` on, and the next free
    slot. The driver sees a count for each source of the schedule."""
    have = np.zeros(len(src), np.int64)
    counts = planned.groupBy("src").count().toArrow()
    have[np.searchsorted(src, counts.column(0).to_numpy())] = counts.column(1).to_numpy()
    lack = np.maximum(-(-limits // block) - have, 0)
    some = lack > 0
    rows = pa.table(
        {"src": src[some], "have": have[some], "lack": lack[some], "first": (n_slots + np.cumsum(lack) - lack)[some]}
    )
    spark = planned.sparkSession
    gaps = (
        spark.createDataFrame(rows)
        if rows.num_rows
        else spark.createDataFrame([], "src long, have long, lack long, first long")
    )
    each = gaps.select("src", "have", "first", F.explode(F.expr("sequence(0L, lack - 1)")).alias("i"))
    return each.select(
        (F.col("first") + F.col("i")).alias("slot"), "src", (F.col("have") + F.col("i")).alias("rank")
    ), n_slots + int(lack.sum())
