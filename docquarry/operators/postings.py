"""Sparse top-k over an inverted index: postings in blocks of falling weight, read only as far as a query's best rows need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Postings in the first block of a token and segment; each further block holds twice as many.
HEAD = 16
EDGE = 1 - 1e-9


def segment_of(id_col: str, rows: int, per_segment: int = 100_000) -> Column:
    """Segment of a row by the hash of its id, about ``per_segment`` rows each."""
    return F.pmod(F.xxhash64(id_col), F.lit(max(1, -(-rows // per_segment)))).cast("int")


def build_postings(rows: DataFrame, segment: Column, id_col: str = "chunk_uuid", sparse_col: str = "sparse") -> DataFrame:
    """(segment, token, level, most, n, held) of ``rows``: in each segment the rows that hold a token, heaviest first, cut into
    blocks of HEAD, 2 * HEAD, 4 * HEAD, ... rows (``held``: id, weight); ``most`` is the largest weight of a block, ``n``
    its rows.

    A token that every row holds has a list of its own in every segment, so no list is longer than a segment. Weights
    are positive; rows without tokens have no postings.
    """
    each = rows.select(segment.alias("segment"), F.col(id_col).alias("id"), F.explode(sparse_col).alias("token", "weight"))
    place = F.row_number().over(Window.partitionBy("segment", "token").orderBy(F.desc("weight"), "id"))
    level = F.floor(F.log2((place - 1) / HEAD + 1)).cast("int")
    blocks = each.withColumn("level", level).groupBy("segment", "token", "level")
    return blocks.agg(
        F.max("weight").cast("double").alias("most"),
        F.count("*").alias("n"),
        F.collect_list(F.struct("id", F.col("weight").cast("double").alias("weight"))).alias("held"),
    )


@dataclass
class Found:
    """``rows``: query_id, id, score, rank. ``reach``: query_id, n_read and n_held, the postings that were read of those that the
    query's tokens have."""

    rows: DataFrame
    reach: DataFrame


def _dot(asked: Column, own: Column) -> Column:
    """Sum of products over shared tokens; null where none is shared."""
    parts = F.transform(
        F.map_entries(asked), lambda e: e.value.cast("double") * F.try_element_at(own, e.key).cast("double")
    )
    shared = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(shared) > 0, F.aggregate(shared, F.lit(0.0), lambda s, x: s + x))


def sparse_top_k_postings(
    postings: DataFrame,
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    write: Callable[[DataFrame], DataFrame],
    id_col: str = "chunk_uuid",
) -> Found:
    """The ``k`` best of ``rows`` (id, sparse) for every query (query_id, sparse), as by scoring all of them.

    First each token's heaviest block is read, and the rows with the largest sums there are scored in full from their
    own vectors: the k-th best score is a floor for the answer. A row that no block names in which a token of weight
    q can add q * most of at least a T-th of the floor, T being the query's tokens, gets less than the floor from all
    of them together. So only those blocks are read. What they name has a sum, and for each token that did not name
    it at most the largest weight left unread; rows whose two parts reach the floor are scored in full. Blocks are
    chosen from the directory, the columns beside ``held``. ``write`` stores a table once and reads it back. Ties
    break by the id.
    """
    asked = queries.select("query_id", F.map_filter("sparse", lambda _, w: w > 0).alias("asked"))
    terms = asked.select("query_id", F.size("asked").alias("t"), F.explode("asked").alias("token", "q"))
    terms = terms.withColumn("q", F.col("q").cast("double"))
    directory = postings.select("segment", "token", "level", "most", "n")
    blocks = write(directory.join(terms, "token"))
    heaviest = Window.partitionBy("query_id", "token").orderBy(F.desc("most"), "segment", "level")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def sums(chosen: DataFrame) -> DataFrame:
        """Sums of what the chosen blocks (with ``left``, the most that a token adds unread) hold of each row."""
        on = ["segment", "token", "level"]
        named = postings.select(*on, "held").join(chosen.select("query_id", "q", "left", *on), on)
        each = named.select("query_id", "q", "left", F.inline("held"))
        added = F.sum(F.col("q") * F.col("weight")).alias("sum")
        return each.groupBy("query_id", "id").agg(added, F.sum("left").alias("spared"))

    def scored(pairs: DataFrame) -> DataFrame:
        own = rows.select(F.col(id_col).alias("id"), "sparse")
        score = _dot(F.col("asked"), F.col("sparse")).alias("score")
        return pairs.select("query_id", "id").join(own, "id").join(asked, "query_id").select("query_id", "id", score)

    heads = blocks.withColumn("_n", F.row_number().over(heaviest)).where("_n = 1").withColumn("left", F.lit(0.0))
    likely = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sum"), "id"))
    some = sums(heads).withColumn("_n", likely).where(F.col("_n") <= 4 * k)
    kth = scored(some).withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k)
    floors = write(kth.select("query_id", F.col("score").alias("floor")))  # at most a row a query
    floor = F.coalesce("floor", F.lit(0.0)) * EDGE
    read = F.col("q") * F.col("most") * F.col("t") >= floor
    limited = blocks.join(floors, "query_id", "left").withColumn("read", read)
    left = limited.groupBy("query_id", "token").agg(
        F.coalesce(F.max(F.when(~F.col("read"), F.col("q") * F.col("most"))), F.lit(0.0)).alias("left")
    )
    left = write(left)
    all_left = left.groupBy("query_id").agg(F.sum("left").alias("all_left"))
    found = sums(limited.where("read").join(left, ["query_id", "token"])).join(all_left, "query_id")
    found = found.join(floors, "query_id", "left")
    hopeful = found.where(F.col("sum") + F.col("all_left") - F.col("spared") >= floor)
    top = scored(hopeful).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    reach = limited.groupBy("query_id").agg(
        F.coalesce(F.sum(F.when(F.col("read"), F.col("n"))), F.lit(0)).alias("n_read"), F.sum("n").alias("n_held")
    )
    return Found(top.select("query_id", F.col("id").alias(id_col), "score", "rank"), reach)
