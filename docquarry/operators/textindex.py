"""Substring search over a column of texts through postings of trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 3


def grams(text: Column) -> Column:
    """The distinct runs of SIZE characters of a text."""
    places = F.sequence(F.lit(1), F.length(text) - (SIZE - 1))
    return F.when(F.length(text) >= SIZE, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(SIZE)))))


def build_grams(rows: DataFrame, text_col: str, per_segment: int = 4096) -> DataFrame:
    """(gram, segment, held) of the distinct texts of a column: each gram's texts by their 128-bit digests, in segments of
    about ``per_segment`` texts, so that a gram of all texts has a list in each and none of it is longer. A text that many
    rows share is indexed once; texts shorter than a gram are in no list."""
    texts = rows.select(F.col(text_col).alias("text")).where("text IS NOT NULL").groupBy("text").agg(F.lit(1))
    n = texts.count()
    segment = F.pmod(F.xxhash64("text"), F.lit(max(1, -(-n // per_segment)))).cast("int").alias("segment")
    each = texts.select(segment, F.md5("text").alias("id"), F.explode(grams(F.col("text"))).alias("gram"))
    lists = each.groupBy("gram", "segment").agg(F.sort_array(F.collect_list("id")).alias("held"))
    return lists.repartitionByRange("gram").sortWithinPartitions("gram", "segment")


def find_substring(index: DataFrame, rows: DataFrame, text_col: str, asked: str) -> DataFrame:
    """The ``rows`` whose text holds ``asked``. The lists of its grams are read alone and intersected; what they leave is
    compared in full. Shorter than a gram, it is looked for in all rows; empty, it is in every text."""
    holds = F.col(text_col).contains(asked)
    own = list(dict.fromkeys(asked[i : i + SIZE] for i in range(len(asked) - SIZE + 1)))
    if not own:
        return rows.where(holds)
    lists = index.where(F.col("gram").isin(own)).select("gram", F.explode("held").alias("_id"))
    both = lists.groupBy("_id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(own)).select("_id")
    return rows.join(both, F.md5(text_col) == F.col("_id"), "left_semi").where(holds)


def find_substrings(index: DataFrame, rows: DataFrame, text_col: str, queries: DataFrame) -> DataFrame:
    """The same for every query (query_id, asked) of at least SIZE characters: ``rows`` with query_id. Each query takes the
    list of its rarest gram. What a text of that list has around the gram, at the places and lengths that the gram's
    queries have, meets the queries by equality: pairs grow with the lists, not with lists times queries."""
    places = F.sequence(F.lit(1), F.length("asked") - (SIZE - 1))
    each = F.transform(places, lambda i: F.struct(F.substring("asked", i, F.lit(SIZE)).alias("gram"), i.alias("at")))
    own = queries.where(F.length("asked") >= SIZE).select("query_id", "asked", F.inline(each))
    sizes = index.join(own.select("gram").distinct(), "gram").groupBy("gram").agg(F.sum(F.size("held")).alias("n"))
    rarest = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy("n", "at"))
    # a gram that no text has comes first, and its query then meets nothing
    chosen = own.join(sizes, "gram", "left").withColumn("_n", rarest).where("_n = 1 AND n IS NOT NULL").drop("_n", "n")
    shape = F.struct("at", F.length("asked").alias("len"))
    shapes = chosen.groupBy("gram").agg(F.collect_set(shape).alias("shapes"))
    lists = index.join(shapes, "gram").select("gram", "shapes", F.explode("held").alias("_id"))
    texts = rows.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("_text")).agg(F.lit(1))
    near = lists.join(texts.select("_text", F.md5("_text").alias("_id")), "_id")
    starts = F.sequence(F.lit(1), F.length("_text") - (SIZE - 1))
    met = F.filter(starts, lambda i: F.substring("_text", i, F.lit(SIZE)) == F.col("gram"))
    near = near.select("gram", "_id", "_text", F.explode(met).alias("_start"), "shapes")
    near = near.select("gram", "_id", "_text", "_start", F.inline("shapes"))
    first = F.col("_start") - F.col("at") + 1
    near = near.where((first >= 1) & (first + F.col("len") - 1 <= F.length("_text")))
    near = near.select("gram", "at", "_id", F.substring("_text", first, F.col("len")).alias("asked"))
    both = near.join(chosen, ["gram", "at", "asked"]).select("query_id", "asked", "_id").distinct()
    return rows.join(both, F.md5(text_col) == F.col("_id")).drop("_id")
