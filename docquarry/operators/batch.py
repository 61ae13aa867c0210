"""Search for many queries in one plan, keyed by query_id from recall to link expansion: nothing is collected per query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import conjunction, relaxed, where
from .retrieval import EXPAND, KEEP, RECALL, W_DOCNAME, composite, dense_top_k_many, docname_hints, docname_score, first_holders, sparse_top_k_many, target_field, token_overlap

_BY_QUERY = "query_id"
#: Hits of all queries that go to every task at most, to meet the store there.
BROADCAST_HITS = 1 << 20


def _place(*order: Column, by: tuple[str, ...] = (_BY_QUERY,)) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def recall_many(store: DataFrame, queries: DataFrame, predicates: list, k: int = RECALL, mode: str = "fused", constant: int = 60) -> DataFrame:
    """(query_id, level, chunk_uuid, score, rank) of every query on the rows of each predicate. A level is one scan for all
    queries."""
    asked = queries.select(_BY_QUERY, F.col("dense").alias("vector"), "sparse")
    levels = None
    for i, predicate in enumerate(predicates):
        rows = where(store, predicate).select("chunk_uuid", "dense", "sparse")
        near = dense_top_k_many(rows, asked.select(_BY_QUERY, "vector"), k)
        if mode == "dense":
            found = near
        else:
            alike = sparse_top_k_many(rows, asked.select(_BY_QUERY, "sparse"), k)
            keys = [_BY_QUERY, "chunk_uuid"]
            both = near.select(*keys, F.col("rank").alias("_d")).join(alike.select(*keys, F.col("rank").alias("_s")), keys, "full")
            parts = [F.coalesce(1 / (constant + F.col(c)), F.lit(0.0)) for c in ("_d", "_s")]
            fused = both.select(*keys, (parts[0] + parts[1]).alias("score"))
            found = fused.withColumn("rank", _place(F.desc("score"), F.col("chunk_uuid"))).where(F.col("rank") <= k)
        found = found.select(_BY_QUERY, F.lit(i).alias("level"), "chunk_uuid", "score", "rank")
        levels = found if levels is None else levels.unionByName(found)
    return levels


def first_levels_many(ranks: DataFrame, target: int = max(8, KEEP)) -> DataFrame:
    """``ranks``, a written table: for each query the levels up to the first at which its distinct rows so far reach ``target``: query_id, chunk_uuid,
    score, seq."""
    first = ranks.withColumn("_n", _place(F.col("level"), F.col("rank"), by=(_BY_QUERY, "chunk_uuid"))).where("_n = 1").drop("_n")
    earlier = Window.partitionBy(_BY_QUERY).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    counts = first.groupBy(_BY_QUERY, "level").count()
    before = counts.select(_BY_QUERY, "level", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    kept = first.join(before, [_BY_QUERY, "level"]).where(F.col("_before") < target)
    return kept.select(_BY_QUERY, "chunk_uuid", "score", _place(F.col("level"), F.col("rank")).alias("seq"))


def docname_recall_many(store: DataFrame, queries: DataFrame, limit: int = KEEP // 2, least: float = 0.6) -> DataFrame:
    """(query_id, chunk_uuid, score, docname_score, docname_reason): the best rows by file name for the queries that hold a
    hint. Each distinct file name meets each of these queries once; of a file's rows the first ``limit`` are enough."""
    asked = queries.select(_BY_QUERY, "query", docname_hints(F.col("query")).alias("hints")).where(F.size("hints") > 0)
    place = F.row_number().over(Window.partitionBy("source_file").orderBy("chunk_uuid"))
    heads = store.select("source_file", "chunk_uuid").withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")
    score, reason = docname_score(F.col("query"), F.col("source_file"), F.col("hints"))
    names = store.select("source_file").distinct().crossJoin(asked)  # the stated queries against all names
    named = names.select(_BY_QUERY, "source_file", score.alias("docname_score"), reason.alias("docname_reason"))
    rows = named.where(F.col("docname_score") >= least).join(heads, "source_file")
    best = rows.withColumn("_place", _place(F.desc("docname_score"), F.col("chunk_uuid"))).where(F.col("_place") <= limit)
    found = (0.2 + 0.2 * F.col("docname_score")).alias("_score")
    return best.select(_BY_QUERY, "chunk_uuid", found, "docname_score", "docname_reason", "_place")


def expand_links_many(results: DataFrame, store: DataFrame, expand: int = EXPAND, top: int = KEEP // 2, same_project: bool = False) -> DataFrame:
    """``expand_links`` for every query: query_id, chunk_uuid, seq."""
    links = results.where(F.col("seq") <= top).select(
        _BY_QUERY, "seq", F.col("project_id").alias("_project"), F.posexplode(F.slice("trace_links", 1, expand)).alias("pos", "link")
    )
    links = links.select(_BY_QUERY, "seq", "pos", "_project", F.col("link.to").alias("to")).where("to <> ''")
    links = links.withColumn("field", target_field(F.col("to")))
    hits = first_holders(store, links, same_project).join(links, "to")
    hits = hits.where((F.col("field") == "any") | (F.col("field") == F.col("own_field")))
    if same_project:
        hits = hits.where(F.col("project_id").eqNullSafe(F.col("_project")))
    new = hits.join(results.select(_BY_QUERY, "chunk_uuid"), [_BY_QUERY, "chunk_uuid"], "left_anti")
    order = (F.col("seq"), F.col("pos"), F.col("_hit"))
    new = new.withColumn("_first", _place(*order, by=(_BY_QUERY, "chunk_uuid"))).where("_first = 1")
    earlier = Window.partitionBy(_BY_QUERY).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    per = new.groupBy(_BY_QUERY, "seq").count()
    per = per.select(_BY_QUERY, "seq", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    kept = new.join(per, [_BY_QUERY, "seq"]).where(F.col("_before") < expand)
    return kept.select(_BY_QUERY, "chunk_uuid", _place(*order).alias("seq"))


def search_many(
    store: DataFrame,
    queries: DataFrame,
    write: Callable[[DataFrame], DataFrame],
    term=None,
    phase=None,
    doc_type=None,
    project_id=None,
    quality_level=None,
    artifact_type=None,
    use_reranker: bool = True,
    scorer=token_overlap,
    mode: str = "fused",
    same_project: bool = False,
) -> DataFrame:
    """``search`` for every query (query_id, query, dense, sparse) under the same parameters: query_id, place (from 1), chunk_uuid,
    text, metadata, composite_score, why_hit. Queries share every scan of the store; windows run per query, over the few
    hundred rows that its recall leaves. Up to BROADCAST_HITS of those rows go to the store instead of the store, with its
    texts, to them. ``write`` stores the rows of all queries once and reads them back."""
    asked = {"term": term, "phase": phase, "doc_type": doc_type, "project_id": project_id, "quality_level": quality_level, "artifact_type": artifact_type}
    # written, since it is read twice, and since Spark 4.1 takes a union of parts that are alike partitioned for one that is,
    # also where adaptive execution has coalesced the parts unlike each other
    levels = relaxed(**asked)
    recalled = write(recall_many(store, queries, levels, mode=mode))
    few = queries.count() * (RECALL * len(levels) + KEEP) <= BROADCAST_HITS  # rows recalled and those found by name

    def met(hits: DataFrame) -> DataFrame:
        return (F.broadcast(hits) if few else hits).join(store.select(*payload), "chunk_uuid")

    found = first_levels_many(recalled)
    named = docname_recall_many(where(store, conjunction(**asked)), queries)
    merged = found.join(named, [_BY_QUERY, "chunk_uuid"], "full").select(
        _BY_QUERY,
        "chunk_uuid",
        F.coalesce("score", "_score").alias("score"),
        F.coalesce("docname_score", F.lit(0.0)).alias("docname_score"),
        F.coalesce("docname_reason", F.lit("none")).alias("docname_reason"),
        _place(F.col("seq").asc_nulls_last(), F.col("_place")).alias("seq"),
    )
    payload = [c for c in store.columns if c not in ("dense", "sparse")]
    rows = met(merged).join(queries.select(_BY_QUERY, "query"), _BY_QUERY)
    if use_reranker:
        n = F.count("*").over(Window.partitionBy(_BY_QUERY))
        rows = rows.withColumn("_n", n).withColumn(
            "rerank_score", F.when(F.col("_n") > KEEP, scorer(F.col("query"), F.col("text")))
        )
        best = F.desc_nulls_last(F.col("rerank_score") + W_DOCNAME * F.col("docname_score"))
        rows = rows.withColumn("seq", _place(best, F.col("seq"))).drop("_n")
    else:
        rows = rows.withColumn("rerank_score", F.lit(None).cast("double"))
    kept = write(rows.where(F.col("seq") <= KEEP).drop("query"))
    links = kept.select(_BY_QUERY, "chunk_uuid", "seq", "trace_links", "project_id")
    # two chunks a field and link of KEEP // 2 results at most: fewer than RECALL rows a query
    added = met(expand_links_many(links, store, same_project=same_project)).withColumns(
        {
            "seq": F.col("seq") + 1_000_000,
            "score": F.lit(0.0),
            "docname_score": F.lit(0.0),
            "docname_reason": F.lit("none"),
            "rerank_score": F.lit(None).cast("double"),
        }
    )
    every = kept.unionByName(added)
    scores = composite(
        F.coalesce("rerank_score", "score"),
        {k: asked[k] for k in ("term", "phase", "doc_type", "quality_level")},
        F.col("docname_score"),
        F.col("docname_reason"),
    )
    meta = F.struct(*(c for c in payload if c not in ("chunk_uuid", "text")))
    told = every.select(
        _BY_QUERY, "chunk_uuid", "text", meta.alias("metadata"), scores.composite.alias("composite_score"), scores.why.alias("why_hit"), "seq"
    )
    place = _place(F.desc("composite_score"), F.col("seq")).alias("place")
    return told.select(_BY_QUERY, place, "chunk_uuid", "text", "metadata", "composite_score", "why_hit")
