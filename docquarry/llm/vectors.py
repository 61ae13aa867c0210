"""Operator 4: near-duplicate vectors by an exact metric range join over pivot cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, pieces
from .components import connected_components, forest

SLACK = 1e-9
PIECE = 1 << 17  # pairs of a block that are worked on at a time
LINKS = "kind int, a long, b long"


def _rows(column, dims: int) -> np.ndarray:
    return (
        column.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dims)
        if len(column)
        else np.empty((0, dims))
    )


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, v): v is the vector in double precision at unit length; null where it is null, empty or zero or
    holds a null or non-finite component."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, lengths = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            x = np.where(
                flat.is_null().to_numpy(zero_copy_only=False),
                np.nan,
                flat.fill_null(0.0).to_numpy(zero_copy_only=False),
            )
            owner = np.repeat(np.arange(len(lists)), lengths)
            top = np.zeros(len(lists))
            np.maximum.at(top, owner, np.abs(x))  # scaled first, so that squares neither overflow nor vanish
            fine = np.isfinite(top) & (top > 0)
            part = fine[owner]
            x, owner = x[part], owner[part]
            x = x / top[owner]
            x = x / np.sqrt(np.bincount(owner, x * x, len(lists)))[owner]
            ends = np.concatenate([[0], np.cumsum(np.where(fine, lengths, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x), mask=pa.array(~fine))],
                names=["id", "v"],
            )

    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    return rows.mapInArrow(run, "id long, v array<double>")


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.95,
    per_cell: int = 4096,
    max_pivots: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector; all pairs of cosine >= ``cosine`` are links.

    On the unit sphere that is a Euclidean range join of radius r = sqrt(2 - 2 * cosine). Pivots (about one per
    ``per_cell`` vectors of a length, at least 8 and over all lengths about ``max_pivots``, the rows of smallest hash)
    split the vectors into nearest-pivot cells. For y in the cell of q and d(x, y) <= r the triangle inequality gives
    d(x, q) <= d(x, y) + d(y, q) <= r + radius(q), and through d(y, q) <= d(y, p) also d(x, q) <= d(x, p) + 2 r; as
    the metric is Euclidean, x is even within r of the half-space nearer to q than to p, that is
    d(x, q)^2 - d(x, p)^2 <= 2 r d(p, q). x is replicated to the cells of larger number that all bounds allow, so that
    a pair of two cells meets in one of them alone. Each cell is joined on its own: its home rows, in blocks of at
    most about ``per_cell``, meet blocks of all its rows, so a cell of any size is spread over many tasks. Blocks
    return link counts of both ends and a union-find forest, never pairs. Identical vectors become one weighted row
    first.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do vectors of
    different lengths with each other. All lengths are joined in one job; the 64 most frequent have pivots, any other
    is one cell. Null ids are rows without links. Rows that repeat an id with unlike vectors are judged one by one,
    and a row's links count rows. Extra columns are ignored; an empty table gives no rows. Where vectors fill many
    dimensions evenly, distances concentrate and the bounds exclude little: the join stays exact and comes close to
    all blocks against all blocks.
    """
    rows = materialize(unit_vectors(vectors, id_col, vector_col), "unit")
    whole = rows.where("id IS NOT NULL AND v IS NOT NULL")
    grouped = whole.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    classes = materialize(
        grouped.select("v", F.size("v").alias("dims"), "least", "weight", F.monotonically_increasing_id().alias("rep")),
        "classes",
    )
    done = _join(classes, cosine, per_cell, max_pivots)
    done = materialize(done, "links")
    counts = done.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n"))
    found = connected_components(done.where("kind = 1").select("a", "b"))  # numbers of classes
    least = found.join(classes.select(F.col("rep").alias("id"), "least"), "id")
    named = least.join(least.groupBy("component").agg(F.min("least").alias("smallest")), "component").select(
        F.col("id").alias("_id"), "smallest"
    )
    linked = classes.join(counts, F.col("rep") == F.col("a"), "left").join(named, F.col("rep") == F.col("_id"), "left")
    of_class = linked.select(
        "v",
        F.col("weight").alias("_n"),
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("smallest", "least").alias("component"),
    )
    ids = join_groups(whole.select("id", "v"), of_class, "v", "_n").select("id", "n_links", "component")
    out = ids.unionByName(
        rows.where("id IS NULL OR v IS NULL").select(
            "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")
        )
    )
    return out.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("component").eqNullSafe(F.col("id")).alias("kept"),
    )


def comparison(cosine: float):
    """Function of one block: ``row`` rows are home rows of the cell, the others columns, ``own`` where they are at home in
    the same cell. A pair of home rows is seen from both ends, one with a column from elsewhere counts for both."""

    def compare(table: pa.Table) -> pa.Table:
        x = _rows(table["v"], table["dims"][0].as_py())
        rep, weight, row, own = (table[c].to_numpy() for c in ("rep", "weight", "row", "own"))
        left, right, at_home = x[row], x[~row], own[~row]
        ids, other, light, heavy = rep[row], rep[~row], weight[row], weight[~row]
        partners, back, trees = np.zeros(len(ids), np.int64), np.zeros(len(other), np.int64), []
        for at in range(0, len(left), 512):
            product = left[at : at + 512] @ right.T
            every_i, every_j = np.nonzero(product >= cosine - SLACK)
            for piece in range(0, len(every_i), PIECE):  # of a dense group all pairs are links
                i, j = every_i[piece : piece + PIECE], every_j[piece : piece + PIECE]
                near = np.flatnonzero(product[i, j] < cosine + SLACK)
                sure = np.ones(len(i), bool)
                sure[near] = np.einsum("ij,ij->i", left[at + i[near]], right[j[near]]) >= cosine
                i = i + at
                keep = sure & (ids[i] != other[j])
                i, j = i[keep], j[keep]
                partners += np.bincount(i, heavy[j], len(ids)).astype(np.int64)
                away = ~at_home[j]
                back += np.bincount(j[away], light[i[away]], len(other)).astype(np.int64)
                trees.append(forest(ids[i], other[j]))
            if len(trees) > 64:
                trees = [forest(*map(np.concatenate, zip(*trees, strict=True)))]
        a, b = forest(*map(np.concatenate, zip((np.empty(0, np.int64),) * 2, *trees, strict=True)))
        one, two = partners > 0, back > 0
        counted = int(one.sum() + two.sum())
        kind = np.r_[np.zeros(counted, np.int32), np.ones(len(a), np.int32)]
        return pa.table(
            {
                "kind": pa.array(kind),
                "a": pa.array(np.concatenate([ids[one], other[two], a])),
                "b": pa.array(np.concatenate([partners[one], back[two], b])),
            }
        )

    return compare


def draw_pivots(classes: DataFrame, per_cell: int, max_pivots: int) -> dict[int, np.ndarray]:
    """Pivots of the 64 most frequent lengths: one per ``per_cell`` vectors, 8 at least, of all lengths about ``max_pivots``."""
    sizes = dict(map(tuple, classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(64).collect()))
    wanted = {d: max(8, pieces(n, per_cell)) for d, n in sizes.items()}
    share = min(1.0, max_pivots / max(1, sum(wanted.values())))
    wanted = {d: min(sizes[d], max(8, int(k * share))) for d, k in wanted.items()}
    if not wanted:
        return {}
    # about twice as many as wanted pass the hash, and 50 more
    mark, limit = F.pmod(F.xxhash64("least", "weight"), F.lit(1 << 40)), F.lit(0)
    for d, k in wanted.items():
        limit = F.when(F.col("dims") == d, int(min(1.0, (2 * k + 50) / sizes[d]) * (1 << 40))).otherwise(limit)
    drawn = classes.where(mark < limit).select("dims", "v", mark.alias("mark"), "least", "rep").toArrow()
    drawn = drawn.sort_by([("mark", "ascending"), ("least", "ascending"), ("rep", "ascending")])
    lengths, out = drawn["dims"].to_numpy(), {}
    for d, k in wanted.items():
        own = drawn["v"].filter(pa.array(lengths == d)).slice(0, k)
        if len(own):
            out[d] = _rows(own, d)
    return out


def _join(classes: DataFrame, cosine: float, per_cell: int, max_pivots: int) -> DataFrame:
    """kind 0: (rep, weight of partners); kind 1: a link of the forest. ``classes``: v, dims, rep, weight."""
    spark = classes.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    centres = draw_pivots(classes.select("v", "dims", "least", "weight", "rep"), per_cell, max_pivots)
    pivots = spark.sparkContext.broadcast(centres)
    apart = spark.sparkContext.broadcast(
        {d: np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T))).astype(np.float32) for d, c in centres.items()}
    )

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.value[x.shape[1]].T)))

    def by_length(batch):
        lengths = batch.column("dims").to_numpy()
        for dims in np.unique(lengths):
            part = batch.filter(pa.array(lengths == dims))
            yield int(dims), part, _rows(pa.chunked_array([part.column("v")]), dims)

    def home(batches):
        for batch in batches:
            for dims, part, x in by_length(batch):
                cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
                if dims in pivots.value:
                    d = distances(x)
                    cell = d.argmin(axis=1)
                    far = d[np.arange(len(x)), cell]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(far)],
                    names=["v", "dims", "rep", "weight", "cell", "far"],
                )

    placed = materialize(
        classes.select("v", "dims", "rep", "weight").mapInArrow(
            home, "v array<double>, dims int, rep long, weight long, cell int, far double"
        ),
        "cells",
    )
    # a row for each pivot, and for each other length of more than per_cell vectors
    cells = placed.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    sizes, radii = {}, {d: np.full(len(c), -np.inf) for d, c in centres.items()}
    for r in cells.where(F.col("dims").isin(*centres) | (F.col("n") > per_cell)).collect():
        sizes[r.dims, r.cell] = r.n
        if r.dims in radii:
            radii[r.dims][r.cell] = r.far
    bounds = spark.sparkContext.broadcast(radii)

    def allowed(dims: int, part, x: np.ndarray) -> np.ndarray:
        cell, far, d = part.column("cell").to_numpy(), part.column("far").to_numpy(), distances(x)
        near = (d <= far[:, None] + 2 * radius + SLACK) & (d <= bounds.value[dims] + radius + SLACK)
        near &= d * d - far[:, None] ** 2 <= 2 * radius * apart.value[dims][cell] + 1e-5
        return near & (np.arange(d.shape[1]) > cell[:, None])

    def tally(batches):  # how many rows each cell will get, before any is copied
        total = {}
        for batch in batches:
            for dims, part, x in by_length(batch):
                if dims in bounds.value:
                    total[dims] = total.get(dims, 0) + allowed(dims, part, x).sum(axis=0)
        for dims, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), dims, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])],
                names=["dims", "cell", "n"],
            )

    def copies(batches):
        for batch in batches:
            for dims, part, x in by_length(batch):
                line, to = np.nonzero(allowed(dims, part, x)) if dims in bounds.value else ((), ())
                for at in range(0, len(line), 1 << 14):
                    take = pa.array(line[at : at + (1 << 14)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(part.column(i).take(take) for i in range(4)),
                            pa.array(to[at : at + (1 << 14)].astype(np.int32)),
                        ],
                        names=["v", "dims", "rep", "weight", "cell"],
                    )

    tallied = placed.mapInArrow(tally, "dims int, cell int, n long").groupBy("dims", "cell").agg(F.sum("n").alias("n"))
    widths = {(r.dims, r.cell): r.n for r in tallied.collect()}  # a row for each pivot
    sizing = [
        (*c, pieces(sizes[c], per_cell), pieces(sizes[c] + widths.get(c, 0), per_cell)) for c in sorted(sizes)
    ]
    plan = F.broadcast(spark.createDataFrame(sizing, "dims int, cell int, _rows int, _cols int"))
    on, one = ["dims", "cell"], F.lit(1)
    n_rows, n_cols = F.coalesce("_rows", one), F.coalesce("_cols", one)
    row_of, col_of = (F.pmod(F.xxhash64("rep", F.lit(s)), n).cast("int") for s, n in ((1, n_rows), (2, n_cols)))
    kept = ("v", "rep", "weight", "dims", "cell")
    home_rows = placed.select(*kept).join(plan, on, "left")
    lines = home_rows.select(
        *kept,
        row_of.alias("i"),
        F.explode(F.sequence(F.lit(0), n_cols - 1)).alias("k"),
        F.lit(True).alias("row"),
        F.lit(True).alias("own"),
    )
    spread = placed.mapInArrow(copies, "v array<double>, dims int, rep long, weight long, cell int").join(plan, on, "left")
    columns = home_rows.withColumn("own", F.lit(True)).unionByName(spread.withColumn("own", F.lit(False)))
    columns = columns.select(
        *kept,
        F.explode(F.sequence(F.lit(0), n_rows - 1)).alias("i"),
        col_of.alias("k"),
        F.lit(False).alias("row"),
        "own",
    )
    return lines.union(columns).groupBy("dims", "cell", "i", "k").applyInArrow(comparison(cosine), LINKS)
