"""Dense top-k over a table laid out by cells of near vectors: cells are read while they can still hold a better row."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared
from .retrieval import Best

#: Vectors that the centres are fitted on at most, and centres at most.
SAMPLE, CENTRES = 32_768, 4096
DIGITS = 12
#: Numbers of a block that is in memory at a time, and queries that meet a block of rows at a time.
NUMBERS, QUERIES = 1 << 20, 1 << 15


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-300)


def _matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _blocks(rows: int, columns: int) -> list[slice]:
    """Slices of ``rows`` rows in which ``columns`` numbers a row make about NUMBERS."""
    step = max(1, NUMBERS // max(1, columns))
    return [slice(i, i + step) for i in range(0, rows, step)]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, cosine) of the nearest centre of each row."""
    cell, own = np.empty(len(x), np.int64), np.empty(len(x))
    for some in _blocks(len(x), len(centres)):
        near = x[some] @ centres.T
        cell[some] = near.argmax(axis=1)
        own[some] = near[np.arange(len(near)), cell[some]]
    return cell, own


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (double) of the vectors that have a direction."""
    v = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(~odd & F.exists("v", lambda x: x != 0))


def fit_centres(vectors: DataFrame, n: int, per_cell: int, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors by spherical k-means over a sample by hash of about SAMPLE rows."""
    share = int(min(1.0, SAMPLE / max(1, n)) * (1 << 20)) + 1
    drawn = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).orderBy("id").limit(2 * SAMPLE)
    lists = drawn.select("v").toArrow()["v"]
    if not len(lists):
        return np.zeros((1, 1))
    x = _unit(_matrix(lists, len(lists[0])))
    k = min(CENTRES, max(1, -(-n // per_cell)), len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near, _ = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(np.einsum("ij,ij->i", sums, sums)[:, None] > 0, _unit(sums), centres)
    return centres


def _grouped(n: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, parts) of each cell, given the rows of all: cells that follow each other share a group of at most ``block`` rows;
    a larger cell has a group of its own, in as many parts as it fills blocks."""
    group, held = np.zeros(len(n), np.int64), 0
    for c, m in enumerate(n):
        fits = c > 0 and held + m <= block
        group[c] = (group[c - 1] + (not fits)) if c else 0
        held = held + m if fits else m
    return group, np.maximum(1, -(-n // block))


@dataclass
class VectorCells:
    """A folder of vectors, partitioned by the cell of the nearest centre, with the centres in a file. New rows go to the cells
    that are there (``append``); ``build`` fits the centres anew."""

    spark: SparkSession
    path: str

    def build(self, rows: DataFrame, id_col: str = "chunk_uuid", vector_col: str = "dense", per_cell: int = 2048) -> VectorCells:
        """Fit centres and lay out ``rows``; all vectors have one length. Null, zero and non-finite ones are left out."""
        vectors = usable(rows, id_col, vector_col)
        n, least, most = vectors.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
        if least != most:
            raise ValueError(f"vectors of {least} and of {most} dimensions")
        centres = fit_centres(vectors, n, per_cell)
        if not shared.put_if_absent(self.spark, f"{self.path}/centres.json", json.dumps(centres.tolist()).encode()):
            raise ValueError(f"{self.path} holds an index already")
        self._lay(vectors, centres)
        return self

    def append(self, rows: DataFrame, id_col: str = "chunk_uuid", vector_col: str = "dense") -> None:
        self._lay(usable(rows, id_col, vector_col), self.centres())

    def centres(self) -> np.ndarray:
        return np.array(json.loads(shared.read_bytes(f"{self.path}/centres.json")))

    def _lay(self, vectors: DataFrame, centres: np.ndarray) -> None:
        given = self.spark.sparkContext.broadcast(centres)
        schema = T.StructType([*vectors.schema.fields, T.StructField("cosine", T.DoubleType()), T.StructField("cell", T.IntegerType())])

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    cell, own = _nearest(_unit(_matrix(batch.column("v"), given.value.shape[1])), given.value)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(own), pa.array(cell.astype(np.int32))], names=schema.fieldNames()
                    )

        laid = vectors.mapInArrow(place, schema).hint("rebalance", "cell").sortWithinPartitions("cell")
        laid.write.mode("append").partitionBy("cell").parquet(f"{self.path}/cells")

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows, widest angle) of each cell: a row a cell reaches the driver."""
        n, angle = np.zeros(len(self.centres()), np.int64), np.full(len(self.centres()), -np.inf)
        for r in self.table().groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).collect():
            n[r.cell], angle[r.cell] = r.n, np.arccos(np.clip(r.least, -1, 1))
        return n, angle

    def top_k(self, queries: DataFrame, k: int, write, probes: int | None = None, block: int = 8192) -> tuple[DataFrame, DataFrame]:
        """(rows, reach). Rows: query_id, id, score (cosine, to 12 digits), rank of the ``k`` best for every query
        (query_id, vector); ties break by the id. Reach: query_id, n_read, n_held.

        Every query reads its nearest cells, as many as hold ``4 * k`` rows; the k-th best cosine there is its floor.
        Then it reads each other cell whose bound beats the floor: no row of a cell is nearer to the query than their
        centre is, less the cell's widest angle. With ``probes`` it reads that many nearest cells and no others:
        fewer rows, and a recall to be measured. Queries meet cells by a shuffle: neighbouring cells make groups of up to
        ``block`` rows (a larger cell is cut into parts), to which a query goes once, with its cells there. A group
        meets about QUERIES queries at a time and puts out ``k`` rows a query.
        """
        centres, (n, angle) = self.centres(), self.sizes()
        tasks = 4 * self.spark.sparkContext.defaultParallelism
        group, parts = _grouped(n, max(1, min(block, max(256, -(-int(n.sum()) // tasks)))))  # smaller ones keep all cores busy
        dims, shape = centres.shape[1], self.spark.sparkContext.broadcast((centres, n, angle, group, parts))
        asked = usable(queries, "query_id", "vector").where(F.size("v") == dims)
        turns = max(1, -(-asked.count() // QUERIES))
        kinds = {"query_id": queries.schema["query_id"].dataType, "id": self.table().schema["id"].dataType}
        routed_schema = T.StructType(
            [T.StructField("query_id", kinds["query_id"]), T.StructField("v", T.ArrayType(T.DoubleType())),
             T.StructField("floor", T.DoubleType()), T.StructField("cells", T.ArrayType(T.IntegerType())),
             T.StructField("group", T.IntegerType()), T.StructField("part", T.IntegerType())]
        )
        found_schema = T.StructType(
            [T.StructField("query_id", kinds["query_id"]), T.StructField("id", kinds["id"]), T.StructField("score", T.DoubleType())]
        )

        def router(first: bool):
            def wanted(q, floor, centres, n, angle):
                """(query, cell) of the cells that queries read, in order."""
                apart = np.arccos(np.clip(q @ centres.T, -1, 1))
                order = np.argsort(apart, axis=1, kind="stable")
                held = n[order]
                before = np.cumsum(held, axis=1) - held
                near = np.arange(len(centres))[None, :] < probes if probes else before < 4 * k
                if not first:
                    most = np.cos(np.maximum(0.0, np.take_along_axis(apart, order, 1) - angle[order]))
                    near = ~near & (most >= floor[:, None] - 1e-9)
                read = np.zeros(apart.shape, bool)
                np.put_along_axis(read, order, near & (held > 0), 1)
                return np.nonzero(read)

            def route(batches):
                centres, n, angle, group, parts = shape.value
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    q = _unit(_matrix(batch.column("v"), dims))
                    floor = batch.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                    floor = np.where(np.isnan(floor), -1.0, floor)
                    for some in _blocks(len(q), len(centres)):
                        line, cell = wanted(q[some], floor[some], centres, n, angle)
                        starts = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(group[cell], prepend=-1) != 0))
                        lists = pa.ListArray.from_arrays(
                            pa.array(np.r_[starts, len(cell)].astype(np.int32)), pa.array(cell.astype(np.int32))
                        )
                        times = parts[cell[starts]]
                        entry = np.repeat(np.arange(len(starts)), times)
                        part = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
                        for i in range(0, len(entry), 1 << 13):
                            at = entry[i : i + (1 << 13)]
                            rows = batch.take(pa.array(line[starts[at]] + some.start))
                            yield pa.RecordBatch.from_arrays(
                                [rows.column("query_id"), rows.column("v"), rows.column("floor"), lists.take(pa.array(at)),
                                 pa.array(group[cell[starts[at]]].astype(np.int32)), pa.array(part[i : i + (1 << 13)].astype(np.int32))],
                                names=routed_schema.fieldNames(),
                            )

            return route

        def scan(rows: pa.Table, asked: pa.Table) -> pa.Table:
            best, ids, names = Best(asked.num_rows, k, DIGITS), rows["id"].combine_chunks(), asked["query_id"].combine_chunks()
            if rows.num_rows and asked.num_rows:
                order = pa.compute.sort_indices(ids).to_numpy()  # so that places follow ids
                x, ids = _unit(_matrix(rows["v"], dims))[order], ids.take(pa.array(order))
                q, lists = _unit(_matrix(asked["v"], dims)), asked["cells"].combine_chunks()
                best.floor = np.nan_to_num(asked["floor"].to_numpy().astype(np.float64), nan=-np.inf)
                line = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
                cell = lists.flatten().to_numpy()
                line = line[np.argsort(cell, kind="stable")]
                cell, own = np.sort(cell), rows["cell"].to_numpy()[order]
                places, own = np.argsort(own, kind="stable"), np.sort(own)
                for c in np.unique(own):
                    at = places[slice(*np.searchsorted(own, (c, c + 1)))]
                    asking = line[slice(*np.searchsorted(cell, (c, c + 1)))]
                    for some in _blocks(len(asking), len(at)):
                        best.offer(q[asking[some]] @ x[at].T, at, asking[some])
                best.merge()
            line, at, score = best.kept or (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            return pa.table({"query_id": names.take(pa.array(line)), "id": ids.take(pa.array(at)), "score": pa.array(score)})

        shapes = [(i, int(m), int(g), int(p)) for i, (m, g, p) in enumerate(zip(n, group, parts, strict=True))]
        told = F.broadcast(self.spark.createDataFrame(shapes, "cell int, n long, group int, parts int"))  # at most CENTRES rows
        dealt = self.table().select("id", "v", "cell").join(told.drop("n"), "cell")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        keys = ("group", "part", "turn")

        def met(routed: DataFrame) -> DataFrame:
            cells = [r[0] for r in routed.select(F.explode("cells")).distinct().collect()]  # at most CENTRES; the scan skips all others
            some = dealt.where(F.col("cell").isin(cells)) if cells else dealt.where("false")
            some = some.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
            routed = routed.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int"))
            return some.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(scan, found_schema)

        start = asked.select(F.col("id").alias("query_id"), "v", F.lit(None).cast("double").alias("floor"))
        first = write(start.mapInArrow(router(True), routed_schema))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        found, read = write(met(first)), first
        if not probes:
            kth = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k)
            limited = start.drop("floor").join(kth.select("query_id", F.col("score").alias("floor")), "query_id", "left")
            second = write(limited.mapInArrow(router(False), routed_schema))
            found, read = found.unionByName(met(second)), first.unionByName(second)
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        reach = read.select("query_id", F.explode("cells").alias("cell")).distinct().join(told, "cell")
        return top, reach.groupBy("query_id").agg(F.sum("n").alias("n_read"), F.lit(int(n.sum())).alias("n_held"))
