"""Operator 12: nearest neighbours through randomly rotated one-bit codes and their error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, materialize, pieces

#: Vectors that the coarse centres are fitted on, at most, over all lengths; centres of a length, at most.
SAMPLE, CENTRES = 32_768, 1024
#: Width of the error bound in standard deviations.
WIDTH = 4.0
SLACK = 1e-9
FOUND = "asked long, rep long, ids array<long>, distance double"
_CODED = "dims int, cell int, rep long, ids array<long>, v array<double>, bits binary, norm double, fit double"


def rotation(dims: int, seed: int = 12) -> np.ndarray:
    """A random orthonormal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits of the rotated rows, lengths, fits). The fit is the inner product of the rotated unit row with its
    code, the vector of its signs over sqrt(dims): what an estimate must be divided by."""
    dims = residuals.shape[1]
    norm = np.sqrt(np.einsum("ij,ij->i", residuals, residuals))
    turned = (residuals / np.where((norm > 0) & np.isfinite(norm), norm, 1.0)[:, None]) @ rotation(dims).T
    fit = np.abs(turned).sum(axis=1) / np.sqrt(dims)
    return np.packbits(turned > 0, axis=1), norm, np.where((norm > 0) & np.isfinite(norm), fit, 1.0)


def bounds(bits, norm, fit, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated, least plausible) squared distances of queries (rows of ``residuals``) to coded vectors.

    With o the unit row, c its code, f = <o, c> and q the unit query, <c, q> / f is an unbiased estimate of <o, q>; its error
    is below WIDTH * sqrt((1 - f^2) / f^2 / (dims - 1)) but for some 3 in 100,000 estimates, and never above the exact
    bound from |q| = 1, which takes its place where it is sharper.
    """
    dims = residuals.shape[1]
    length = np.sqrt(np.einsum("ij,ij->i", residuals, residuals))
    turned = (residuals / np.where(length > 0, length, 1.0)[:, None]) @ rotation(dims).T
    signs = np.unpackbits(bits, axis=1, count=dims).astype(np.float64) * 2 - 1
    inner = (turned @ signs.T) / np.sqrt(dims)
    rest = np.sqrt(np.maximum(0.0, 1 - fit * fit))
    about = inner / fit
    most = np.minimum(
        about + WIDTH * rest / fit / np.sqrt(max(1, dims - 1)),
        fit * inner + rest * np.sqrt(np.maximum(0.0, 1 - inner * inner)),
    )
    squares = length[:, None] ** 2 + norm[None, :] ** 2
    both = 2 * length[:, None] * norm[None, :]
    return squares - both * about, squares - both * np.minimum(most, 1.0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to rows: squares are added from the first component to the last."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for d in range(a.shape[1]):
            total += (a[:, d] - b[:, d]) ** 2
    return np.sqrt(total)


def _matrix(lists, dims: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, each once."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
    ).where("id IS NOT NULL AND v IS NOT NULL")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~odd & F.exists("v", lambda x: x != 0)).distinct()


def fit_centres(classes: DataFrame, per_cell: int, rounds: int = 5) -> dict[int, np.ndarray]:
    """Coarse centres for the (at most 64) most frequent lengths of more than ``per_cell`` vectors: Lloyd rounds on a
    sample by hash, about SAMPLE vectors over all lengths. Every other length has one cell, around zero. Centres steer
    the work, not the result."""
    many = classes.groupBy("dims").count().where(F.col("count") > per_cell).orderBy(F.desc("count"), "dims").limit(64)
    sizes = {r[0]: r[1] for r in many.collect()}
    if not sizes:
        return {}
    share = int(min(1.0, SAMPLE / sum(sizes.values())) * (1 << 20)) + 1
    drawn = classes.where(F.col("dims").isin(*sizes) & (F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 20)) < share))
    rows = drawn.orderBy("rep").limit(2 * SAMPLE).select("dims", "v").toArrow()
    lengths, out = rows["dims"].to_numpy(), {}
    for dims, n in sizes.items():
        x = _matrix(rows["v"].filter(pa.array(lengths == dims)), dims)
        with np.errstate(over="ignore"):
            x = x[np.isfinite(np.einsum("ij,ij->i", x, x))]
        k = min(CENTRES, pieces(n, per_cell), len(x))
        if k < 2:
            continue
        centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(rounds):
            near = _squares(x, centres).argmin(axis=1)
            count, sums = np.bincount(near, minlength=k), np.zeros_like(centres)
            np.add.at(sums, near, x)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        out[int(dims)] = centres
    return out


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        own = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", centres, centres)[None, :]
        return np.maximum(0.0, own - 2 * (x @ centres.T))


def coder(shared):
    """Function of a task: cell and code of every class."""

    def run(batches):
        for batch in batches:
            lengths = batch.column("dims").to_numpy()
            for dims in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dims))
                x = _matrix(part.column("v"), dims)
                centres = shared.value.get(int(dims), np.zeros((1, dims)))
                cell = _squares(x, centres).argmin(axis=1)
                with np.errstate(over="ignore", invalid="ignore"):
                    bits, norm, fit = encode(x - centres[cell])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("dims"), pa.array(cell.astype(np.int32)), part.column("rep"), part.column("ids"),
                        part.column("v"), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(norm), pa.array(fit),
                    ],
                    names=["dims", "cell", "rep", "ids", "v", "bits", "norm", "fit"],
                )

    return run


def router(shared, sizes, enough: int, first: bool):
    """Function of a task: the cells that each query meets, the nearest ones in the first round, in the second all others
    that may hold a vector within ``most``. ``sizes`` has (vectors, radii) of a length's cells."""

    def run(batches):
        for batch in batches:
            lengths, most = batch.column("dims").to_numpy(), batch.column("most").to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths):
                own = np.flatnonzero(lengths == dims)
                part = batch.take(pa.array(own))
                if int(dims) not in shared.value:
                    near, far = np.zeros((len(own), 1), np.int64), np.zeros((len(own), 1))
                    before, radius = far, np.zeros(1)
                else:
                    count, radius = sizes.value[int(dims)]
                    far = np.sqrt(_squares(_matrix(part.column("v"), dims), shared.value[int(dims)]))
                    near = np.argsort(far, axis=1, kind="stable")
                    before = np.cumsum(count[near], axis=1) - count[near]
                taken = before < enough
                if not first:
                    limit = np.where(np.isnan(most[own]), np.inf, most[own])[:, None]
                    apart = np.take_along_axis(far, near, 1) - radius[near]
                    taken = ~taken & ~(apart > limit * (1 + SLACK) + SLACK * (1 + np.take_along_axis(far, near, 1)))
                line, at = np.nonzero(taken)
                for k in range(0, len(line), 1 << 13):
                    rows = part.take(pa.array(line[k : k + (1 << 13)]))
                    cells = near[line[k : k + (1 << 13)], at[k : k + (1 << 13)]].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("asked"), rows.column("v"), rows.column("dims"), pa.array(cells), rows.column("most")],
                        names=["asked", "v", "dims", "cell", "most"],
                    )

    return run


def scanner(shared, k: int):
    """Function of a block of codes and a block of queries: the ``k + 1`` nearest classes of each query that are within its
    limit."""

    def measured(q, x, i, j):
        parts = [distances(q[i[a : a + (1 << 14)]], x[j[a : a + (1 << 14)]]) for a in range(0, len(i), 1 << 14)]
        return np.concatenate([np.empty(0), *parts])

    def run(codes: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if codes.num_rows and asked.num_rows:
            dims, cell = codes["dims"][0].as_py(), codes["cell"][0].as_py()
            x, q = _matrix(codes["v"], dims), _matrix(asked["v"], dims)
            bits = np.frombuffer(b"".join(codes["bits"].to_pylist()), np.uint8).reshape(len(x), -1)
            norm, fit, rep = (codes[c].to_numpy() for c in ("norm", "fit", "rep"))
            lists = codes["ids"].combine_chunks()
            least_id = lists.flatten().to_numpy()[np.r_[0, np.cumsum(lists.value_lengths().to_numpy())[:-1]]]
            most, names = asked["most"].to_numpy(), asked["asked"].to_numpy()
            most = np.where(np.isnan(most), np.inf, most)
            centre = shared.value.get(dims, np.zeros((1, dims)))[cell]
            width = max(1, (1 << 20) // len(x))
            for a in range(0, len(q), width):
                with np.errstate(over="ignore", invalid="ignore"):
                    about, least = bounds(bits, norm, fit, q[a : a + width] - centre)
                top = np.argpartition(about, min(k, len(x) - 1), axis=1)[:, : k + 1]
                i, j = np.repeat(np.arange(len(about)), top.shape[1]), top.ravel()
                d = measured(q[a : a + width], x, i, j)
                limit = most[a : a + width]
                if top.shape[1] == k + 1:
                    limit = np.minimum(limit, d.reshape(top.shape).max(axis=1))
                with np.errstate(over="ignore"):
                    rest = ~(least > (limit * (1 + SLACK) + SLACK)[:, None] ** 2)
                rest[i, j] = False
                i2, j2 = np.nonzero(rest)
                i, j, d = np.r_[i, i2], np.r_[j, j2], np.r_[d, measured(q[a : a + width], x, i2, j2)]
                order = np.lexsort((rep[j], least_id[j], d, i))
                i, j, d = i[order], j[order], d[order]
                held = (np.arange(len(i)) - np.searchsorted(i, i) <= k) & (d <= most[a + i])
                found.append((names[a + i[held]], j[held], d[held]))
        ask, line, far = (np.concatenate([np.empty(0, t), *(f[n] for f in found)]) for n, t in enumerate("qqd"))
        some = codes.select(["rep", "ids"]).take(pa.array(line)) if len(line) else codes.select(["rep", "ids"]).slice(0, 0)
        return pa.table({"asked": pa.array(ask), "rep": some["rep"], "ids": some["ids"], "distance": pa.array(far)})

    return run


def meet(asked: DataFrame, coded: DataFrame, shared, sizes, counts: dict, k: int, block: int, first: bool) -> DataFrame:
    """(asked, rep, ids, distance) of the queries (asked, v, dims, most) in the cells that ``router`` gives them."""
    routed = materialize(
        asked.select("asked", "v", "dims", "most").mapInArrow(
            router(shared, sizes, 8 * k, first), "asked long, v array<double>, dims int, cell int, most double"
        ),
        "routed",
    )
    crowded = routed.groupBy("dims", "cell").count().where(F.col("count") > block).collect()  # of at most all cells
    waiting = {(r[0], r[1]): r[2] for r in crowded}
    plan = [
        (*key, pieces(counts.get(key, 1), block), pieces(waiting.get(key, 1), block))
        for key in sorted(set(waiting) | {c for c, n in counts.items() if n > block})
    ]
    cut = F.broadcast(asked.sparkSession.createDataFrame(plan, "dims int, cell int, _i int, _j int"))
    one = F.lit(1)

    def dealt(df: DataFrame, name: str, own: str, other: str, own_key: str, other_key: str) -> DataFrame:
        rows = df.join(cut, ["dims", "cell"], "left")
        place = F.pmod(F.xxhash64(name), F.coalesce(own, one)).cast("int").alias(own_key)
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)).alias(other_key)
        return rows.select(*df.columns, place, copies).groupBy("dims", "cell", "i", "j")

    codes = dealt(coded, "rep", "_i", "_j", "i", "j")
    return codes.cogroup(dealt(routed, "asked", "_j", "_i", "j", "i")).applyInArrow(scanner(shared, k), FOUND)


def nearest(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    per_cell: int = 2048,
    block: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows, by Euclidean distance in double precision, of every row whose
    id is divisible by ``every``, the row itself left out; ties go to the smaller id.

    Identical vectors are one class with its ``k + 1`` smallest ids, which is all that any query can be given of them.
    A class belongs to the cell of its nearest coarse centre and has the code of its residual: a bit for each
    component after a random rotation, its length and its fit. A query first meets its nearest cells, as many as hold
    ``8 * k`` classes; the k-th distance found there is its limit. Then it meets every other cell that the triangle
    inequality allows to hold anything nearer. Where a query meets a cell, estimates order the cell's codes, the best
    are measured, and of the rest those whose error bound reaches below the limit so far. Cells and their queries are
    dealt to blocks of about ``block`` rows on either side, so a cell of any size is spread over many tasks.

    Rows with a null id take no part, nor do vectors that are null, empty or zero or hold null or non-finite
    components; vectors of different lengths do not meet. Rows equal in id and vector are one; rows of one id with
    unlike vectors are candidates each and queries each, ranked apart. A query without any candidate has no rows.
    Vectors whose squares overflow are always measured. An empty table gives no rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    asks = F.pmod("id", F.lit(every)) == 0
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("_n", place).where(F.col("_n") <= k + 1).groupBy("v")
    asked_by = rows.where(asks).groupBy("v").agg(F.count("*").alias("asks"))
    classes = few.agg(F.sort_array(F.collect_list("id")).alias("ids")).join(asked_by, "v", "left")
    numbered = classes.select("*", F.size("v").alias("dims"), F.monotonically_increasing_id().alias("rep"))
    classes = materialize(numbered, "classes")
    centres = fit_centres(classes, per_cell)
    shared = spark.sparkContext.broadcast(centres)
    coded = materialize(classes.select("dims", "v", "ids", "rep").mapInArrow(coder(shared), _CODED), "codes")
    cells = coded.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("norm").alias("radius"))
    told = cells.where((F.col("n") > block) | F.col("dims").isin(*centres)).collect()  # centres, and lengths of many rows
    counts = {(r.dims, r.cell): r.n for r in told}
    by_length = {d: (np.zeros(len(c), np.int64), np.full(len(c), -np.inf)) for d, c in centres.items()}
    for r in told:
        if r.dims in by_length:
            by_length[r.dims][0][r.cell], by_length[r.dims][1][r.cell] = r.n, r.radius
    sizes = spark.sparkContext.broadcast(by_length)
    asked = classes.where("asks > 0").select(F.col("rep").alias("asked"), "v", "dims")
    start = asked.withColumn("most", F.lit(None).cast("double"))
    first = materialize(meet(start, coded, shared, sizes, counts, k, block, True), "first")
    by_distance = F.row_number().over(Window.partitionBy("asked").orderBy("distance"))
    kth = first.select("asked", "distance").withColumn("_n", by_distance).where(F.col("_n") == k + 1)  # itself is the first
    limited = asked.join(kth.select("asked", F.col("distance").alias("most")), "asked", "left")
    second = meet(limited, coded, shared, sizes, counts, k, block, False)
    order = Window.partitionBy("asked").orderBy("distance", F.col("ids")[0], "rep")
    best = first.unionByName(second).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    found = F.collect_list(F.struct("distance", "ids", (F.col("rep") == F.col("asked")).alias("own"))).alias("found")
    answers = best.groupBy("asked").agg(found)  # k + 1 classes
    answered = classes.where("asks > 0").join(answers, F.col("rep") == F.col("asked"))
    answered = materialize(answered.select("v", F.col("asks").alias("_n"), "found"), "answers")
    queries = materialize(rows.where(asks), "queries")
    met = join_groups(queries, answered, "v", "_n", stored=True)

    def ids_of(f):
        others = F.filter(f.ids, lambda i: ~f.own | (i != F.col("id")))
        return F.transform(others, lambda i: F.struct(f.distance.alias("score"), i.alias("vec_id")))

    ranked = F.slice(F.array_sort(F.flatten(F.transform("found", ids_of))), 1, k)
    top = met.select("id", F.posexplode(ranked).alias("at", "x"))
    return top.select(
        F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"
    )
