"""Trained text vectors: BM25 weights over hashed terms, and a randomized singular value decomposition of the term matrix."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .embedding import terms

#: Terms are told apart by so many hash values; it bounds the model and all that reaches the driver, at any size.
FEATURES = 1 << 16
#: Constants of the BM25 weight; directions drawn beyond those that are kept.
K1, B, BEYOND = 1.2, 0.75, 16
HELD = 1 << 16  # entries of the term matrix worked on at a time


def features(text: Column) -> Column:
    """The hashed term of each of a text's terms, in order."""
    return F.transform(terms(text), lambda t: F.crc32(t.cast("binary")).bitwiseAND(F.lit(FEATURES - 1).cast("long")).cast("int"))


def term_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(feature, df, idf) for every hashed term of ``docs``: documents that hold it, and its BM25 inverse frequency. Null texts
    count as documents without terms."""
    n = docs.count()
    each = docs.select(F.explode(F.array_distinct(features(F.col(text_col)))).alias("feature"))
    held = each.groupBy("feature").agg(F.count("*").alias("df"))
    return held.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def _entries(lists: pa.Array, idf: np.ndarray, average: float):
    """(row, feature, weight) of the term matrix for a batch of feature lists, some HELD at a time; rows have unit length."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    first = 0
    while first < len(lists):
        start = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, start + HELD, "right")))
        owner = np.repeat(np.arange(first, last), lengths[first:last])
        key, count = np.unique(owner * FEATURES + flat[start : ends[last - 1]], return_counts=True)
        row, feature = key // FEATURES, key % FEATURES
        weight = idf[feature] * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[row] / average))
        norm = np.sqrt(np.bincount(row, weight * weight, len(lists)))
        yield first, last, row, feature, weight / np.maximum(norm[row], 1e-300)
        first = last


def _sums(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(groups, sums of the values of each); ``group`` ascends."""
    if not len(group):
        return group, values
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return group[starts], np.add.reduceat(values, starts, axis=0)


def _project(first: int, last: int, row, feature, weight, matrix: np.ndarray) -> np.ndarray:
    out = np.zeros((last - first, matrix.shape[1]))
    own, sums = _sums(row - first, weight[:, None] * matrix[feature])
    out[own] = sums
    return out


@dataclass
class TrainedTerms:
    """An embedding provider: dense vectors of ``matrix`` (FEATURES x dims), sparse ones of BM25 weights."""

    idf: np.ndarray
    average: float
    matrix: np.ndarray

    def embed(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``df`` with dense (unit length; null without known terms) and sparse (hashed term -> weight; texts of unit length)."""
        shared = df.sparkSession.sparkContext.broadcast((self.idf, self.average, self.matrix))
        given = df.withColumn("_features", features(F.col(text_col)))
        schema = df.schema.fieldNames()
        kept = given.select(*schema, "_features")

        def run(batches):
            idf, average, matrix = shared.value
            for batch in batches:
                lists = batch.column(batch.num_columns - 1)
                for first, last, row, feature, weight in _entries(lists, idf, average):
                    x = _project(first, last, row, feature, weight, matrix)
                    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                    fine = norm > 0
                    x[fine] /= norm[fine, None]
                    ends = np.r_[0, np.cumsum(np.where(fine, x.shape[1], 0))].astype(np.int32)
                    dense = pa.ListArray.from_arrays(
                        pa.array(ends), pa.array(x[fine].ravel().astype(np.float32)), mask=pa.array(~fine)
                    )
                    offsets = np.searchsorted(row, np.arange(first, last + 1)).astype(np.int32)
                    sparse = pa.MapArray.from_arrays(
                        pa.array(offsets), pa.array(feature.astype(np.int64)), pa.array(weight.astype(np.float32))
                    )
                    own = batch.slice(first, last - first)
                    yield pa.RecordBatch.from_arrays(
                        [*own.columns[:-1], dense, sparse], names=[*schema, "dense", "sparse"]
                    )

        out = [
            *df.schema.fields,
            T.StructField("dense", T.ArrayType(T.FloatType())),
            T.StructField("sparse", T.MapType(T.LongType(), T.FloatType())),
        ]
        return kept.mapInArrow(run, T.StructType(out))


def _step(batches, shared, size: int):
    """One task's part of A' (A M), a row for each feature that it has met: the sums are made before anything is shuffled."""
    idf, average, matrix = shared.value
    total, met = np.zeros((FEATURES, size)), np.zeros(FEATURES, bool)
    for batch in batches:
        for first, last, row, feature, weight in _entries(batch.column(0), idf, average):
            y = _project(first, last, row, feature, weight, matrix)
            order = np.argsort(feature, kind="stable")
            own, sums = _sums(feature[order], weight[order, None] * y[row[order] - first])
            total[own] += sums
            met[own] = True
    at = np.flatnonzero(met)
    for i in range(0, len(at), 4096):
        part = at[i : i + 4096]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), *(pa.array(total[part, c]) for c in range(size))],
            names=["feature", *(f"c{c}" for c in range(size))],
        )


def _gram(batches, shared, size: int):
    """One task's part of (A M)' (A M)."""
    idf, average, matrix = shared.value
    total = np.zeros((size, size))
    for batch in batches:
        for parts in _entries(batch.column(0), idf, average):
            y = _project(*parts, matrix)
            total += y.T @ y
    at = np.arange(size * size, dtype=np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "x"])


def fit_terms(docs: DataFrame, write, dims: int = 64, rounds: int = 2, text_col: str = "text", seed: int = 5) -> TrainedTerms:
    """Document frequencies and the ``dims`` leading right singular directions of the BM25 matrix of all ``docs``.

    Block randomized iteration: a random matrix is taken through A' A ``rounds`` times, made orthonormal in between;
    what A makes of the last basis gives its singular directions within it. Each pass is one scan, in which a task
    keeps sums for FEATURES terms, and one aggregation of as many rows; the driver gets FEATURES rows of ``dims`` +
    BEYOND numbers a pass, however many documents there are. ``write`` stores the hashed terms once.
    """
    spark = docs.sparkSession
    lists = write(docs.select(features(F.col(text_col)).alias("f")))
    n, words = lists.agg(F.count("*"), F.sum(F.greatest(F.size("f"), F.lit(0)))).first()
    average = (words or 0) / n if words else 1.0
    each = lists.select(F.explode(F.array_distinct("f")).alias("feature")).groupBy("feature").agg(F.count("*").alias("df"))
    known = each.toArrow()
    idf, df = np.zeros(FEATURES), known["df"].to_numpy()
    idf[known["feature"].to_numpy()] = np.log(1 + (n - df + 0.5) / (df + 0.5))
    size = min(dims + BEYOND, max(1, len(df)))
    basis = np.random.default_rng(seed).standard_normal((FEATURES, size))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((idf, average, basis))
        columns = [f"c{c}" for c in range(size)]
        parts = lists.mapInArrow(
            partial(_step, shared=shared, size=size), "feature int, " + ", ".join(f"{c} double" for c in columns)
        )
        summed = parts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
        image = np.zeros((FEATURES, size))
        image[summed["feature"].to_numpy()] = np.column_stack([summed[c].to_numpy() for c in columns])
        basis = np.linalg.qr(image)[0]
    shared = spark.sparkContext.broadcast((idf, average, basis))
    gram = lists.mapInArrow(partial(_gram, shared=shared, size=size), "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    found, values = gram.toArrow(), np.zeros(size * size)
    values[found["at"].to_numpy()] = found["x"].to_numpy()
    _, directions = np.linalg.eigh(values.reshape(size, size))
    return TrainedTerms(idf, average, basis @ directions[:, ::-1][:, :dims])

