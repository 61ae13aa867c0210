"""Embedding providers: precomputed columns, hashed terms (a surrogate in SQL), or a pandas UDF of the user's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

TERM = r"[a-z0-9]+|[一-鿿]{2,}"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def term_weights(text: Column) -> Column:
    """Sparse vector: hash of each term -> how often it occurs."""

    def counted(found, starts):
        return F.map_from_entries(
            F.transform(
                starts,
                lambda i, k: F.struct(
                    F.get(found, i), (F.coalesce(F.get(starts, k + 1), F.size(found)) - i).cast("float")
                ),
            )
        )

    def runs(found):
        heads = F.filter(
            F.transform(found, lambda t, i: F.when((i == 0) | (t != F.get(found, i - 1)), i)), lambda i: i.isNotNull()
        )
        return let(heads, lambda starts: counted(found, starts))

    return let(F.sort_array(F.transform(terms(text), lambda t: F.xxhash64(t))), runs)


def term_vector(text: Column, dims: int) -> Column:
    """Dense vector: term counts in ``dims`` buckets of the hash."""
    bucket = F.transform(terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)))
    return let(
        bucket,
        lambda own: F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(own, lambda b: b == i)).cast("float")
        ),
    )


@dataclass
class HashedTerms:
    """Deterministic surrogate for an embedding model; it stays in the JVM. Not a model: scores mean shared terms."""

    dims: int = 64

    def embed(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return df.withColumns(
            {"dense": term_vector(F.col(text_col), self.dims), "sparse": term_weights(F.col(text_col))}
        )


@dataclass
class Precomputed:
    """Vectors joined from a table: key, dense and optionally sparse."""

    vectors: DataFrame
    key: str

    def embed(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        vectors = (
            self.vectors
            if "sparse" in self.vectors.columns
            else self.vectors.withColumn("sparse", F.create_map().cast("map<bigint,float>"))
        )
        return df.join(vectors.select(self.key, "dense", "sparse"), self.key)


@dataclass
class ModelUdf:
    """A pandas UDF from text to array<float>; sparse vectors are empty unless a second UDF gives them."""

    dense: Callable
    sparse: Callable | None = None

    def embed(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        sparse = self.sparse(F.col(text_col)) if self.sparse else F.create_map().cast("map<bigint,float>")
        return df.withColumns({"dense": self.dense(F.col(text_col)), "sparse": sparse})


def embed_query(spark, provider, query: str) -> tuple[list[float], dict[int, float]]:
    """Vectors of one query text, on the driver."""
    row = provider.embed(spark.createDataFrame([(query,)], "text string")).select("dense", "sparse").first()
    return list(row[0]), dict(row[1] or {})


def check_dimension(df: DataFrame, dims: int, column: str = "dense") -> None:
    """Raise if any vector has another length; nothing is dropped or rebuilt."""
    wrong = df.where(F.size(column) != dims).select(F.size(column)).first()
    if wrong:
        raise ValueError(f"vectors of {wrong[0]} dimensions where {dims} are stored")
