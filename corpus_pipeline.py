"""Corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing of sources, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it back as the next stage's docs. All stages but the last return the columns of ``documents``; extra
columns of the input are left out. An empty table passes through every stage as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, exact, langid, minhash, mixing
from docquarry.llm.common import WORD, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least certainty of the language at which a document stays.
MIN_SCORE = 0.4


def _known(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` alone, so that no other column can clash with one made here."""
    return docs.select(*(c for c in COLUMNS if c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language: null, empty or without a letter, or certainty below MIN_SCORE.

    Whole texts of any length decide, and they alone: rows of equal texts stay or go together, whatever their ids,
    null or repeated. A null lang is not learned from; without any labels every document goes.
    """
    docs = _known(docs)
    found = langid.identify(docs, langid.train(docs, ~langid.held_out()), out="_language")
    sure = (F.col("_language.lang_pred") != "und") & (F.col("_language.score") >= MIN_SCORE)
    return _known(found.where(sure))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty, whole texts of any length) keep the document with the largest id.

    A document is its id and text: rows equal in both are one document and stay together, other texts of the same id
    are judged by themselves. A null id loses to any other; where all ids of a text are null its rows all stay.
    """
    kept = (
        exact.exact_dedup(docs)
        .where("kept")
        .select(F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_kept_sha"))
        .distinct()
    )
    named = _known(docs).withColumn("_sha", exact.text_sha256(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_sha") == F.col("_kept_sha"))
    return _known(named.join(kept, same, "left_semi"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, 80 %, whole texts) stays: the smallest id.

    Texts without words are in no group and stay, so do rows with a null id; rows of one id stay or go together.
    """
    gone = (
        minhash.near_duplicates(docs, size=5, percent=80)
        .where("NOT kept")
        .select(F.col("doc_id").alias("_gone"))
        .distinct()
    )
    return _known(docs).join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix opens them: not at all, once or twice, so that sources meet their targets.

    Documents without words are in no block and go. A null source is a source; rows that share an id, null ones too,
    are each taken as often as the one of them that is taken most; ties in the shuffled order break by id and size.
    """
    taken = (
        mixing.mix_sources(docs).docs.where("copies > 0")
        .groupBy("doc_id")
        .agg(F.max("copies").cast("int").alias("_copies"))
    )
    named = taken.select(F.col("doc_id").alias("_id"), "_copies")
    worded = _known(docs).where(F.col("text").rlike(WORD))
    every = worded.join(named, F.col("doc_id").eqNullSafe(F.col("_id")))
    return _known(every.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token ids of every whole text, and whether they decode to it. A null text has no
    ids; every row is encoded, repeated ones too."""
    codec = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = bpe.encode_documents(_known(docs), codec)
    whole = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip")
    )


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("bpe_encode", encode),
]

#: SQL can express neither the language model nor the signatures; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
