"""The registered queries of the training-data operators: one opN_<name> for each, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, exact, langid, merkle, minhash, mixing, nearest, oracle, sharding, spelling, substring, urls, vectors, warc
from .common import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0-7 by the law ``bytes``."""
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document when repeated runs of 13 words go."""
    return substring.digest(substring.remove_repeats(table(spark, sf_dir, "documents"), 13, texts=False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document, learned from the rows that are not held out."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs, ~langid.held_out()))
    return found.select("doc_id", langid.held_out().alias("held_out"), "language.lang_pred", "language.score")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link counts and components of all vectors at cosine 0.95."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return urls.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document's whole text, and the bytes they decode to."""
    codec = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digest(bpe.encode_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), codec))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents over 4-word shingles at 80 %."""
    return minhash.near_duplicates(
        spread(table(spark, sf_dir, "documents").select("doc_id", "text")), size=4, percent=80
    )


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by the mix of all sources."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).docs.select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document."""
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive, found through the capture index and read back."""
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and folded root of every document under the root of all."""
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth id, out of all."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of all documents."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents")).select(
        "word", "form", "root", "n", "n_near", "form_n"
    )


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_mixing_sources": op8_mixing_sources,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_warc": op10_warc,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_spelling_variants": op13_spelling_variants,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL = {
    "op1_sharding": oracle.SHARDING,
    "op2_substring_dedup": oracle.SUBSTRING,
    "op4_embedding_near_dedup": oracle.VECTORS,
    "op7_minhash_near_dedup": oracle.MINHASH,
    "op8_mixing_sources": oracle.MIXING,
    "op5_url_filters": urls.ORACLE_SQL,
    "op11_merkle_manifest": oracle.MERKLE,
    "op12_nearest_neighbours": oracle.NEAREST,
    "op13_spelling_variants": oracle.SPELLING,
    "op10_warc": """
WITH t AS (SELECT page_id, coalesce(octet_length(encode(html)), 0)::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM t WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM t LEFT JOIN f USING (payload_digest)""",
    "op9_exact_dedup": """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
}
