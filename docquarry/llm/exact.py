"""Operator 9: exact dedup through a minimal perfect hash over the digests already seen."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, lower_ascii, materialize, mix64, pieces

GAMMA = 2
INDEX = "shard int, n long, levels binary, digests binary, winners binary, counts binary"


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digests.view("<u8").reshape(len(digests), 4)
    return words[:, 1], words[:, 2] | np.uint64(1)  # word 0 chose the shard


def build_mph(digests: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Levels of bit arrays (uint32 count, then for each level uint32 bits and packed bits) and each key's slot.
    A key's bit is set in the first level where no other key hits it; the slot is the number of set bits before.
    The digests are distinct; each level places more than half of the rest."""
    a, b = _halves(digests)
    left, out, slot, base = np.arange(len(digests)), [], np.empty(len(digests), np.int64), 0
    for level in count():
        if not len(left):
            break
        bits = max(8, GAMMA * len(left))
        pos = (mix64(a[left] + np.uint64(level) * b[left]) % np.uint64(bits)).astype(np.int64)
        alone = np.bincount(pos, minlength=bits) == 1
        hit = alone[pos]
        slot[left[hit]] = base + (np.cumsum(alone) - 1)[pos[hit]]
        base += int(hit.sum())
        out.append(np.uint32(bits).tobytes() + np.packbits(alone).tobytes())
        left = left[~hit]
    return np.uint32(len(out)).tobytes() + b"".join(out), slot


def find_slots(levels: bytes, digests: np.ndarray) -> np.ndarray:
    """Each digest's slot; -1 where no level has its bit. A digest never seen may get any slot: compare bytes."""
    a, b = _halves(digests)
    left, slot, base, at = np.arange(len(digests)), np.full(len(digests), -1, np.int64), 0, 4
    for level in range(int(np.frombuffer(levels, np.uint32, 1)[0])):
        bits = int(np.frombuffer(levels, np.uint32, 1, at)[0])
        alone = np.unpackbits(np.frombuffer(levels, np.uint8, -(-bits // 8), at + 4))[:bits]
        pos = (mix64(a[left] + np.uint64(level) * b[left]) % np.uint64(bits)).astype(np.int64)
        hit = alone[pos] == 1
        slot[left[hit]] = base + (np.cumsum(alone, dtype=np.int64) - 1)[pos[hit]]
        base, at, left = base + int(alone.sum()), at + 4 + -(-bits // 8), left[~hit]
    return slot


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32).copy()


def _ids(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def text_sha256(text: Column) -> Column:
    """SHA-256 in hex of the text, A-Z lower-cased (null counts as empty)."""
    return F.sha2(F.encode(lower_ascii(F.coalesce(text, F.lit(""))), "UTF-8"), 256)


def digest_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the 32 bytes of SHA-256 of the text, A-Z lower-cased (null counts as empty)."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.unhex(text_sha256(F.col(text_col))).alias("digest")
    )


def _groups(rows: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long"), F.lit(shards)).cast("int")
    return (
        rows.groupBy("digest")
        .agg(F.coalesce(F.max("doc_id"), F.lit(-(2**63))).alias("winner"), F.count("*").alias("n"))
        .withColumn("shard", shard)
    )


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """A row for each shard of the digest space: minimal perfect hash, and per slot the full digest, the winning
    doc_id and the number of rows. ``rows``: doc_id, digest; copies are pre-aggregated before any shuffle."""

    def build(table: pa.Table) -> pa.Table:
        digests = _matrix(table["digest"])
        levels, slot = build_mph(digests)
        order = np.argsort(slot)
        cells = [
            [int(table["shard"][0].as_py())],
            [len(digests)],
            [levels],
            [digests[order].tobytes()],
            [_ids(table["winner"])[order].tobytes()],
            [_ids(table["n"])[order].tobytes()],
        ]
        return pa.table(
            dict(
                zip(
                    ["shard", "n", "levels", "digests", "winners", "counts"],
                    [
                        pa.array(cells[0], pa.int32()),
                        pa.array(cells[1], pa.int64()),
                        *(pa.array(x, pa.binary()) for x in cells[2:]),
                    ],
                    strict=True,
                )
            )
        )

    return materialize(_groups(rows, shards).groupBy("shard").applyInArrow(build, INDEX), "mph")


def resolve(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """(digest, winner, n) over history and ``rows`` together. Distinct new digests meet their shard's hash: a slot
    whose 32 bytes agree makes them members, which raise the slot's winner and count; all others are groups of
    their own."""

    def look_up(have: pa.Table, new: pa.Table) -> pa.Table:
        digests, winners, counts = _matrix(new["digest"]), _ids(new["winner"]), _ids(new["n"])
        if have.num_rows:
            row = {k: have[k][0].as_py() for k in have.column_names}
            known = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
            old, seen = np.frombuffer(row["winners"], np.int64).copy(), np.frombuffer(row["counts"], np.int64).copy()
            slot = find_slots(row["levels"], digests)
            member = slot >= 0
            member[member] = (known[slot[member]] == digests[member]).all(axis=1)
            np.maximum.at(old, slot[member], winners[member])
            np.add.at(seen, slot[member], counts[member])
            digests, winners, counts = (
                np.concatenate([x, y[~member]]) for x, y in ((known, digests), (old, winners), (seen, counts))
            )
        return pa.table(
            {
                "digest": pa.array([x.tobytes() for x in digests], pa.binary()),
                "winner": pa.array(winners),
                "n": pa.array(counts),
            }
        )

    return (
        index.groupBy("shard")
        .cogroup(_groups(rows, shards).groupBy("shard"))
        .applyInArrow(look_up, "digest binary, winner long, n long")
    )


def exact_dedup(
    docs: DataFrame, history=None, per_shard: int = 50_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty; of equal texts the largest doc_id
    stays. ``history`` is a condition on ``doc_id`` that marks the rows already indexed (by default the lower half
    of the id range): their distinct digests build the hash, all other rows are looked up in it. The split changes
    the work, never the result. Groups of any size are pre-aggregated, so a shard's size depends on distinct
    digests alone; the join that returns decisions to rows carries 40 bytes a row and splits no large group unevenly.
    A null doc_id loses to any other; rows repeated with the winning id are all kept; where all ids of a group are
    null its rows are all kept (keep_id null). An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(digest_texts(docs, id_col, text_col), "digests")
    lo, hi, n_rows = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if history is None:
        history = F.col("doc_id") < F.lit(((lo or 0) + (hi or 0)) // 2)
    history = F.coalesce(history, F.lit(False))
    shards = pieces(n_rows, per_shard)
    index = build_index(rows.where(history), shards)
    decided = materialize(resolve(index, rows.where(~history), shards), "decided")
    keep = F.when(F.col("winner") > -(2**63), F.col("winner"))
    return join_groups(rows, decided.withColumn("_n", F.col("n")), "digest", "_n", stored=True).select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
