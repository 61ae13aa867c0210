"""Operator 6: byte-level BPE in numpy - length-bucketed padded matrices, one merge per row and round."""

from __future__ import annotations

import base64
import functools
import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import mix64, small_batches, tidy

NONE = np.int32(2**31 - 1)
LONG = 4096  # bytes from which a piece is merged with a heap instead of a matrix row
SLICE = 1 << 21  # bytes of text whose pieces are held at a time
CACHE = 200_000  # pieces remembered by a worker
ROWS = 256  # rows of a batch that are encoded and given back at a time
EACH = 1 << 20  # characters beyond which a text is split match by match


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


class Codec:
    """Encoder and decoder for one vocabulary; ids are ranks. Built once in every Python worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.split = tokens, regex.compile(pattern)
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ids[t[:i]], self.ids[t[i:]], n) for n, t in enumerate(tokens) for i in range(1, len(t)) if t[:i] in self.ids and t[i:] in self.ids]
        left, right, merged = (np.array(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 3
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(2.5 * len(keys)).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys, self.merged = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, NONE, np.int32)
        at, todo, self.probes = mix64(keys) & self.mask, np.arange(len(keys)), 0
        while len(todo):  # linear probing, all keys a step at a time
            self.probes += 1
            free = self.merged[at[todo]] == NONE
            _, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[at[put]], self.merged[at[put]] = keys[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.size, self.flat, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(
            0, np.int32
        ), 0

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged token of each pair; NONE where the pair does not merge or a side is padding (-1)."""
        key = (
            (left.astype(np.int64).astype(np.uint64) << np.uint64(32))
            | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        )
        at = mix64(key) & self.mask
        out = np.where(self.keys[at] == key, self.merged[at], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.merged[at] != NONE))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
            hit = self.keys[at[open_]] == key[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (self.merged[at[open_]] != NONE)]
        return out

    def merge_rows(self, rows: np.ndarray) -> list[np.ndarray]:
        """Merge every row (ids, padded with -1) until none of its pairs has a rank. A round merges one pair of
        each row still open - the leftmost of least rank - so all open rows get shorter together, and rows
        without a pair are taken out."""
        done: list[np.ndarray] = [rows[:0]] * len(rows)
        where, width = np.arange(len(rows)), rows.shape[1]
        ranks = (
            self.rank(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), width - 1)
            if width > 1
            else np.full((len(rows), 0), NONE)
        )
        while len(where):
            if ranks.shape[1]:
                j = ranks.argmin(axis=1)
                best = ranks[np.arange(len(where)), j]
            else:
                j, best = np.zeros(len(where), np.int64), np.full(len(where), NONE)
            shut = best == NONE
            for i in np.flatnonzero(shut):
                done[where[i]] = rows[i][rows[i] >= 0]
            if shut.any():
                keep = ~shut
                where, rows, ranks, j, best = where[keep], rows[keep], ranks[keep], j[keep], best[keep]
                if not len(where):
                    break
            n, width = rows.shape
            line = np.arange(n)
            rows[line, j] = best
            gone = np.ones((n, width), bool)
            gone[line, j + 1] = False
            rows = rows[gone].reshape(n, width - 1)
            stay = np.ones((n, width - 1), bool)
            stay[line, j] = False
            ranks = ranks[stay].reshape(n, width - 2)
            before, after = j > 0, j < width - 2
            a, b = line[before], line[after]
            new = self.rank(
                np.concatenate([rows[a, j[a] - 1], rows[b, j[b]]]), np.concatenate([rows[a, j[a]], rows[b, j[b] + 1]])
            )
            ranks[a, j[a] - 1], ranks[b, j[b]] = new[: len(a)], new[len(a) :]
        return done

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for a long piece, in order of (rank, place) from a heap."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = {}

        def rank(i, k):
            pair = (ids[i], ids[k])
            if pair not in table:
                table[pair] = self.ids.get(self.tokens[pair[0]] + self.tokens[pair[1]], -1)
            return table[pair]

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            k = after[i]
            if ids[i] != left or k >= n or ids[k] != right:
                continue
            ids[i], ids[k], after[i] = r, -1, after[k]
            if after[k] < n:
                before[after[k]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := rank(x, y)) >= 0:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces not yet known, in buckets of like length."""
        raw = [p.encode() for p in pieces]
        found: list = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(raw):
            whole = self.ids.get(piece)
            if whole is not None:
                found[i] = np.array([whole], np.int32)
            elif len(piece) > LONG:
                found[i] = self.merge_long(piece)
            else:
                buckets.setdefault(len(piece) if len(piece) <= 16 else 1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, (1 << 20) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                rows = np.full((len(part), width), -1, np.int32)
                lens = np.array([len(raw[i]) for i in part])
                rows[np.arange(width) < lens[:, None]] = self.byte[
                    np.frombuffer(b"".join(raw[i] for i in part), np.uint8)
                ]
                for i, ids in zip(part, self.merge_rows(rows), strict=True):
                    found[i] = ids
        size = np.array([len(x) for x in found], np.int64)
        base = len(self.size)
        self.known.update(zip(pieces, range(base, base + len(pieces)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *found])

    def gather(self, pieces: list[str]) -> np.ndarray:
        """Ids of pieces in a row."""
        if len(self.known) > CACHE:
            self.forget()
        new = list(dict.fromkeys(p for p in pieces if p not in self.known)) if pieces else []
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[
            np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        ], size

    def encode_all(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of many texts; None counts as empty."""
        counts, out, pending, bounds, held = [], [], [], [], 0

        def flush():
            nonlocal pending, bounds, held
            if bounds:
                ids, size = self.gather(pending)
                ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *bounds])]
                counts.extend(np.diff(ends).tolist())
                out.append(ids)
            pending, bounds, held = [], [], 0

        for text in texts:
            text = text or ""
            if len(text) > EACH:
                flush()
                matches, n = (m.group() for m in self.split.finditer(text)), 0
                while part := list(islice(matches, 200_000)):
                    ids, _ = self.gather(part)
                    out.append(ids)
                    n += len(ids)
                counts.append(n)
                continue
            pieces = self.split.findall(text)
            pending += pieces
            bounds.append(len(pieces))
            held += len(text)
            if held > SLICE:
                flush()
        flush()
        return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), np.concatenate([np.empty(0, np.int32), *out])

    def decode(self, ids: list) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def _codec(key: str, pattern: str) -> Codec:
    return Codec(_codec.tokens[key], pattern)


_codec.tokens = {}


def codec(shared, pattern: str) -> Codec:
    """The worker's codec for a broadcast (key, tokens)."""
    key, tokens = shared.value
    _codec.tokens[key] = tokens
    return _codec(key, pattern)


class Tokenizer:
    """Column functions ``encode`` and ``decode`` for the vocabulary in a rank file (its size, some 50,000 tokens,
    is fixed and is broadcast once). Extra columns stay as they are; null texts encode to no ids; whole texts of
    any length are encoded."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.shared = spark.sparkContext.broadcast((path, read_ranks(path)))
        self.pattern = pattern

    def encode(self, text: Column) -> Column:
        shared, pattern = self.shared, self.pattern

        @arrow_udf("array<int>")
        def encoded(texts: pa.Array) -> pa.Array:
            offsets, ids = codec(shared, pattern).encode_all(texts.to_pylist())
            return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

        return encoded(text)

    def decode(self, ids: Column) -> Column:
        shared, pattern = self.shared, self.pattern

        @arrow_udf("binary")
        def decoded(lists: pa.Array) -> pa.Array:
            tokens = codec(shared, pattern)
            flat, ends = lists.flatten().to_numpy(), np.cumsum(
                [0, *(n or 0 for n in lists.value_lengths().to_pylist())]
            )
            return pa.array(
                [tokens.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()
            )

        return decoded(ids)


def encode_documents(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (of the whole text) and ``decoded`` (their bytes); columns of these names are replaced.
    Batches are worked on in slices of ``ROWS`` rows, so that a worker holds the ids of one slice only. Null texts have no
    ids and decode to no bytes; repeated rows are encoded each; an empty table gives no rows; other columns stay."""
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "decoded")))
    names, shared, pattern = kept.columns, tokenizer.shared, tokenizer.pattern
    at = names.index(text_col)
    schema = T.StructType(
        [
            *kept.schema.fields,
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.BinaryType()),
        ]
    )

    def run(batches):
        tokens = codec(shared, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                offsets, ids = tokens.encode_all(part.column(at).to_pylist())
                decoded = [tokens.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                        pa.array(decoded, pa.binary()),
                    ],
                    names=[*names, "ids", "decoded"],
                )
                del part, offsets, ids, decoded
                tidy(every=0.5)
        tidy()

    small_batches(docs.sparkSession)
    return kept.mapInArrow(run, schema)


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
