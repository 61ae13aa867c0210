"""Operator 7: near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, mix64, small_batches, tidy
from .components import connected_components, forest
from .words import keyed_texts, run_keys, word_keys

BATCH = 1 << 14  # shingles whose permutations are held at a time


def lower_words(text) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    return run_keys(words, min(size, words.shape[1]), size) if words.size else words


def shingle_keys(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct 128-bit keys, sorted, of the ``size``-word shingles; of the whole sequence if it is shorter; none without
    words. ``words``: keys of the words, A-Z lower-cased."""
    keys = _runs(words, size)
    keys = keys[:, np.lexsort((keys[1], keys[0]))]
    return keys[:, np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]] if keys.size else keys


def shingle_set(text, size: int) -> np.ndarray:
    """Sorted distinct first rows of the shingle keys: enough to propose pairs, which the words then confirm."""
    return np.unique(_runs(word_keys((text or "").encode().lower()), size)[0])


def _names(words: np.ndarray, size: int) -> np.ndarray:
    """Equal numbers for equal shingles of word numbers, and for no others: numbers of runs are made of the numbers of
    two shorter runs that cover them."""
    length, out = 1, words
    while length < size:
        step = min(length, size - length)
        pairs = out[: len(out) - step] * (out.max() + 1) + out[step:]
        out = np.unique(pairs, return_inverse=True)[1]
        length += step
    return out


def similar_texts(a: list[bytes], b: list[bytes], size: int, percent: int) -> bool:
    """100 * intersection >= percent * union of the two shingle sets, decided on the words themselves."""
    if not a or not b:
        return False
    if min(len(a), len(b)) < size:
        return a == b if len(a) == len(b) else False
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for words in (a, b) for w in words], np.int64)
    n, m = len(a) - size + 1, len(b) - size + 1
    names = _names(flat, size)  # the runs that span both texts are left out
    x, y = np.unique(names[:n]), np.unique(names[len(a) : len(a) + m])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (float32, one row a set; all inf for an empty set).

    Every element draws, step by step, a fresh random number in [j, j + 1) and the next entry of a random
    permutation of the m slots, and lowers that slot. All elements take step j together. A set is done as soon as
    all its slots are below j + 1: later draws are larger.
    """
    out = np.full((len(sets), m), np.inf)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= BATCH):
            total, end = total + len(sets[end]), end + 1
        if total > BATCH:  # one very long set: the minimum of the signatures of its parts is its signature
            for part in range(0, total, BATCH):
                out[at] = np.minimum(out[at], _draw([sets[at][part : part + BATCH]], m)[0])
        elif total:
            out[at:end] = _draw(sets[at:end], m)
        at = end
    return out.astype(np.float32)


def _draw(sets: list[np.ndarray], m: int) -> np.ndarray:
    n = len(sets)
    owner, key = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    values = np.full(n * m, np.inf)
    order = np.broadcast_to(np.arange(m, dtype=np.int16), (len(key), m)).copy()
    line = np.arange(len(key))  # the elements still drawing
    for j in range(m):
        with np.errstate(over="ignore"):
            draw = mix64(key + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))
        k = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        slot = order[line, k]
        order[line, k] = order[line, j]
        np.minimum.at(values, owner * m + slot, j + (draw >> np.uint64(32)).astype(np.float64) / 2**32)
        full = values.reshape(n, m).max(axis=1) < j + 1
        stay = ~full[owner]
        if not stay.all():
            owner, key, line = owner[stay], key[stay], line[stay]
            if not len(key):
                break
    return values.reshape(n, m)


def sketch(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """id, text_hash, n_shingles, set_hash (128-bit digest of the whole set; null for an empty one) and one key a band.
    ``docs``: id, text, text_hash."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = [shingle_keys(words, size) for _, words in keyed_texts((None, (t or "").encode().lower()) for t in part.column(1).to_pylist())]
                signature = (
                    superminhash([k[0] for k in keys], bands * rows)
                    .view(np.uint32)
                    .astype(np.uint64)
                    .reshape(len(keys), bands, rows)
                )
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(keys), bands)).copy()
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, :, r] + np.uint64(1))
                whole = [hashlib.blake2b(k.tobytes(), digest_size=16).digest() if k.size else None for k in keys]
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(keys) * bands + 1, bands, dtype=np.int32)),
                    pa.array(key.ravel().view(np.int64)),
                )
                columns = [
                    part.column(0),
                    part.column(2),
                    pa.array([k.shape[1] for k in keys], pa.int64()),
                    pa.array(whole, pa.binary()),
                    flat,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "n_shingles", "set_hash", "bands"])
                del part, keys, whole, flat, columns, key, signature
                tidy(every=0.5)
        tidy()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "id long, text_hash long, n_shingles long, set_hash binary, bands array<long>")


def verify_pairs(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar, compared word by word. ``texts``: id, text. Rows come
    sorted by ``b``, so the words of a centre that many rows share are taken once in a run."""

    def run(batches):
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                if last != b[i]:
                    last, held = b[i], lower_words(batch.column(3)[i].as_py())
                keep[i] = similar_texts(lower_words(batch.column(2)[i].as_py()), held, size, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])
            tidy(every=0.5)
        tidy()

    left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", "text_a", "text_b")
        .sortWithinPartitions("b")
        .mapInArrow(run, "a long, b long")
    )


def links_in_group(ids: np.ndarray, side: np.ndarray, parts: np.ndarray, texts: list, size: int, percent: int) -> tuple[
    np.ndarray, np.ndarray
]:
    """A forest of the similar pairs in a block of bucket members that are not yet in one component.

    Intersections are counted through an inverted list of the block's shingle keys, and the pairs that join two
    components are confirmed on their words. Side 0 holds rows and side 1 columns of a block pair; all on side 2 for a
    block with itself.
    """
    sets = [shingle_set(t, size) for t in texts]
    sizes = np.array([len(s) for s in sets])
    owner, key = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    found_a, found_b, joined = [], [], {}

    def root(x):
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    for i in range(len(sets)):
        if side[i] == 1:
            continue
        lo, hi = np.searchsorted(key, sets[i], "left"), np.searchsorted(key, sets[i], "right")
        n = hi - lo
        ends = np.cumsum(n)
        hits = owner[np.repeat(lo - (ends - n), n) + np.arange(ends[-1])]
        both = np.bincount(hits, minlength=len(sets))
        good = 100 * both >= percent * (sizes[i] + sizes - both)
        good &= (side == 1) if side[i] == 0 else (np.arange(len(sets)) > i)
        for k in np.flatnonzero(good & (parts != parts[i])):
            x, y = root(int(parts[i])), root(int(parts[k]))
            if x != y and similar_texts(lower_words(texts[i]), lower_words(texts[k]), size, percent):
                joined[max(x, y)] = min(x, y)
                found_a.append(ids[i])
                found_b.append(ids[k])
    return np.array(found_a, np.int64), np.array(found_b, np.int64)


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    block: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Sets of distinct ``size``-word shingles (A-Z lower-cased; a shorter text is one shingle) are linked when
    100 * intersection >= ``percent`` * union. Signatures of bands * rows SuperMinHash values propose candidates
    (at 80 % similarity 32 bands of 5 miss 3 in a million); every link is confirmed on the words of both full sets.

    1. Documents of equal sets (128-bit digests of sets of 128-bit keys) become one representative before anything is
       paired.
    2. Every representative is compared with the smallest member of its buckets, one centre each, and the links
       are grouped by union-find; this settles nearly all buckets.
    3. A bucket that still holds several components is compared in full, between components alone, in blocks of
       about ``block`` members, whose intersections are counted through an inverted list; tasks return forests.
       Buckets of the same members are taken once. No pair list of a bucket is ever made, and a bucket of any size
       is spread over many tasks.

    Null ids are left out of groups (component null, kept). Rows of one id are one document: it is linked by each of
    its texts, and all its rows are in one component. Texts that are null or without words have an empty set, link
    with nothing and stay. Extra columns are ignored; an empty table gives no rows. Reruns agree.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )
    sketched = materialize(sketch(source, size, bands, rows), "sketch")
    whole = sketched.where("id IS NOT NULL AND set_hash IS NOT NULL")
    classes = materialize(
        whole.groupBy("set_hash")
        .agg(F.min(F.struct("id", "text_hash")).alias("r"), F.count("*").alias("_n"))
        .select("set_hash", F.col("r.id").alias("rep"), "r.text_hash", "_n"),
        "classes",
    )
    chosen = classes.select(F.col("rep").alias("id"), "text_hash")  # one row of each class
    reps = (
        whole.join(chosen, ["id", "text_hash"])
        .groupBy("id", "text_hash", "n_shingles")
        .agg(F.first("bands").alias("bands"))
    )
    keys = materialize(reps.select("id", "text_hash", "n_shingles", F.explode("bands").alias("key")), "bands")
    buckets = keys.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("members")).where("members > 1")
    members = materialize(join_groups(keys, buckets.withColumn("_n", F.col("members")), "key", "_n"), "members")
    texts = (
        source.where("id IS NOT NULL")
        .join(members.select("id", "text_hash").distinct(), ["id", "text_hash"], "left_semi")
        .groupBy("id", "text_hash")
        .agg(F.min("text").alias("text"))
    )
    texts = materialize(texts, "candidates")

    first = (
        members.where("id > centre").groupBy("id").agg(F.min("centre").alias("b")).select(F.col("id").alias("a"), "b")
    )
    star = verify_pairs(first, texts, size, percent)
    named = join_groups(
        whole.select("id", "set_hash"), classes.select("set_hash", "rep", "_n"), "set_hash", "_n", stored=True
    )
    several = named.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    same_id = (
        named.join(several.select("id"), "id", "left_semi")
        .where("id <> rep")
        .select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    star = materialize(star.union(same_id).distinct(), "star")
    grouped = connected_components(star)
    placed = members.join(grouped, "id", "left").select(
        "key", "id", "text_hash", "members", F.coalesce("component", "id").alias("component")
    )
    placed = materialize(placed, "placed")
    mark = F.xxhash64("id", "text_hash")
    mixed = (
        placed.groupBy("key")
        .agg(
            F.min("component").alias("lo"),
            F.max("component").alias("hi"),
            F.bit_xor(mark).alias("m1"),
            F.bit_xor(F.xxhash64(mark)).alias("m2"),
            F.count("*").alias("n"),
        )
        .where("lo < hi")
    )
    mixed = mixed.groupBy("m1", "m2", "n").agg(F.min("key").alias("key")).select("key", F.col("n").alias("_n"))
    late = materialize(block_links(join_groups(placed, mixed, "key", "_n"), texts, size, percent, block), "late")
    final = connected_components(star.union(late))
    of_class = classes.join(final, F.col("rep") == F.col("id"), "left").select(
        "set_hash", "_n", F.coalesce("component", "rep").alias("component")
    )
    linked = join_groups(whole.select("id", "n_shingles", "set_hash"), of_class, "set_hash", "_n").select(
        "id", "n_shingles", "component"
    )
    # null for a null id
    alone = sketched.where("id IS NULL OR set_hash IS NULL").select("id", "n_shingles", F.col("id").alias("component"))
    out = linked.unionByName(alone)
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("component").eqNullSafe(F.col("id")).alias("kept"),
    )


def block_links(members: DataFrame, texts: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) between the components of each bucket. ``members``: key, id, text_hash, members, component."""
    blocks = F.ceil(F.col("members") / block).cast("int")
    placed = members.withColumn("_blocks", blocks).withColumn(
        "_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    )
    own = ("key", "id", "text_hash", "component")
    spread = placed.select(*own, "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")).select(
        *own, F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("k"),
        F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1).alias("side"),
    )

    def run(table: pa.Table) -> pa.Table:
        parts = table["component"].to_numpy()
        a = b = np.empty(0, np.int64)
        if (parts != parts[0]).any():
            a, b = links_in_group(
                table["id"].to_numpy(), table["side"].to_numpy(), parts, table["text"].to_pylist(), size, percent
            )
        tidy(every=0.5)
        return pa.table({"a": a, "b": b})

    joined = spread.join(texts, ["id", "text_hash"]).select("key", "i", "k", "id", "component", "side", "text")
    found = joined.groupBy("key", "i", "k").applyInArrow(run, "a long, b long")

    def shrink(batches):
        for batch in batches:
            a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return found.mapInArrow(shrink, "a long, b long")
