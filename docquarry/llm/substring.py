"""Operator 2: repeated runs of words, found level by level at doubled lengths."""

from __future__ import annotations

import hashlib
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_groups, pieces, written
from .words import double_keys, keyed_texts, run_keys

WINDOW = np.dtype([("key", "<u8"), ("more", "<u8"), ("doc", "<i8")])
SEVERAL = np.uint64(1)  # lowest bit of a bare key: several texts of the block have it
REQUEST = "bucket int, block int, entries binary"
REPLY = "block int, entries binary"
STATE = "block int, digest binary, region binary"


def half(window: int) -> int:
    """Length of the runs that stand for a window before it is looked up: two that overlap cover it."""
    return (window + 1) // 2


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """For every window the least key among its half-length runs. Equal windows have equal anchors, so a window whose
    anchor is in one document alone cannot repeat, and neighbouring windows mostly share theirs."""
    short = run_keys(words, half(window), 1, row=0)
    n = words.shape[1] - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = short[:n].copy()
    for i in range(1, window - half(window) + 1):
        np.minimum(out, short[i : i + n], out=out)
    return out & ~SEVERAL


def _packed(fixed: dict, name: str, groups: np.ndarray, entries: np.ndarray) -> pa.Table:
    """A row for each run of equal ``groups``, with its entries as bytes."""
    names, starts = np.unique(groups, return_index=True)
    parts = [x.tobytes() for x in np.split(entries, starts[1:])] if len(names) else []
    columns = {
        name: pa.array(names, pa.int32()), **{k: pa.array(np.full(len(names), v), pa.int32()) for k, v in fixed.items()}
    }
    return pa.table({**columns, "entries": pa.array(parts, pa.binary())})


def _by_bucket(block: int, key: np.ndarray, entries: np.ndarray, buckets: int) -> pa.Table:
    bucket = ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return _packed({"block": block}, "bucket", bucket[order], entries[order])


def _unpacked(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    """(entries, block of each) of a bucket."""
    parts = [np.frombuffer(x, kind) for x in table["entries"].to_pylist()]
    return np.concatenate(parts), np.repeat(table["block"].to_numpy(), [len(p) for p in parts]).astype(np.int64)


def ask_keys(block: int, found: list[np.ndarray], buckets: int) -> pa.Table:
    """The keys of a block's texts (distinct ones for each text), each once, packed by bucket."""
    keys = np.sort(np.concatenate([np.empty(0, np.uint64), *found]))
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
    several = np.diff(np.r_[np.flatnonzero(first), len(keys)]) > 1
    keys = keys[first] | several.astype(np.uint64)
    return _by_bucket(block, keys, keys, buckets)


def repeated_keys(requests: DataFrame) -> DataFrame:
    """(block, entries): the keys that at least two texts have, to each block that has them."""

    def run(table: pa.Table) -> pa.Table:
        keys, block = _unpacked(table, np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, block = keys[order], block[order]
        bare = keys & ~SEVERAL
        starts = np.flatnonzero(np.r_[True, bare[1:] != bare[:-1]])
        n = np.diff(np.r_[starts, len(keys)])
        keep = np.repeat((n > 1) | (np.bitwise_or.reduceat(keys, starts) & SEVERAL > 0), n)
        bare, block = bare[keep], block[keep]
        order = np.argsort(block, kind="stable")
        return _packed({}, "block", block[order], bare[order])

    return requests.groupBy("bucket").applyInArrow(run, REPLY)


def known_keys(parts: list[bytes]) -> np.ndarray:
    return np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in parts)]))


def is_known(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(known) or not len(keys):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _sorted(entries: np.ndarray) -> np.ndarray:
    return entries[np.lexsort([entries["doc"], entries["more"], entries["key"]])]


def _same(entries: np.ndarray) -> np.ndarray:
    """Whether each entry but the first has the key of the one before."""
    return (entries["key"][1:] == entries["key"][:-1]) & (entries["more"][1:] == entries["more"][:-1])


def ask_windows(block: int, found: list[tuple[np.ndarray, int]], buckets: int) -> pa.Table:
    """The block's smallest and largest document for each window (two rows of keys, document), packed by bucket."""
    entries = np.empty(sum(keys.shape[1] for keys, _ in found), WINDOW)
    at = 0
    for keys, doc in found:
        part = entries[at : at + keys.shape[1]]
        part["key"], part["more"], part["doc"] = keys[0], keys[1], doc
        at += keys.shape[1]
    entries = _sorted(entries)
    if len(entries):
        new = np.flatnonzero(~_same(entries)) + 1
        first, last = np.r_[0, new], np.r_[new, len(entries)] - 1
        entries = entries[np.r_[first, last[entries["doc"][first] != entries["doc"][last]]]]
    return _by_bucket(block, entries["key"], entries, buckets)


def repeated_windows(requests: DataFrame) -> DataFrame:
    """(block, entries): for every window of at least two documents its smallest document, to each block that has it."""

    def run(table: pa.Table) -> pa.Table:
        entries, block = _unpacked(table, WINDOW)
        order = np.lexsort([entries["more"], entries["key"]])
        entries, block = entries[order], block[order]
        starts = np.flatnonzero(np.r_[True, ~_same(entries)])
        low, high = (f.reduceat(entries["doc"], starts) for f in (np.minimum, np.maximum))
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(entries)]))
        keep = (low < high)[group]
        pair = np.unique(np.stack([block[keep], group[keep]]), axis=1)
        reply = entries[starts][pair[1]]
        reply["doc"] = low[pair[1]]
        return _packed({}, "block", pair[0], reply)

    return requests.groupBy("bucket").applyInArrow(run, REPLY)


def look_up(replies: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is among the sorted replies, its smallest document, first row of its key) for each window of the words."""
    key = run_keys(words, window, 2, row=0)
    found, first = np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    if not len(replies) or not len(key):
        return found, first, key
    at = np.searchsorted(replies["key"], key)
    left = np.flatnonzero(replies["key"][np.minimum(at, len(replies) - 1)] == key)
    more = run_keys(words, window, 2, row=1) if len(left) else None
    while len(left):  # more than one step only where first rows of unlike windows agree
        hit = replies["more"][at[left]] == more[left]
        found[left[hit]], first[left[hit]] = True, replies["doc"][at[left[hit]]]
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < len(replies)]
        left = left[replies["key"][at[left]] == key[left]]
    return found, first, key


def _side(table: pa.Table) -> tuple[dict, list[bytes]]:
    """(digests of exact copies by id, packed replies) of one block."""
    copies, replies = {}, []
    for what, entries in zip(table["kind"].to_pylist(), table["entries"].to_pylist(), strict=True):
        if what == 0:
            copies.setdefault(int.from_bytes(entries[:8], "big", signed=True), set()).add(entries[8:])
        else:
            replies.append(entries)
    return copies, replies


def known_windows(parts: list[bytes]) -> np.ndarray:
    return _sorted(np.concatenate([np.empty(0, WINDOW), *(np.frombuffer(x, WINDOW) for x in parts)]))


def _md5(raw: bytes) -> bytes:
    return hashlib.md5(raw).digest()


def _texts(left: pa.Table, copies: dict):
    """(id, keys of the words) of a block's documents that have both and are no copies."""
    rows = ((doc, text.encode()) for doc, text in zip(left["id"].to_pylist(), left["text"].to_pylist(), strict=True) if doc is not None and text)
    return keyed_texts((doc, raw) for doc, raw in rows if doc not in copies or _md5(raw) not in copies[doc])


class Repeats:
    """Documents dealt into blocks of about ``per_block``, and the levels over them. Id and text together choose the
    block: different texts of one id, or of null ids, are spread; only rows equal in both stay together.

    A block asks, for every bucket of the key space, which of its keys occur in other documents, and gets back the
    repeated ones with their smallest document. A block holds a key at most twice (its smallest and largest
    document), so a passage of any frequency costs two entries a block and is never gathered by document. Texts
    are shuffled once, by block; the passes over them reuse that exchange. Exact copies of an earlier text are
    found by digest first and take no part in the levels: rows with the id and the digest of a copy, so that other
    texts of a repeated id stay.
    """

    def __init__(self, docs: DataFrame, window: int, per_block: int, id_col: str, text_col: str):
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        least = 3 * docs.sparkSession.sparkContext.defaultParallelism  # small tables: blocks for all cores
        n = docs.count()
        self.window, self.blocks = window, max(pieces(n, per_block), min(least, pieces(n, 64)))
        self.rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(self.blocks)).cast("int"))
        digests = self.rows.where("id IS NOT NULL AND text IS NOT NULL").select(
            "id", "block", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("digest")
        )
        digests, self.digests_at = written(digests, "digests")
        first = digests.groupBy("digest").agg(F.min("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        copies = (
            join_groups(digests, first, "digest", "_n").where("id > _first").select("id", "block", "digest").distinct()
        )
        packed = F.concat(F.unhex(F.lpad(F.hex("id"), 16, "0")), "digest")  # id, big-endian, and digest
        self.copies, self.copies_at = written(
            copies.select("block", F.lit(0).alias("kind"), packed.alias("entries")), "copies"
        )

    def meet(self, replies: DataFrame | None, run, schema: str) -> DataFrame:
        side = self.copies if replies is None else self.copies.union(replies.select("block", F.lit(1), "entries"))
        return self.rows.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(run, schema)

    def windows(self) -> DataFrame:
        """Replies of the first level: all windows that occur in two documents, with the smallest of them. Only windows
        whose anchor repeats are asked for."""
        window, buckets = self.window, self.blocks

        def number(left: pa.Table) -> int:
            return left["block"][0].as_py() if left.num_rows else 0

        def ask_anchors(left: pa.Table, right: pa.Table) -> pa.Table:
            return ask_keys(
                number(left), [np.unique(anchors(words, window)) for _, words in _texts(left, _side(right)[0])], buckets
            )

        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            copies, replies = _side(right)
            known, found = known_keys(replies), []
            for doc, words in _texts(left, copies):
                hit = is_known(known, anchors(words, window))
                if hit.any():
                    found.append((run_keys(words, window, 2)[:, hit], doc))
            return ask_windows(number(left), found, buckets)

        near = repeated_keys(self.meet(None, ask_anchors, REQUEST))
        return repeated_windows(self.meet(near, ask, REQUEST))


def _regions(hit: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of neighbouring places that are hit."""
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def extend(state: DataFrame, length: int, blocks: int) -> DataFrame:
    """The next level: runs of ``2 * length`` words whose two halves both repeat at ``length``, looked up like anchors.
    ``state``: block, digest of the text, and the keys of one region of neighbouring runs that all repeat. Returns the
    regions that repeat at the doubled length. These levels remove nothing, so 64-bit keys do."""

    def doubled(region: bytes) -> np.ndarray:
        return double_keys(np.frombuffer(region, np.uint64), length) & ~SEVERAL

    def ask(table: pa.Table) -> pa.Table:
        texts: dict[bytes, list] = {}
        for digest, region in zip(table["digest"].to_pylist(), table["region"].to_pylist(), strict=True):
            texts.setdefault(digest, []).append(doubled(region))
        return ask_keys(table["block"][0].as_py(), [np.unique(np.concatenate(x)) for x in texts.values()], blocks)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        known, out = known_keys(right["entries"].to_pylist()), []
        for block, digest, region in zip(*(left[c].to_pylist() for c in ("block", "digest", "region")), strict=True):
            keys = doubled(region)
            out += [(block, digest, keys[a:b].tobytes()) for a, b in _regions(is_known(known, keys))]
        columns = zip(*out, strict=True) if out else ([],) * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "digest", "region"), columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)})

    usable = state.where(F.length("region") > 8 * length)
    replies = repeated_keys(usable.groupBy("block").applyInArrow(ask, REQUEST))
    return usable.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(answer, STATE)


def remove_repeats(
    docs: DataFrame,
    window: int = 13,
    per_block: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: bool = True,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, longest_run) for every document; without ``texts`` kept_sha256, the
    digest of the text that is left, in place of kept_text.

    A word is removed when a run of ``window`` words that covers it also starts in a document with a smaller id.
    Words are maximal runs of characters other than space and \\t-\\r, unchanged; windows are judged on the input.

    Level 1 finds the windows that repeat. Level by level, neighbouring runs that repeat at one length alone are
    extended to twice that length, until no candidate survives. Every window of a longer repeated run repeats too, so
    level 1 already holds all words that go; the levels beyond tell how far the repeats reach: ``longest_run`` is the
    length (window, 2 * window, ...) of the last level that a run of the document survived, in texts that are not
    equal; 0 where there is none. Equal texts have equal ``longest_run``.

    Words and windows are compared by keys of 128 bits, so that no window is taken for another. Null and empty texts have no words; a null id neither removes
    nor is removed; rows that repeat an id are judged one by one and never against each other; of equal texts the
    smallest id keeps its words. Whole texts of any length are read; extra columns are ignored; an empty table gives
    no rows.
    """
    levels = Repeats(docs, window, per_block, id_col, text_col)
    last = ("kept_text", pa.string()) if texts else ("kept_sha256", pa.string())
    names = [
        ("block", pa.int32()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        last,
        ("digest", pa.binary()),
        ("regions", pa.list_(pa.binary())),
    ]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        copies, replies = _side(right)
        known, out = known_windows(replies), []
        raws = [(text or "").encode() for text in left["text"].to_pylist()]
        ids, digests = left["id"].to_pylist(), [_md5(raw) for raw in raws]
        copy = [doc is not None and digest in copies.get(doc, ()) for doc, digest in zip(ids, digests, strict=True)]
        spans: dict[int, tuple[list, list]] = {}
        for i, words in keyed_texts((i, raw) for i, raw in enumerate(raws) if ids[i] is not None and not copy[i]):
            hit, first, keys = look_up(known, words, window)
            if hit.any():
                spans[i] = _regions(hit & (first < ids[i])), [keys[a:b].tobytes() for a, b in _regions(hit)]
        for i, raw in enumerate(raws):
            words = raw.split()
            n = len(words)
            later, regions = spans.get(i, ((), []))
            gone = np.full(n, copy[i] and n >= window)
            for a, b in later:
                gone[a : b + window - 1] = True
            kept = b" ".join(compress(words, (~gone).tolist()) if gone.any() else words)
            out.append(
                (
                    left["block"][i].as_py(),
                    ids[i],
                    n,
                    int(gone.sum()),
                    kept.decode() if texts else hashlib.sha256(kept).hexdigest(),
                    digests[i],
                    regions,
                )
            )
        columns = zip(*out, strict=True) if out else ([],) * len(names)
        return pa.table({k: pa.array(list(v), t) for (k, t), v in zip(names, columns, strict=True)})

    schema = f"block int, doc_id long, n_words long, n_removed long, {last[0]} string, digest binary, regions array<binary>"
    judged, _ = written(levels.meet(levels.windows(), run, schema), "judged")
    discard(levels.digests_at)
    discard(levels.copies_at)
    return _with_longest(judged, window, levels.blocks)


def _with_longest(judged: DataFrame, window: int, blocks: int) -> DataFrame:
    """Run the levels beyond the first to their end and add ``longest_run``."""
    hits = judged.where("size(regions) > 0").select("block", "digest", F.explode("regions").alias("region"))
    reached = hits.select("digest").distinct().select("digest", F.lit(window).alias("longest"))
    state, old, found = hits, None, [reached]
    for level in count():
        length = window << level
        state, path = written(extend(state, length, blocks), "level")
        if old:
            discard(old)
        old = path
        if state.isEmpty():
            discard(old)
            break
        found.append(
            written(state.select("digest").distinct().select("digest", F.lit(2 * length).alias("longest")), "reached")[
                0
            ]
        )
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    most = every.groupBy("digest").agg(F.max("longest").alias("longest_run"))
    rows = judged.drop("block", "regions")
    texts = (
        rows.groupBy("digest")
        .agg(F.count("*").alias("_n"))
        .join(most, "digest", "left")
        .withColumn("longest_run", F.coalesce("longest_run", F.lit(0)))
    )
    return join_groups(rows, texts, "digest", "_n").drop("digest")


def digest(removed: DataFrame) -> DataFrame:
    """The words that are left as a digest."""
    kept = F.col("kept_sha256") if "kept_sha256" in removed.columns else F.sha2(F.encode("kept_text", "UTF-8"), 256)
    return removed.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"), "longest_run")
