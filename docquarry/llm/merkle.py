"""Operator 11: a Merkle manifest of a dataset, and a proof for every row by fractal traversal of aligned blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_groups, lower_ascii, materialize
from .prefix import prefix_sums

FAN = 8
#: Levels of a block, and levels of each of the subtrees stacked in it.
HEIGHT, STEP = 4, 2
BLOCK = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("lefts", T.ArrayType(T.StringType())),
        T.StructField("rights", T.ArrayType(T.StringType())),
        T.StructField("subroot", T.StringType()),
        T.StructField("root", T.StringType()),
    ]
)


def leaf_digest(*values: Column) -> Column:
    """H of the values, each ``-`` if null, else UTF-8 byte count, ``:``, value."""
    parts = [v.cast("string") for v in values]
    told = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*told), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes: every FAN of them become one until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Subtree:
    """Nodes of the levels ``base`` to ``base + levels - 1`` under one node, grown leaf by leaf: a run of FAN nodes becomes its
    digest at once, so below ``base`` only unfinished runs are held."""

    def __init__(self, base: int, levels: int):
        self.base, self.root = base, ""
        self.runs: list[list[str]] = [[] for _ in range(base + levels)]
        self.nodes: list[list[str]] = [[] for _ in range(levels)]

    def _put(self, level: int, node: str) -> None:
        if level == len(self.runs):
            self.root = node
            return
        if level >= self.base:
            self.nodes[level - self.base].append(node)
        self.runs[level].append(node)

    def add(self, leaf: str) -> None:
        level, node = 0, leaf
        self._put(0, leaf)
        while level < len(self.runs) and len(self.runs[level]) == FAN:
            node = digest("".join(self.runs[level]))
            self.runs[level].clear()
            level += 1
            self._put(level, node)

    def close(self) -> Subtree:
        """Finish the runs that the last leaf leaves short."""
        for level, run in enumerate(self.runs):
            if run:
                node = digest("".join(run))
                run.clear()
                self._put(level + 1, node)
        return self

    def siblings(self, leaf: int) -> Iterator[tuple[str, str]]:
        """Siblings left and right of the path of ``leaf``, counted from the subtree's first, at each of its levels."""
        for i, nodes in enumerate(self.nodes):
            at = leaf // FAN ** (self.base + i)
            first = at - at % FAN
            yield "".join(nodes[first:at]), "".join(nodes[at + 1 : first + FAN])


def block_root(leaves: Sequence[str], height: int) -> str:
    tree = Subtree(height, 0)
    for leaf in leaves:
        tree.add(leaf)
    return tree.close().root


def successive_paths(leaves: Sequence[str], height: int, step: int = STEP) -> Iterator[list[tuple[str, str]]]:
    """The authentication path of each leaf of a block in turn: (left, right) siblings for each of ``height`` levels.

    Fractal traversal: subtrees of ``step`` levels are stacked from the leaves to the block's root. Of each place in
    the stack the existing subtree, which the current path crosses, is held, and a desired one, the next at that
    place, which reads one leaf for each path put out and so is whole when the path enters it. Beside the leaves some
    2 * FAN ** step digests a place in the stack are held, whatever the size of the block.
    """
    shape = [(base, min(step, height - base)) for base in range(0, height, step)]
    spans = [FAN ** (base + levels) for base, levels in shape]

    def first(i: int) -> Subtree:
        tree = Subtree(*shape[i])
        for leaf in leaves[: spans[i]]:
            tree.add(leaf)
        return tree.close()

    existing = [first(i) for i in range(len(shape))]
    desired = [Subtree(*s) for s in shape]
    for j in range(len(leaves)):
        yield [pair for tree, span in zip(existing, spans, strict=True) for pair in tree.siblings(j % span)]
        for i, span in enumerate(spans[:-1]):  # the subtree at the top has no successor
            if j + span < len(leaves):
                desired[i].add(leaves[j + span])
            if (j + 1) % span == 0:
                existing[i], desired[i] = desired[i].close(), Subtree(*shape[i])


def _block_roots(table: pa.Table) -> pa.Table:
    rows = table.sort_by("pos")
    n = rows["n"][0].as_py()
    return pa.table(
        {
            "key": pa.array([rows["key"][0].as_py()]),
            "pos": pa.array([rows["pos"][0].as_py() // BLOCK], pa.int64()),
            "n": pa.array([-(-n // BLOCK)], pa.int64()),
            "node": pa.array([block_root(rows["node"].to_pylist(), min(HEIGHT, levels_of(n)))]),
        }
    )


def climb(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (key, pos, n, node; pos from 0 to n - 1 in each key), the roots of their aligned blocks, those of the blocks
    of these, and so on until every key has one."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        block = F.shiftright("pos", 3 * HEIGHT).alias("block")
        up = levels[-1].select("key", "pos", "n", "node", block).groupBy("key", "block")
        levels.append(materialize(up.applyInArrow(_block_roots, "key string, pos long, n long, node string"), "nodes"))
    return levels


def _paths(rows: pa.Table, upper: pa.Table) -> Iterator[tuple[list[str], list[str]]]:
    """(left siblings, right siblings) of each row from its block's leaves up to the root."""
    n = rows["n"][0].as_py()
    lefts, rights = upper["lefts"][0].as_py(), upper["rights"][0].as_py()
    for path in successive_paths(rows["node"].to_pylist(), min(HEIGHT, levels_of(n))):
        yield [p[0] for p in path] + lefts, [p[1] for p in path] + rights


def _upper(rows: pa.Table, upper: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    paths = list(_paths(rows, upper))
    texts, n = pa.list_(pa.string()), rows.num_rows
    return pa.table(
        {
            "key": rows["key"],
            "pos": rows["pos"],
            "lefts": pa.array([p[0] for p in paths], texts),
            "rights": pa.array([p[1] for p in paths], texts),
            "subroot": pa.array(upper["subroot"].to_pylist() * n, pa.string()),
            "root": pa.array(upper["root"].to_pylist() * n, pa.string()),
        }
    )


def descend(levels: list[DataFrame], top: DataFrame, last, schema) -> DataFrame:
    """Hand the proofs above each key's root (``top``: key, pos, lefts, rights, subroot, root) down through the ``levels`` of
    ``climb``; blocks of the lowest level meet theirs in ``last``. A block and the one row above it are all that a task
    needs at a time."""
    for i in reversed(range(len(levels) - 1)):
        below = levels[i].withColumn("block", F.shiftright("pos", 3 * HEIGHT)).groupBy("key", "block")
        above = top.withColumnRenamed("pos", "block").groupBy("key", "block")
        met = below.cogroup(above)
        top = met.applyInArrow(_upper, _UPPER) if i else met.applyInArrow(last, schema)
        top = materialize(top, "proofs") if i else top
    return top


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``; ``fields`` are hashed into its
    leaf, the first of them is the id and the last the text that tampering lower-cases.

    A row's leaf is made in the scan, after which texts are left behind. Leaves get their places in their group by
    prefix sums over a range partitioning. Aligned blocks of 4,096 become roots, and blocks of those, until each group
    has one (``climb``); the groups' subroots in order are one more such tree. Proofs then come down: every block
    traverses its own leaves and appends the proof of its root (``descend``).

    Null ids come last in their group; equal ids are ordered by leaf, and rows equal in all fields have equal leaves,
    so that the order among them changes nothing but which of them has which proof. A null group is a group of its
    own, the first. Null ids are never tampered with. An empty table gives no rows; extra columns are ignored.
    """
    key_col, text = F.col(fields[0]), F.col(fields[-1])
    chosen = F.coalesce(F.crc32(key_col.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    others = [F.col(c) for c in fields[:-1]]
    tampered = F.when(chosen, leaf_digest(*others, lower_ascii(text)))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("key"),
        key_col.alias("id"),
        leaf_digest(*others, text).alias("node"),
        tampered.alias("other"),
    )
    placed = materialize(prefix_sums(materialize(leaves, "leaves"), ["key", "id", "node", "other"]), "placed")
    groups = materialize(
        placed.groupBy("key").agg(F.min("position").alias("first"), F.count("*").alias("n")), "groups"
    )
    rows = join_groups(placed, groups.withColumn("_n", F.col("n")), "key", "_n")
    rows = materialize(
        rows.select("key", (F.col("position") - F.col("first")).alias("pos"), "n", "node", "id", "other"), "rows"
    )
    levels = climb(rows)
    ordered = prefix_sums(levels[-1].select("key", "node"), ["key"])
    n_groups = groups.count()
    subroots = materialize(
        ordered.select(
            F.lit("").alias("key"), F.col("position").alias("pos"), F.lit(n_groups).cast("long").alias("n"), "node",
            F.col("key").alias("group"),
        ),
        "subroots",
    )
    upper = climb(subroots)
    none = F.array().cast("array<string>")
    root = upper[-1].select(
        "key", "pos", none.alias("lefts"), none.alias("rights"), F.col("node").alias("subroot"), F.col("node").alias("root")
    )
    of_place = descend(upper, root, _upper, _UPPER)
    above = of_place.select("pos", "lefts", "rights", "root").join(
        subroots.select("pos", F.col("group").alias("key"), F.col("node").alias("subroot")), "pos"
    )
    above = above.select("key", F.lit(0).cast("long").alias("pos"), "lefts", "rights", "subroot", "root")
    above = materialize(above, "above")
    kind = docs.schema[fields[0]].dataType
    texts = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType(
        [
            T.StructField(fields[0], kind),
            *(T.StructField(c, T.StringType()) for c in texts),
            T.StructField("verified", T.BooleanType()),
        ]
    )

    def prove(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        proofs, folded = [], []
        changed = [o or n for n, o in zip(rows["node"].to_pylist(), rows["other"].to_pylist(), strict=True)]
        for node, (lefts, rights) in zip(changed, _paths(rows, upper), strict=True):
            proofs.append(digest("".join(x + y for x, y in zip(lefts, rights, strict=True))))
            for left, right in zip(lefts, rights, strict=True):
                node = digest(left + node + right)
            folded.append(node)
        root, n = upper["root"][0].as_py(), rows.num_rows
        return pa.table(
            [rows["id"], rows["node"], pa.array(upper["subroot"].to_pylist() * n, pa.string()), pa.array([root] * n, pa.string()),
             pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())],
            names=schema.fieldNames(),
        )

    return descend(levels if len(levels) > 1 else [levels[0], levels[0]], above, prove, schema)
