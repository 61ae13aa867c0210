"""Connected components of link tables: union-find inside each task, star rounds between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_groups, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its group) for every node that is not the smallest of its group under the links (a, b). Roots of
    groups that are linked are hooked onto the smaller one and paths are halved until labels agree over all links; the
    number of groups at least halves with each round."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id that occurs in ``links`` (columns a, b; no nulls): the smallest id reachable.

    Each task first shrinks its own links to a forest. Then large-star and small-star rounds (every node hands its
    neighbours the smallest node it knows) run until all trees are stars, some log(n) rounds. A node's links are never gathered: the
    rounds use a minimum per node and a join.
    """

    def shrink(batches):
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            a, b = forest(
                np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
            )
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    forests = links.select("a", "b").mapInArrow(shrink, "u long, v long").distinct()  # u > v
    tree, path = written(forests, "forest")
    while True:
        parents = tree.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        roots = tree.select(F.col("v").alias("u")).distinct()
        if parents.where("lo < hi").select("u").union(parents.join(roots, "u", "left_semi").select("u")).isEmpty():
            break
        both = tree.union(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        known = join_groups(both, least.withColumn("m", F.least("u", "m")), "u", "_n")  # a root may have most links
        large = known.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars, new = written(others.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(path)
        tree, path = stars, new
    heads = tree.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return tree.select(F.col("u").alias("id"), F.col("v").alias("component")).union(heads)
