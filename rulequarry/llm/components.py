"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.session import Scratch


class Forest:
    """Union-find over hashable values; the root of a set is its smallest value."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contract(batches):
    """Replace the edges of each batch of at most 10,000 rows by stars to the smallest node of each local component."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        nodes = list(forest.parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, batch.schema.field(0).type), pa.array([forest.find(x) for x in nodes], batch.schema.field(0).type)], ["u", "v"])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(u, v)`` of one comparable type -> ``(node, component)``, component being the smallest node reachable.

    Only nodes of some edge between two different nodes are returned; null ends, loops and repeated edges count for nothing.
    Each round joins edges with a per-node minimum that is aggregated map-side and written, so that the
    join on a node of very many edges stays a plain one, whose large partitions adaptive execution splits. Every round is written to the shared folder, so that a lost executor
    costs one round. Rounds grow with the logarithm of the longest path.
    """
    kind = edges.schema["u"].dataType.simpleString()
    edges = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v")
    now = scratch.keep(edges.mapInArrow(_contract, f"u {kind}, v {kind}").distinct())
    seen = None
    while True:
        # large star: every neighbour above u is hung on the smallest of u and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least1 = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are hung on the smallest of these
        large = scratch.keep(large)
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = scratch.keep(small.select("e.u", "e.v").where("u <> v").distinct())
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        for table in (now, least1, large, least):
            scratch.drop(table)
        now = after
        if state == seen:
            return now.union(now.select("v", "v").distinct()).toDF("node", "component")
        seen = state


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the edges a-b, by vectorised label passing."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label
