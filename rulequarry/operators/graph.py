"""Closure and paths over a directed graph."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulequarry.session import Scratch


#: Edges, and bytes of their names, up to which each task gets all of them. They change how the work is dealt and not the result.
EDGES = 200_000
BYTES = 16 << 20
#: The same for paths, whose edges are sent as numbers of four bytes.
PATH_EDGES = 4_000_000
PATH_BYTES = 128 << 20
_PLAIN = {"string": str, "tinyint": int, "smallint": int, "int": int, "bigint": int}


def _walk(edges):
    """All pairs of each start, by a search that sees each node once."""

    def run(batches):
        after: dict = {}
        for a, b in edges.value:
            after.setdefault(a, []).append(b)
        for batch in batches:
            kinds = batch.schema.types
            for start in batch.column("start").to_pylist():
                seen, todo = {start}, [start]
                while todo:
                    new = [x for x in after.get(todo.pop(), ()) if x not in seen]
                    seen.update(new)
                    todo += new
                nodes = pa.array(list(seen), kinds[1])
                yield pa.RecordBatch.from_arrays([pa.array([start] * len(seen), kinds[0]), nodes], ["start", "node"])

    return run


def _few(edges: DataFrame, most: int, most_bytes: int) -> bool:
    """Whether the edges and the bytes of their names are within the bounds."""
    size = sum((F.octet_length(F.col(c).cast("string")) for c in ("src", "dst")), F.lit(0))
    held = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return held["n"] <= most and held["bytes"] <= most_bytes


def transitive_closure(edges: DataFrame, starts: DataFrame, scratch: Scratch) -> DataFrame:
    """``start, node``: all nodes reachable from each row of ``starts(start)``, itself included; cycles end, unknown nodes are leaves, nulls take no part.

    Up to EDGES edges are sent to every task, which walks from its starts; so paths of any length take one pass. More edges are joined in a frontier
    loop: each round joins only the pairs that are new, and writes them, so a lost executor costs one round. Both give the same pairs.
    """
    edges = scratch.keep(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())
    seen = scratch.keep(starts.where("start is not null").select("start", F.col("start").alias("node")).distinct())
    plain = {_PLAIN.get(kind) for _, kind in edges.dtypes + seen.dtypes}
    if len(plain) == 1 and None not in plain and _few(edges, EDGES, BYTES):
        spark = scratch.spark
        sent = spark.sparkContext.broadcast([tuple(r) for r in edges.collect()])
        kind = dict(seen.union(edges).dtypes)["node"]  # the wider one
        asked = seen.withColumn("node", F.col("node").cast(kind)).repartition(spark.sparkContext.defaultParallelism, "start")
        return scratch.keep(asked.mapInArrow(_walk(sent), asked.schema))
    new = seen
    while True:
        step = new.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        new = scratch.keep(step.join(seen, ["start", "node"], "left_anti"))
        if not new.limit(1).count():
            return seen
        seen = seen.union(new)  # both are written tables


def _numbered(edges: DataFrame) -> tuple:
    """The names of all nodes, sorted, where each one's neighbours begin, and the neighbours, sorted too; nodes go by their place among the names."""
    table = edges.toArrow()
    src, dst = (table.column(c).combine_chunks() for c in ("src", "dst"))
    names = pc.unique(pa.concat_arrays([src, dst]))
    names = names.take(pc.sort_indices(names))
    a, b = (pc.index_in(x, names).to_numpy(zero_copy_only=False).astype(np.int32) for x in (src, dst))
    order = np.lexsort((b, a))
    return names, array("i", np.searchsorted(a[order], np.arange(len(names) + 1)).astype(np.int32).tobytes()), array("i", b[order].tobytes())


def _walk_paths(graph, schema):
    """The paths to the targets of each start. Depth-first search meets all nodes in the same order whatever it looks for, so one search serves all
    targets, and the path to each is the one by which it was first met."""

    def run(batches):
        names, begin, after = graph.value
        n = len(names)
        came, at = array("i", [-1]) * n, array("i", begin)

        def told(pairs, nodes, ends):
            starts, targets = (names.take(pa.array(x, pa.int32())) for x in (pairs[::2], pairs[1::2]))
            return pa.RecordBatch.from_arrays([starts, targets, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(nodes, pa.int32())))], schema)

        for batch in batches:
            asked = batch.column("targets")
            starts, places = (pc.index_in(x, names).to_pylist() for x in (batch.column("start"), asked.flatten()))
            pairs, nodes, ends, first = array("i"), array("i"), array("i", [0]), 0
            for node, many in zip(starts, pc.list_value_length(asked).to_pylist(), strict=True):
                own, first = places[first : first + many], first + many
                if node is None:  # no edges
                    continue
                todo, met, here = {x for x in own if x is not None and x != node}, [node], node
                came[node] = node
                while todo:
                    i = at[here]
                    if i == begin[here + 1]:
                        if here == node:
                            break
                        here = came[here]
                        continue
                    at[here] = i + 1
                    new = after[i]
                    if came[new] < 0:
                        came[new] = here
                        met.append(new)
                        todo.discard(new)
                        here = new
                for target in own:
                    if target is None or target == node or came[target] < 0:
                        continue
                    path = [target]
                    while path[-1] != node:
                        path.append(came[path[-1]])
                    pairs.extend((node, target))
                    nodes.extend(reversed(path))
                    ends.append(len(nodes))
                for x in met:
                    came[x], at[x] = -1, begin[x]
                if len(nodes) > 1 << 16:
                    yield told(pairs, nodes, ends)
                    pairs, nodes, ends = array("i"), array("i"), array("i", [0])
            yield told(pairs, nodes, ends)

    return run


def _search():
    """The first path from the start to the target of each group of edges, by depth-first search over sorted neighbours."""

    def run(table):
        start, target = table.column("start")[0].as_py(), table.column("target")[0].as_py()
        after: dict = {}
        for a, b in zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True):
            after.setdefault(a, []).append(b)
        path, seen, todo = [start], {start}, [iter(sorted(after.get(start, ())))]
        while path and path[-1] != target:
            step = next((x for x in todo[-1] if x not in seen), None)
            if step is None:  # what was left behind can't reach the target but over the path that led to it
                path.pop()
                todo.pop()
            else:
                seen.add(step)
                path.append(step)
                todo.append(iter(sorted(after.get(step, ()))))
        found = [path] if path else []
        kinds = [table.schema.field("start").type, table.schema.field("target").type, pa.list_(table.schema.field("src").type)]
        return pa.table([pa.array([x] * len(found), k) for x, k in zip((start, target), kinds, strict=False)] + [pa.array(found, kinds[2])], ["start", "target", "path"])

    return run


def first_paths(edges: DataFrame, pairs: DataFrame, scratch: Scratch, *, forward: DataFrame | None = None) -> DataFrame:
    """``start, target, path``: the lexicographically first simple path, which is what depth-first search over sorted neighbours finds.

    Each node is seen once, in one task for a start, so paths may have any length. Up to PATH_EDGES edges are sent to every task as numbers. Of more, or
    with ``forward`` (the closure of all starts of ``pairs`` over ``edges``, if the caller has it already), only those between nodes that the start
    reaches and that reach the target go to a pair's task. Both give the same paths.
    """
    pairs = pairs.distinct()
    same = pairs.where("start = target").select("start", "target", F.array(F.col("start").cast(edges.schema["src"].dataType)).alias("path"))
    if forward is None and len({kind for _, kind in edges.select("src", "dst").dtypes + pairs.dtypes}) == 1 and edges.schema["src"].dataType.simpleString() in _PLAIN:
        edges = scratch.keep(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())
        if _few(edges, PATH_EDGES, PATH_BYTES):
            spark, kind = scratch.spark, edges.schema["src"].dataType.simpleString()
            sent = spark.sparkContext.broadcast(_numbered(edges))
            asked = pairs.where("start <> target").groupBy("start").agg(F.collect_list("target").alias("targets"))
            asked = asked.repartition(spark.sparkContext.defaultParallelism, "start")
            return scratch.keep(asked.mapInArrow(_walk_paths(sent, ["start", "target", "path"]), f"start {kind}, target {kind}, path array<{kind}>")).union(same)
    if forward is None:
        forward = transitive_closure(edges, pairs.select("start").distinct(), scratch)
    back = transitive_closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), pairs.select(F.col("target").alias("start")).distinct(), scratch)
    useful = forward.join(pairs, "start").join(back.select(F.col("start").alias("target"), "node"), ["target", "node"])
    useful = scratch.keep(useful.select("start", "target", "node").distinct())
    edges = edges.where("src <> dst").select("src", "dst").distinct()
    steps = useful.withColumnRenamed("node", "src").join(edges, "src").join(useful.withColumnRenamed("node", "dst"), ["start", "target", "dst"], "left_semi")
    kind = {c: (edges if c in ("src", "dst") else pairs).schema[c].dataType.simpleString() for c in ("start", "target", "src")}
    steps = steps.where("start <> target").select("start", "target", "src", "dst")
    found = steps.groupBy("start", "target").applyInArrow(_search(), f"start {kind['start']}, target {kind['target']}, path array<{kind['src']}>")
    return found.union(same)


def chain_text(path: Column) -> Column:
    """How a path of more than two nodes is told."""
    return F.when(F.size(path) > 2, F.concat(F.lit(" (dependency chain: "), F.array_join(path, " -> "), F.lit(")"))).otherwise("")
