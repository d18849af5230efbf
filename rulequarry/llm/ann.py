"""Approximate nearest neighbours over an inverted multi-index.

Each half of the vectors has a codebook of its own; a pair of centroids names a cell. A query walks through pairs of centroids in order of summed
distance, with a heap over the two sorted lists, until the cells it has met hold enough vectors, and these are ranked by their true distance.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulequarry.session import Scratch

#: Centroids of a half, rows that the codebooks are fitted on, distinct vectors that a query meets at least, as a number and as a share of all
#: (vectors without clusters need the share for a recall of 0.9), query vectors of a block.
CENTROIDS = 64
FIT_ROWS = 20_000
CANDIDATES = 6_000
SHARE = 0.4
BLOCK = 8_192


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Vectors that take part: not null, not empty or zero, without null or non-finite components."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


def _pairs(batch) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column("v")
    ids = batch.column("id").to_numpy()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))


def _gather(most, room=100_000):
    """Distinct vectors of a task, each with its smallest ids."""

    def run(batches):
        held: dict[bytes, list[int]] = {}
        for batch in batches:
            if batch.num_rows:
                for key, own in zip(batch.column("v").to_pylist(), batch.column("id").to_pylist(), strict=True):
                    ids = held.setdefault(np.array(key).tobytes(), [])
                    ids.append(own)
                    if len(ids) >= 4 * most:
                        held[np.array(key).tobytes()] = sorted(ids)[:most]
            if len(held) > room:
                yield from _held(held, most)
                held = {}
        yield from _held(held, most)

    return run


def _held(held, most):
    keys = list(held)
    for i in range(0, len(keys), 10_000):
        part = keys[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([sorted(held[k])[:most] for k in part], pa.list_(pa.int64()))], ["key", "ids"])


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's iterations from distinct sampled points; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)] or [np.zeros(0, np.int64)])


def walk(left: np.ndarray, right: np.ndarray, held: dict[int, int], enough: int) -> list[int]:
    """Cells in order of left[i] + right[j] until they hold ``enough`` vectors; held: vectors of the cells that have any."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, pushed, out, got = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and got < enough and len(out) < len(held):
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(right) + int(b[j])
        if n := held.get(cell):
            out.append(cell)
            got += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (left[a[x]] + right[b[y]], x, y))
    return out


class Best:
    """The smallest ``k`` (distance, id) of each query so far."""

    def __init__(self, k: int):
        self.k, self.parts, self.rows = k, [], 0

    def add(self, query, score, ids):
        self.parts.append((query, score, ids))
        self.rows += len(query)
        if self.rows > 1 << 19:
            self.shrink()

    def shrink(self):
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        q, s, i = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((i, s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = place < self.k
        self.parts = [(q[keep], s[keep], i[keep])]
        self.rows = int(keep.sum())
        return self.parts[0]


def _search(shared, k):
    def run(batches):
        numbers, query, cells, which = shared.value  # which[cells[c] : cells[c + 1]]: queries that meet cell c
        square, best = (query**2).sum(1), Best(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("key").to_pylist()), "<f8").reshape(batch.num_rows, -1)
            cell, ids = batch.column("cell").to_numpy(), batch.column("ids")
            flat, ends = ids.flatten().to_numpy(), np.cumsum(np.array(ids.value_lengths()))
            for c in np.unique(cell):
                q, rows = which[cells[c] : cells[c + 1]], np.flatnonzero(cell == c)
                step = max(1, (1 << 20) // max(1, len(rows)))
                for at in range(0, len(q), step):
                    own = q[at : at + step]
                    norm = (x[rows] ** 2).sum(1)
                    d = norm[:, None] - 2 * x[rows] @ query[own].T + square[own]
                    worst = np.partition(d, k - 1, axis=0)[k - 1] if len(rows) > k else np.full(len(own), np.inf)
                    r, o = np.nonzero(d <= worst + 1e-9 * (norm.max() + square[own]))
                    for i in range(0, len(r), 1 << 16):
                        a, b = rows[r[i : i + (1 << 16)]], own[o[i : i + (1 << 16)]]
                        score = np.sqrt(((x[a] - query[b]) ** 2).sum(1))
                        n = ends[a] - np.append(0, ends)[a]
                        place = np.repeat(ends[a] - np.cumsum(n), n) + np.arange(n.sum())
                        best.add(np.repeat(b, n), np.repeat(score, n), flat[place])
        q, s, i = best.shrink()
        yield pa.RecordBatch.from_arrays([pa.array(numbers[q], pa.int64()), pa.array(s), pa.array(i, pa.int64())], ["number", "score", "id"])

    return run


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, scratch: Scratch, *, k: int = 10, id: str = "vec_id", vector: str = "embedding",
    centroids: int = CENTROIDS, fit_rows: int = FIT_ROWS, candidates: int = CANDIDATES, share: float = SHARE, block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its ``k`` nearest rows of ``vectors`` with another id, by Euclidean distance.

    Both tables have ``id`` and ``vector``. Codebooks are fitted on at most ``fit_rows`` distinct vectors, the first by hash; every vector is
    indexed. A query meets whole cells until they hold ``candidates`` distinct vectors and ``share`` of all, so
    results are exact for tables of no more than ``candidates``. Ties go to the
    smaller id. Null, zero, empty and non-finite vectors, rows without id, and vectors of another length than most of the fitted ones take no
    part; with no vectors left the result is empty. Repeated ids count once for each different vector.

    Equal vectors are one entry with its k + 1 smallest ids, gathered in each task before the shuffle. The index is dealt by range of cell and
    entry number, so that a full cell spans tasks. Query vectors go out in blocks of about ``block``, which bounds what is broadcast;
    each task keeps k + 1 rows a query.
    """
    spark = vectors.sparkSession
    read = lambda df: usable(df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")), "v").where("id is not null")
    most = k + 1
    entries = read(vectors).mapInArrow(_gather(most), "key binary, ids array<bigint>")
    entries = entries.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))
    entries = scratch.keep(entries.withColumn("number", F.monotonically_increasing_id()))
    asked = read(queries).mapInArrow(_keys, "id long, key binary").distinct()
    asked = scratch.keep(asked.select(F.col("id").alias("query_id"), "key"))

    sample = [np.frombuffer(r.key, "<f8") for r in entries.select("key").orderBy(F.xxhash64("key"), "key").limit(fit_rows).collect()]
    empty = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], empty)
    lengths = np.bincount([len(x) for x in sample])
    width = int(lengths.argmax())
    points = np.array([x for x in sample if len(x) == width])
    half = (width + 1) // 2
    books = [kmeans(p, centroids, seed=s) for s, p in enumerate((points[:, :half], points[:, half:])) if p.shape[1]]
    if len(books) == 1:
        books.append(np.zeros((1, 0)))

    fits = F.length("key") == 8 * width
    index = entries.where(fits).mapInArrow(_assign(books, half), "key binary, ids array<bigint>, number long, cell int")
    index = scratch.keep(index.repartitionByRange("cell", "number"))
    held = {r.cell: r.n for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most centroids ** 2 rows

    wanted = asked.where(fits).select("key").distinct().withColumn("number", F.monotonically_increasing_id())
    wanted = scratch.keep(wanted.mapInArrow(_walks(books, half, held, max(candidates, share * sum(held.values()))), "key binary, number long, cells array<int>"))
    blocks = max(1, -(-wanted.count() // block))
    found = None
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        size = len(books[0]) * len(books[1])
        cells = np.repeat(np.arange(len(rows)), [len(r.cells) for r in rows]), np.array([c for r in rows for c in r.cells], np.int64)
        order = np.argsort(cells[1], kind="stable")
        shared = spark.sparkContext.broadcast((
            np.array([r.number for r in rows]), np.array([np.frombuffer(r.key, "<f8") for r in rows]),
            np.append(0, np.cumsum(np.bincount(cells[1], minlength=size))), cells[0][order],
        ))
        part = index.select("key", "ids", "cell").mapInArrow(_search(shared, most), "number long, score double, id long")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], empty)
    by = Window.partitionBy("number").orderBy("score", "id")
    found = scratch.keep(found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= most).drop("n"))
    found = found.join(wanted.select("number", "key"), "number").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = asked.select("query_id", "key").distinct().join(found, "key").select("query_id", F.posexplode(near).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), "x.score")


def _keys(batches):
    for batch in batches:
        keys = [np.array(v).tobytes() for v in batch.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary())], ["id", "key"])


def _matrix(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("key").to_pylist()), "<f8").reshape(batch.num_rows, -1)


def _assign(books, half):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                cell = nearest(x[:, :half], books[0]) * len(books[1]) + nearest(x[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    return run


def _walks(books, half, held, enough):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                left, right = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
                cells = [walk(a, b, held, enough) for a, b in zip(left, right, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("number"), pa.array(cells, pa.list_(pa.int32()))], ["key", "number", "cells"])

    return run
