"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints within ``distance`` bits agree on at least ``blocks - distance`` of ``blocks`` bit blocks. For each choice of that many
blocks, the distinct fingerprints are permuted so that the chosen blocks lead, dealt by them, and sorted by Gray rank, which keeps
equal leading blocks together and puts neighbours next to each other. Over each run of equal leading blocks stands a tree: a node
holds the bits that all fingerprints below it share (a mask and a pattern), less those that a node above holds already. A search
adds up differences on the way down and leaves out every group beyond the distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm.components import connected_components, local_components
from rulequarry.llm.frames import whole_text
from rulequarry.session import Scratch

SEED = 42
WIDTH = 64
_SLICE = 1 << 14
_ONE = np.uint64(1)


def shingle_bits(text: bytes, words_each: int) -> tuple[np.ndarray, int]:
    """How often each of the 64 bits is set over all shingles, and the number of shingles. Bytes above ASCII are kept as they are."""
    words = text.lower().split()
    counts = np.zeros(WIDTH, np.int64)
    if not words:
        return counts, 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_each, len(words))
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(spans), _SLICE):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[i : i + _SLICE]], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts, len(spans)


def simhash(text: bytes, words_each: int = 3) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; zero without words."""
    counts, n = shingle_bits(text, words_each)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _print_texts(words_each):
    def run(batches):
        for batch in batches:
            values = [simhash(t.as_buffer().to_pybytes(), words_each) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(np.array(values, np.uint64).view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, *keys: str, words_each: int = 3) -> DataFrame:
    """``keys`` and ``fp``, the SimHash of the whole text as a signed 64-bit number."""
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, whole_text(docs).alias("text")).mapInArrow(_print_texts(words_each), f"{kinds}, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each value in the binary reflected Gray order."""
    values = values.copy()
    for s in (1, 2, 4, 8, 16, 32):
        values ^= values >> np.uint64(s)
    return values


class GrayIndex:
    """A tree over distinct fingerprints in Gray order.

    ``ids`` marks the group of each fingerprint; groups are contiguous and never share a node. Level 0 holds the
    fingerprints themselves, and each node above covers at most ``fan`` neighbours of the level below.
    """

    def __init__(self, values: np.ndarray, ids: np.ndarray, fan: int = 8):
        self.values = values
        self.levels = [{"ones": values, "zeros": ~values, "group": ids, "last": np.arange(len(values))}]
        groups = len(np.unique(ids))
        while len(self.levels[-1]["group"]) > groups:
            below = self.levels[-1]
            group = below["group"]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            start = np.flatnonzero(place % fan == 0)
            end = np.append(start[1:], len(group))
            self.levels.append({
                "ones": np.bitwise_and.reduceat(below["ones"], start), "zeros": np.bitwise_and.reduceat(below["zeros"], start),
                "group": group[start], "last": below["last"][end - 1], "start": start, "end": end,
            })

    def links(self, distance: int, block: int = 1 << 15):
        """Yields pairs of places (a < b) of one group at ``distance`` bits or fewer."""
        top = self.levels[-1]
        for at in range(0, len(self.values) if len(self.levels) > 1 else 0, block):
            query = np.arange(at, min(at + block, len(self.values)))
            root = np.searchsorted(top["group"], self.levels[0]["group"][query])
            todo = [(len(self.levels) - 1, query, root, np.zeros(len(query), np.int64), np.zeros(len(query), np.uint64))]
            while todo:
                level, query, node, far, seen = todo.pop()
                here = self.levels[level]
                one, fixed = here["ones"][node], (here["ones"][node] | here["zeros"][node]) & ~seen  # bits that no node above has settled
                far = far + np.bitwise_count((self.values[query] ^ one) & fixed)
                ok = (far <= distance) & (here["last"][node] > query)
                query, node, far, seen = query[ok], node[ok], far[ok], (seen | fixed)[ok]
                if level == 0:
                    yield query, node
                    continue
                s, n = here["start"][node], here["end"][node] - here["start"][node]
                for i in range(0, len(query), block):
                    j = slice(i, i + block)
                    child = np.repeat(s[j] - np.cumsum(n[j]) + n[j], n[j]) + np.arange(n[j].sum())
                    todo.append((level - 1, np.repeat(query[j], n[j]), child, np.repeat(far[j], n[j]), np.repeat(seen[j], n[j])))


def masks(distance: int, blocks: int, within: int = (1 << WIDTH) - 1) -> list[int]:
    """The choices of ``blocks - distance`` of ``blocks`` nearly equal parts of the bits in ``within``."""
    bits = [i for i in range(WIDTH) if within >> i & 1]
    cuts = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[cuts[i] : cuts[i + 1]]) for i in range(blocks)]
    return [sum(x) for x in combinations(parts, blocks - distance)]


def _lead(values: np.ndarray, mask: int) -> np.ndarray:
    """Move the bits of the mask to the front, in order."""
    out, at = np.zeros(len(values), np.uint64), WIDTH
    for chosen in (1, 0):
        for bit in reversed(range(WIDTH)):
            if (mask >> bit & 1) == chosen:
                at -= 1
                out |= (values >> np.uint64(bit) & _ONE) << np.uint64(at)
    return out


def _search(distance):
    """Input sorted by (mask, key). Each run of one key is indexed and becomes a star of links for each local component."""

    def flush(parts):
        mask, key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        for m in np.unique(mask):
            here = mask == m
            own, value = key[here], fp[here].view(np.uint64)
            order = np.lexsort((gray_rank(_lead(value, int(np.int64(m).view(np.uint64)))), own))
            own, value = own[order], value[order]
            new = np.concatenate([[True], own[1:] != own[:-1]])
            found = list(GrayIndex(value, np.cumsum(new)).links(distance))
            a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            root = local_components(len(value), a, b)
            hung = np.flatnonzero(root != np.arange(len(value)))
            if len(hung):
                yield pa.RecordBatch.from_arrays([pa.array(value[hung].view(np.int64)), pa.array(value[root[hung]].view(np.int64))], ["u", "v"])

    def run(batches):
        parts, rows = [], 0
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp")]
            if rows >= 1 << 17:  # what is held ends with a key that may go on
                last = (parts[-1][0][-1], parts[-1][1][-1])
                cut = np.flatnonzero((cols[0] != last[0]) | (cols[1] != last[1]))
                cut = int(cut[0]) if len(cut) else len(cols[0])
                parts.append([c[:cut] for c in cols])
                rows += cut
                cols = [c[cut:] for c in cols]
                if len(cols[0]):
                    yield from flush(parts)
                    parts, rows = [], 0
            if len(cols[0]):
                parts.append(cols)
                rows += len(cols[0])
        if parts:
            yield from flush(parts)

    return run


def hamming_links(prints: DataFrame, scratch: Scratch, *, distance: int, blocks: int, most: int = 1 << 15) -> DataFrame:
    """Links ``(u, v)`` over distinct 64-bit ``fp`` that connect just what pairs within ``distance`` bits connect.

    A key (a choice of blocks and their bits) with more than ``most`` fingerprints is dealt again by choices of further blocks among
    its other bits, which loses no pair; after two such steps a key leaves so few bits free that its size is bounded.
    """
    todo = prints.select(F.lit(0).cast("long").alias("mask"), "fp").where("fp is not null").distinct()
    free, links = [(1 << WIDTH) - 1], None
    for step in range(3):
        table = {}
        for within in free:
            outer = (1 << WIDTH) - 1 - within
            table[outer] = [outer | m for m in masks(distance, blocks, within)]
        signed = lambda x: x - (1 << WIDTH) if x >> 63 else x
        choice = F.create_map(*(x for k, v in table.items() for x in (F.lit(signed(k)), F.array(*(F.lit(signed(m)) for m in v)))))
        keyed = todo.select("fp", F.explode(choice[F.col("mask")]).alias("mask")).select("mask", F.expr("fp & mask").alias("key"), "fp")
        deal = keyed
        if step < 2:
            large = scratch.keep(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mask", "key"))
            some = large.limit(1).count() > 0
            if some:
                keyed = scratch.keep(keyed)
                deal = keyed.join(large, ["mask", "key"], "left_anti")
        found = deal.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_search(distance), "u long, v long")
        links = found if links is None else links.union(found)
        if step == 2 or not some:
            return links
        todo = keyed.join(large, ["mask", "key"], "left_semi").select("mask", "fp").distinct()
        free = [(1 << WIDTH) - 1 - m for v in table.values() for m in v]


def near_groups(docs: DataFrame, scratch: Scratch, *, words_each: int = 3, distance: int = 2, blocks: int = 4) -> DataFrame:
    """``row``, ``doc_id``, ``fp``, ``group`` (a fingerprint that stands for the group) and ``component_id``, the smallest doc_id reachable over fingerprints ``distance`` bits apart or fewer.

    ``docs`` has ``doc_id``, ``text`` and, if it has one, a column ``row`` that is carried along. A text without words, empty or null, has
    fingerprint zero and is linked like any other. Fewer words than a shingle has make one shingle. Rows without doc_id are
    linked like others, but a group has such an id only if all its rows lack one. Repeated rows each give a row. An empty table gives an empty
    result. Only distinct fingerprints are dealt out, so copies cost one row a task.
    """
    if "row" not in docs.columns:
        docs = docs.withColumn("row", F.lit(None).cast("long"))
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = scratch.keep(fingerprints(docs, "row", "doc_id", words_each=words_each))
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    links = scratch.keep(hamming_links(distinct, scratch, distance=distance, blocks=blocks))  # written, so that a task needs one Python worker at a time
    groups = connected_components(links, scratch).withColumnsRenamed({"node": "fp", "component": "group"})
    distinct = scratch.keep(distinct.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp")))
    least = scratch.keep(distinct.groupBy("group").agg(F.min("doc_id").alias("component_id")))
    distinct = scratch.keep(distinct.join(least, "group").select("fp", "group", "component_id"))
    return prints.join(distinct, "fp")


def drop_near_copies(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the row of the smallest doc_id, rows without one last."""
    rows = scratch.keep(docs.withColumn("_near_row", F.monotonically_increasing_id()))
    groups = near_groups(rows.select(F.col("_near_row").alias("row"), "doc_id", "text"), scratch, **how)
    kept = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("_near_row"))
    return rows.join(kept, "_near_row", "left_semi").drop("_near_row")
