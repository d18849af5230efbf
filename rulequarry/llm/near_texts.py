"""Near-duplicate texts by SimHash: candidates by the Gray-order index, then the Jaccard similarity of their shingles of five words.

At a similarity of 0.8 SimHashes of 128 bits differ by about 19 bits and seldom by more than FAR, too many for pigeonhole blocks. So fingerprints are dealt
by TABLES choices of BITS of their bits, and a Gray-order tree over the first 64 bits searches those with equal choices. A pair that differs by b bits is
met with a chance of about 1 - (1 - (1 - b / 128) ** BITS) ** TABLES, and every candidate is verified on its whole sets of shingles before it is linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm import candidates, workers
from rulequarry.llm.components import connected_components, local_components
from rulequarry.llm.frames import whole_text
from rulequarry.llm.minhash import mixed, windows
from rulequarry.llm.simhash import WIDTH, GrayIndex, gray_rank
from rulequarry.session import Scratch

WORDS, SIMILARITY = 5, 0.8
#: Choices of bits, bits of each; bits of 128, and of the first 64, in which candidates differ at most.
TABLES, BITS, FAR, FAR_HALF = 64, 12, 34, 20
_SLICE = 1 << 14


class _Hashes(dict):
    """The hash of each word seen; at most 300,000 are held."""

    def __missing__(self, word):
        if len(self) >= 300_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 42)
        return value


_words = _Hashes()
workers.keeps("near_texts", _words.clear)


def shingles(text: bytes, words_each: int = WORDS) -> np.ndarray:
    """The different hashes of all runs of so many words, ASCII letters in lower case. Fewer words make one shingle; no words make one of their own."""
    words = text.lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    values = mixed(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
    return np.unique(windows(values, min(words_each, len(words))))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


def _near(least):
    return lambda a, b: jaccard(a, b) >= least - 1e-12


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """The SimHash of a set of hashes in two halves of 64 bits: each bit is set if it is in over half of them."""
    out = []
    for half in (values, mixed(values + np.uint64(0x9E3779B97F4A7C15))):
        counts = np.zeros(WIDTH, np.int64)
        for i in range(0, len(half), _SLICE):
            counts += np.unpackbits(half[i : i + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(counts * 2 > len(half), bitorder="little").tobytes(), "little", signed=True))
    return out[0], out[1]


def _print_texts(batches):
    workers.begin("near_texts")
    for batch in batches:
        prints = [fingerprint(shingles(t.as_buffer().to_pybytes())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("number"), *(pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1))], ["number", "a", "b"])


def choices(tables: int, bits: int) -> list[tuple[int, int]]:
    """Masks over both halves, each of ``bits`` of the 128 bits."""
    rng, out = np.random.default_rng(42), []
    for _ in range(tables):
        mask = np.zeros(2 * WIDTH, np.uint8)
        mask[rng.choice(2 * WIDTH, bits, replace=False)] = 1
        out.append(tuple(np.packbits(mask, bitorder="little").view("<i8").tolist()))
    return out


def _search(far, far_half):
    """Input sorted by key. Yields ``bucket, number`` for each set of rows of one key that hang together within ``far`` bits; up to PAIRS of them as pairs."""

    def distance(a, b, i, j):
        return np.bitwise_count(a[i] ^ a[j]).astype(np.int64) + np.bitwise_count(b[i] ^ b[j])

    def flush(parts, seen):
        key, number, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        a, b = a.view(np.uint64), b.view(np.uint64)
        order = np.lexsort((gray_rank(a), key))
        key, number, a, b = key[order], number[order], a[order], b[order]
        label, found, held = np.arange(len(key)), [], 0
        for i, j in GrayIndex(a, np.cumsum(np.append(True, key[1:] != key[:-1]))).links(far_half):
            near = distance(a, b, i, j) <= far
            found.append((label[i[near]], label[j[near]]))
            held += len(found[-1][0])
            if held > 1 << 20:  # a large group has very many pairs
                label = local_components(len(key), *(np.concatenate(x) for x in zip(*found, strict=True)))[label]
                found, held = [], 0
        if held:
            label = local_components(len(key), *(np.concatenate(x) for x in zip(*found, strict=True)))[label]
        buckets, rows = [], []
        order = np.argsort(label, kind="stable")
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(label[order]) != 0)), len(order))
        for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
            own = order[cuts[k] : cuts[k + 1]]
            own = own[np.argsort(number[own])]
            if len(own) > candidates.PAIRS:
                sets = [own]
            else:
                i, j = np.triu_indices(len(own), 1)
                near = distance(a, b, own[i], own[j]) <= far
                sets = np.stack([own[i[near]], own[j[near]]], axis=1)
            for x in sets:
                name = xxhash.xxh3_64_intdigest(number[x].tobytes())
                if name not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                    buckets.append(np.full(len(x), np.uint64(name)).view(np.int64))
                    rows.append(number[x])
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (buckets, rows)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "number"])

    def run(batches):
        workers.begin("near_texts")
        parts, size, seen = [], 0, set()
        for batch in batches:
            table = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "number", "a", "b")]
            if size >= 1 << 17:  # what is held ends with a key that may go on
                cut = int(np.searchsorted(table[0], parts[-1][0][-1], side="right"))
                parts.append([c[:cut] for c in table])
                table = [c[cut:] for c in table]
                if len(table[0]):
                    yield flush(parts, seen)
                    parts, size = [], 0
            if len(table[0]):
                parts.append(table)
                size += len(table[0])
        if parts:
            yield flush(parts, seen)

    return run


def _shingle_texts(batches):
    workers.begin("near_texts")
    for batch in batches:
        sets = [shingles(t.as_buffer().to_pybytes()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["number", "size", "value"])


def near_links(texts: DataFrame, scratch: Scratch, *, least: float = SIMILARITY, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """Links ``(u, v)`` between numbers of ``texts(number, text)`` whose shingles have a Jaccard similarity of ``least`` or more."""
    prints = scratch.keep(texts.mapInArrow(_print_texts, "number long, a long, b long"))
    masks = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(choices(tables, bits))))
    keyed = prints.withColumn("m", F.explode(masks)).select(F.expr("xxhash64(m.i, a & m.a, b & m.b)").alias("key"), "number", "a", "b")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    met = scratch.keep(dealt.mapInArrow(_search(FAR, FAR_HALF), "bucket long, number long").distinct())
    asked = scratch.keep(met.select("number").distinct())
    values = scratch.keep(texts.join(asked, "number", "left_semi").mapInArrow(_shingle_texts, "number long, size long, value binary"))
    return scratch.keep(candidates.links(met, values, scratch, _near(least), least, lambda x: np.frombuffer(x, np.uint64)))


def drop_near_copies(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each connected group of near texts the row of the smallest doc_id, rows without one last."""
    rows = scratch.keep(docs.withColumn("_near_row", F.monotonically_increasing_id()))
    links = near_links(rows.select(F.col("_near_row").alias("number"), whole_text(rows).alias("text")), scratch, **how)
    groups = connected_components(links, scratch).withColumnsRenamed({"node": "_near_row", "component": "group"})
    # rows without a link are their own group and stay
    linked = rows.select("_near_row", F.col("doc_id").cast("long").alias("doc_id")).join(groups, "_near_row")
    first = linked.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_near_row")).alias("first")).select(F.col("first._near_row").alias("_near_row"))
    gone = scratch.keep(linked.join(first, "_near_row", "left_anti").select("_near_row"))
    return rows.join(gone, "_near_row", "left_anti").drop("_near_row")
