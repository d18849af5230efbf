"""Exact dedup by composable polynomial fingerprints.

The fingerprint of a byte string is its value as a polynomial in a fixed base modulo two primes. Fingerprints of neighbouring
chunks combine by length-shifted arithmetic, H(a + b) = H(a) * base ** len(b) + H(b), so the chunks of a huge document are
hashed in parallel and joined afterwards. Equal fingerprints are only a proposal: the texts behind them are compared chunk by
chunk, and the few groups in which two texts differ are split by their whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm import workers
from rulequarry.llm.frames import SPACES, numbered, whole_text
from rulequarry.session import Scratch

#: Two primes below 2 ** 31 and a base for each.
MODULI = (2147483647, 2147483629)
BASES = (1000003, 69069069)
#: Characters of a chunk. A longer text is cut, and its chunks are dealt over the cluster.
CHUNK = 1 << 16
_SPAN = 1 << 14

_powers: dict = {}


def _table(base: int, modulus: int) -> np.ndarray:
    """base ** (_SPAN - 1), ..., base, 1"""
    if (base, modulus) not in _powers:
        row, value = [], 1
        for _ in range(_SPAN):
            row.append(value)
            value = value * base % modulus
        _powers[base, modulus] = np.array(row[::-1], np.uint64)
    return _powers[base, modulus]


def combine(left: int, right: int, right_length: int, base: int, modulus: int) -> int:
    """The fingerprint of two neighbouring strings from those of its parts."""
    return (left * pow(base, right_length, modulus) + right) % modulus


def fingerprint(data: np.ndarray, base: int, modulus: int) -> int:
    """Of bytes; zero bytes in front count, as each byte is raised by one."""
    powers, value = _table(base, modulus), 0
    for i in range(0, len(data), _SPAN):
        part = data[i : i + _SPAN]
        value = combine(value, (int(part.astype(np.uint64) @ powers[_SPAN - len(part) :]) + int(powers[_SPAN - len(part) :].sum())) % modulus, len(part), base, modulus)
    return value


def _hash_chunks(moduli):
    def run(batches):
        workers.begin("exact")
        for batch in batches:
            hashes: list[list[int]] = [[] for _ in moduli]
            lengths = []
            for text in batch.column("chunk"):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                lengths.append(len(data))
                for h, base, modulus in zip(hashes, BASES, moduli, strict=True):
                    h.append(fingerprint(data, base, modulus))
            keep = [batch.column(c) for c in ("row", "part")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(lengths, pa.int64()), *(pa.array(h, pa.int64()) for h in hashes)], ["row", "part", "len", "h0", "h1"])

    return run


def _combine_chunks(moduli):
    """The rows of a document come together, in order of their parts, since the input is sorted."""

    def run(batches):
        workers.begin("exact")
        row, size, value = None, 0, [0, 0]
        for batch in batches:
            out = []
            for r, n, *h in zip(*(batch.column(c).to_pylist() for c in ("row", "len", "h0", "h1")), strict=True):
                if r != row:
                    if row is not None:
                        out.append((row, size, *value))
                    row, size, value = r, 0, [0] * len(moduli)
                value = [combine(a, b, n, base, m) for a, b, base, m in zip(value, h, BASES, moduli, strict=True)]
                size += n
            yield _rows(out)
        if row is not None:
            yield _rows([(row, size, *value)])

    return run


def _rows(rows):
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "len", "h0", "h1"])


def exact_groups(docs: DataFrame, scratch: Scratch, *, row: str | None = None, chunk: int = CHUNK, moduli: tuple = MODULI) -> DataFrame:
    """Group documents whose texts are equal once each run of ASCII white space is one space.

    Returns one row per input row: ``row`` (a number of this run, or the column of unique numbers that ``row`` names), ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256``. The row of the smallest doc_id stays; null ids come last, and of rows that share the smallest id the first
    read stays. A null text is empty, and empty texts equal one another. An empty table gives an empty result. Other columns
    of ``docs`` are ignored, whatever their names.

    Texts are shuffled once, by row number, and only where some fingerprint repeats; a group of any size is compared by
    an aggregation that keeps one chunk a task, so it never meets in one place. Joins by row number merge at every size:
    a side that grows with the documents is never broadcast.
    """
    norm = docs.select(*([F.col(row).alias("row")] if row else []), F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(whole_text(docs), SPACES, " ").alias("norm"))
    norm = scratch.keep(norm if row else numbered(norm, "row"))
    pieces = F.when(F.length("norm") <= chunk, F.array("norm")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length("norm") - 1) / chunk).cast("int")), lambda i: F.substring("norm", i * chunk + 1, F.lit(chunk))))
    hashed = "row long, part int, len long, h0 long, h1 long"
    short = norm.where(F.length("norm") <= chunk).select("row", F.lit(0).alias("part"), F.col("norm").alias("chunk")).mapInArrow(_hash_chunks(moduli), hashed).drop("part")
    long = norm.where(F.length("norm") > chunk).select("row", F.posexplode(pieces).alias("part", "chunk"))
    long = long.repartition("row", "part").mapInArrow(_hash_chunks(moduli), hashed).repartition("row").sortWithinPartitions("row", "part")
    prints = short.select("row", "len", "h0", "h1").union(long.mapInArrow(_combine_chunks(moduli), "row long, len long, h0 long, h1 long"))
    prints = scratch.keep(prints)
    key = ["len", "h0", "h1"]
    shared = scratch.keep(prints.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
    likely = scratch.keep(prints.join(shared, key, "left_semi"))

    # texts behind equal fingerprints, chunk by chunk: the smallest and the largest are the same only if all are
    parts = norm.join(likely.hint("merge"), "row").select(*key, F.posexplode(pieces).alias("part", "chunk"))
    odd = parts.groupBy(*key, "part").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select(*key).distinct()
    odd = scratch.keep(odd)
    split = norm.join(likely.join(odd, key, "left_semi").select("row"), "row", "left_semi")
    split = split.select("row", F.concat(F.lit("t"), "norm").alias("own"))

    facts = norm.select("row", "doc_id", F.sha2("norm", 256).alias("text_sha256")).join(prints.hint("merge"), "row")
    if odd.limit(1).count():
        facts = facts.join(split, "row", "left")
    else:
        facts = facts.withColumn("own", F.lit(None).cast("string"))
    facts = scratch.keep(facts.withColumn("own", F.coalesce("own", F.lit(""))))
    for table in (norm, prints, shared, likely, odd):
        scratch.drop(table)
    scratch.tidy()
    key.append("own")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    groups = facts.groupBy(*key).agg(F.count("*").alias("group_size"), F.min(order).alias("first")).where("group_size > 1")
    groups = scratch.keep(groups)  # a written side lets adaptive execution split the join's partition of a large group
    out = facts.join(groups, key, "left")
    return out.select(
        "row", "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows are matched by number in one written copy of the input."""
    rows = scratch.keep(docs.withColumn("_exact_row", F.monotonically_increasing_id()))
    kept = exact_groups(rows, scratch, row="_exact_row").where("kept").select(F.col("row").alias("_exact_row"))
    return rows.join(kept, "_exact_row", "left_semi").drop("_exact_row")
