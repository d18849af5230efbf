"""Substring dedup by hashing lines or paragraphs.

Each text is split into units, units are normalised and hashed, digests are grouped over the corpus, and every occurrence after the earliest
ranked one is removed. Offsets of the original text are kept for what is removed.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm.frames import whole_text
from rulequarry.session import Scratch

_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
#: How a text is split. A paragraph ends at a line break that is followed by empty lines.
SPLITS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[\x20\x09\x0B-\x0D]*(?:\n[\x20\x09\x0B-\x0D]*)+")}


def normalise(unit: str) -> str:
    return _SPACES.sub(" ", unit).strip(" ").translate(_UPPER)


def split_units(text: str, unit: str) -> list[tuple[int, int]]:
    """Offsets of the units; separators belong to none."""
    out, at = [], 0
    for m in SPLITS[unit].finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def _units(unit):
    names = ["doc", "row", "unit", "s", "e", "d0", "d1"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "text")), strict=True):
                for i, (s, e) in enumerate(split_units(text, unit)):
                    norm = normalise(text[s:e])
                    digest = hashlib.blake2b(norm.encode(), digest_size=16).digest() if norm else b""
                    d = [int.from_bytes(digest[k : k + 8], "big", signed=True) for k in (0, 8)] if norm else [None, None]
                    rows.append((doc, row, i, s, e, *d))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def unit_rows(docs: DataFrame, unit: str = "line") -> DataFrame:
    """``doc, row, unit, s, e, d0, d1``: each unit with its offsets and its 128-bit digest, null for a blank unit. ``docs`` has a unique ``row``."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), "row", whole_text(docs).alias("text"))
    return rows.mapInArrow(_units(unit), "doc long, row long, unit int, s long, e long, d0 long, d1 long")


def repeated_units(docs: DataFrame, scratch: Scratch, *, unit: str = "line") -> DataFrame:
    """``row, doc_id, n_units, removed``; removed: ``array<struct<s, e>>`` of the units that repeat an earlier one, in order.

    The earliest occurrence by doc_id (nulls last), row and place stays. Blank units are never removed; a null text is one blank unit. Units are
    counted map-side before the shuffle, and the join that finds later occurrences has written sides, so that a very common line is split.
    """
    rows = scratch.keep(unit_rows(docs, unit))
    order = F.struct("doc", "row", "unit")
    first = rows.where("d0 is not null").groupBy("d0", "d1").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    first = scratch.keep(first.select("d0", "d1", F.col("first.row").alias("first_row"), F.col("first.unit").alias("first_unit")))
    later = rows.join(first, ["d0", "d1"]).where("row <> first_row or unit <> first_unit")
    gone = scratch.keep(later.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("removed")))
    counts = rows.groupBy("row", "doc").agg(F.count("*").alias("n_units"))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    doc_id = F.when(F.col("doc") != (1 << 63) - 1, F.col("doc")).alias("doc_id")
    return counts.join(gone, "row", "left").select("row", doc_id, "n_units", F.coalesce("removed", none).alias("removed"))


def removal_spans(docs: DataFrame, scratch: Scratch, *, unit: str = "line") -> DataFrame:
    """Per row: ``doc_id, n_units, n_removed, chars_removed, removed_spans`` (``start-end`` offsets joined by commas).

    Null texts are empty, null or repeated ids give a row each, an empty table an empty result; other columns are ignored.
    """
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    out = repeated_units(rows, scratch, unit=unit)
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["s"], x["e"])), ",")
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), chars.alias("chars_removed"), spans.alias("removed_spans"))


def drop_units(docs: DataFrame, scratch: Scratch, *, unit: str = "line") -> DataFrame:
    """The rows of ``docs`` with ``text`` less its later units, each with the separator before it, and ``removed`` with the original offsets.

    Other columns stay, but for one named ``removed``, which is replaced.
    """
    rows = scratch.keep(docs.withColumn("_unit_row", F.monotonically_increasing_id()))
    gone = repeated_units(rows.select(F.col("_unit_row").alias("row"), "doc_id", "text"), scratch, unit=unit)

    @F.pandas_udf("string")
    def cut(text, removed):
        def one(t, spans):
            own, out, at = split_units(t, unit), [], 0
            for s, e in ((x["s"], x["e"]) for x in spans):
                place = bisect.bisect_left(own, (s,))
                before = own[place - 1][1] if place else s  # the separator goes as well
                out.append(t[at:before])
                at = e
            return "".join([*out, t[at:]])

        return text.combine(removed, lambda t, x: t if x is None or not len(x) else one(t, x))

    out = rows.drop("removed").join(gone.select(F.col("row").alias("_unit_row"), "removed"), "_unit_row")
    text = F.when(F.size("removed") > 0, cut(whole_text(out), F.col("removed"))).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*docs.drop("removed").columns, "removed")
