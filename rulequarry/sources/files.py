"""Source files as tables: text, lines, heads found by pattern, and tree rows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulequarry.sources.elixir import SyntaxProblem, parse, rows

TREE = "path string, pre int, last int, parent int, ord int, depth int, kind string, form string, arg_count int, line int, lit_type string, lit string, up_form string, up2_form string"
_COLUMNS = [c.split(" ") for c in TREE.split(", ")]
_SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int32()) for n, t in _COLUMNS])
#: Parsing tasks for each core.
TASKS = 4
#: Fixed value: how a function head is found in text. Names that end in a mark, and arguments after a first closing parenthesis, are not seen.
HEAD = re.compile(r"^\s*(defp?)\s+(\w+)\s*\(([^)]*)\)(\s+when\s+[^\n]+)?", re.M)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """``path, source`` of every file below a folder or glob, on any store that Spark reads."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:(//)?", "").alias("path"), F.col("value").alias("source"))


def lines(files: DataFrame) -> DataFrame:
    """``path, line_no, text``; line numbers start at 1."""
    return files.select("path", F.posexplode(F.split("source", "\n", -1)).alias("i", "text")).select("path", (F.col("i") + 1).alias("line_no"), "text")


def _trees(batches):
    for batch in batches:
        out = []
        for path, source in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), strict=True):
            try:
                found = rows(parse(source or ""))
            except SyntaxProblem as e:
                found = [(-1, -1, -1, 0, 0, "error", None, None, None, None, str(e))]
            ups = [found[r[2]] if r[2] >= 0 else None for r in found]
            out += [(path, *r, u and u[6], u and u[2] >= 0 and found[u[2]][6] or None) for r, u in zip(found, ups, strict=True)]
            if len(out) > 50_000:
                yield _batch(out)
                out = []
        yield _batch(out)


def _batch(out):
    cols = list(zip(*out, strict=True)) or [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def tree_rows(files: DataFrame) -> DataFrame:
    """Nested-set rows of each file's syntax tree: a node's descendants are the rows of its path with ``pre`` in (pre, last].

    ``up_form`` and ``up2_form`` are the forms of a node's parent and of that one's, by which a join can leave out most rows before it deals them.
    A file that can't be parsed gives one row of kind ``error`` with the reason in ``lit``, and no structural facts.

    Sources are dealt to a number of tasks that doesn't depend on how they are stored: a table of small rows in one file would be parsed by one task.
    """
    n = files.sparkSession.sparkContext.defaultParallelism * TASKS
    return files.select("path", "source").repartition(n, "path", "source").mapInArrow(_trees, TREE)


def _heads(batches):
    names = ["path", "kind", "name", "args", "has_guard", "line", "start_line"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]
    for batch in batches:
        out = []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), strict=True):
            at, line = 0, 1
            for m in HEAD.finditer(text or ""):
                line += text.count("\n", at, m.start())
                at = m.start()
                out.append((path, m[1], m[2], m[3], m[4] is not None, line + text.count("\n", m.start(), m.start(1)), line))
        cols = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def text_heads(files: DataFrame) -> DataFrame:
    """``path, kind, name, args, has_guard, line, start_line`` of function heads found in the text. ``line`` is the keyword's; ``start_line`` is where
    the pattern begins, which may be a blank line above."""
    return files.select("path", "source").mapInArrow(_heads, "path string, kind string, name string, args string, has_guard boolean, line int, start_line int")
