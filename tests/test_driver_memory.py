"""What the checks hold in the driver."""

import pyarrow as pa
import pytest

from rulequarry.operators import graph
from rulequarry.plans.engine import run_checks
from rulequarry.sources.config import Rule


def test_paths_of_the_check_take_no_closure(spark, monkeypatch):
    """The pairs of all starts and what they reach aren't made, and the edges aren't collected as rows."""

    def never(*how, **named):
        raise AssertionError("closure")

    monkeypatch.setattr(graph, "transitive_closure", never)
    monkeypatch.setattr("rulequarry.operators.checks.transitive_closure", never, raising=False)
    calls = {"A": "B C", "B": "D A", "C": "X", "D": "Y", "E": "F", "F": "E", "Y": "X", "X": "A"}
    files = [(f"{m}.ex", f"defmodule {m} do\n" + "".join(f"  alias {x}\n" for x in to.split()) + "end") for m, to in calls.items()]
    df = spark.createDataFrame([*files, ("none.ex", "f(")], "path string, source string")
    found = run_checks(df, [Rule("no_transitive_dependency", paths=["*.ex"], forbidden_modules=["X", "Y", "Nowhere"])])
    got = {(r.path, r.trigger): (r.line_no, r.message.split("(dependency chain: ")[-1].rstrip(")")) for r in found.collect()}
    assert got == {
        ("A.ex", "X"): (2, "A -> B -> D -> Y -> X"), ("A.ex", "Y"): (2, "A -> B -> D -> Y"), ("B.ex", "X"): (3, "B -> A -> C -> X"), ("B.ex", "Y"): (2, "B -> D -> Y"),
        ("C.ex", "X"): (2, "Module has transitive dependency on forbidden module X"), ("C.ex", "Y"): (2, "C -> X -> A -> B -> D -> Y"), ("D.ex", "Y"): (2, "Module has transitive dependency on forbidden module Y"),
        ("D.ex", "X"): (2, "D -> Y -> X"), ("Y.ex", "X"): (2, "Module has transitive dependency on forbidden module X"), ("X.ex", "Y"): (2, "X -> A -> B -> D -> Y"),
    }


def test_paths_of_many_starts_come_together():
    class Sent:
        value = graph._numbered(type("Edges", (), {"toArrow": lambda self: pa.table({"src": [f"m{i}" for i in range(900)], "dst": [f"m{i + 1}" for i in range(900)]})})())

    asked = pa.RecordBatch.from_pydict({"start": [*(f"m{i}" for i in range(0, 900, 3)), "other"], "targets": [["m900", "m1", "x"]] * 301})
    out = [b for b in graph._walk_paths(Sent, ["start", "target", "path"])([asked]) if b.num_rows]
    rows = [r for b in out for r in b.to_pylist()]
    assert len(out) < 10 and len(rows) == 301 and all(len(r["path"]) == int(r["target"][1:]) - int(r["start"][1:]) + 1 for r in rows)
    assert all(r["path"][0] == r["start"] and r["path"][-1] == r["target"] for r in rows)


def test_freed_native_memory_goes_back(spark):
    session = pytest.importorskip("rulequarry.session")
    assert session.give_back(spark).startswith("Trim native heap")
