import random

import pytest

from rulequarry.operators import graph
from rulequarry.plans import catalogue
from rulequarry.plans.engine import run_checks
from rulequarry.session import Scratch
from rulequarry.sources.config import Rule


def reach(edges, start):
    seen, todo = {start}, [start]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def first(edges, path, target):
    """By trying all simple paths in order."""
    if path[-1] == target:
        return path
    for b in sorted(edges.get(path[-1], ())):
        if b not in path and (found := first(edges, [*path, b], target)):
            return found
    return None


def chain(path):
    return f" (dependency chain: {' -> '.join(map(str, path))})" if len(path) > 2 else ""


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(1, 31)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i,) for i in range(12)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


def test_all_rows_take_part(spark, tables):
    edges = {k: {(3 * k + 1) % 30, 7 * k % 30} for k in range(1, 31)}
    starts = [k for k in edges if k % 7 == 1]
    got = {tuple(r) for r in catalogue.queries()["transitive_closure_all_parts"](spark, tables).collect()}
    assert got == {(s, x) for s in starts for x in reach(edges, s)}
    got = {tuple(r) for r in catalogue.queries()["dependency_path_all_parts"](spark, tables).collect()}
    ends = [(s, t) for s in starts for t in edges if t % 10 == 2 and t != s and t in reach(edges, s)]
    assert got == {(s, t, chain(first(edges, [s], t))) for s, t in ends} and got
    edges = {k: {(2 * k + 1) % 12, (k * k + 3) % 12} for k in range(12)}
    got = {tuple(r) for r in catalogue.queries()["dependency_path_all_nations"](spark, tables).collect()}
    assert got == {(s, t, chain(first(edges, [s], t))) for s in edges for t in reach(edges, s) - {s}}


def test_first_paths(spark):
    rng, rows = random.Random(1), []
    for g in range(12):
        rows += [(f"{g}.{rng.randrange(8)}", f"{g}.{rng.randrange(8)}") for _ in range(16)]
    edges = {}
    for a, b in rows:
        edges.setdefault(a, set()).add(b)
    pairs = [(f"{g}.{i}", f"{g}.{j}") for g in range(12) for i in range(8) for j in range(8)]
    df = spark.createDataFrame(rows, "src string, dst string")
    got = {(r.start, r.target): r.path for r in graph.first_paths(df, spark.createDataFrame(pairs, "start string, target string"), Scratch(spark, "test")).collect()}
    assert got == {(s, t): p for s, t in pairs if (p := first(edges, [s], t))}


def test_long_path_among_many(spark):
    """Twenty rungs give 2 ** 20 simple paths."""
    rows = [(i, j) for i in range(0, 60, 3) for j in (i + 1, i + 2)] + [(i + k, i + 3) for i in range(0, 60, 3) for k in (1, 2)]
    pairs = spark.createDataFrame([(0, 60)], "start long, target long")
    got = graph.first_paths(spark.createDataFrame(rows, "src long, dst long"), pairs, Scratch(spark, "test")).collect()
    assert [r.path for r in got] == [sorted({x for i in range(0, 60, 3) for x in (i, i + 1)} | {60})]


@pytest.mark.parametrize("kind, name", [("string", "ü{}".format), ("int", int)])
def test_both_ways_of_paths(spark, monkeypatch, kind, name):
    rng = random.Random(3)
    rows = [(name(rng.randrange(12)), name(rng.randrange(12))) for _ in range(26)]
    edges, after = spark.createDataFrame([*rows, (None, name(1)), (name(1), None)], f"src {kind}, dst {kind}"), {}
    for a, b in rows:
        after.setdefault(a, set()).add(b)
    pairs = [(name(i), name(j)) for i in range(14) for j in range(14)]
    want = {(s, t): p for s, t in pairs if (p := first(after, [s], t))}
    for most in (graph.PATH_EDGES, 0):
        monkeypatch.setattr(graph, "PATH_EDGES", most, raising=False)
        got = graph.first_paths(edges, spark.createDataFrame(pairs, f"start {kind}, target {kind}"), Scratch(spark, "test")).collect()
        assert {(r.start, r.target): r.path for r in got} == want and len(got) == len(want)


def test_paths_take_one_pass(spark, monkeypatch):
    """Over more edges than a closure sends to its tasks, paths were found by a round for each step."""
    monkeypatch.setattr(graph, "EDGES", 0)
    monkeypatch.setattr(graph, "transitive_closure", None)
    edges, pairs = spark.range(3000).selectExpr("id AS src", "id + 1 AS dst"), spark.createDataFrame([(0, 3000), (5, 7)], "start long, target long")
    assert sorted(r.path for r in graph.first_paths(edges, pairs, Scratch(spark, "test")).collect()) == [list(range(3001)), [5, 6, 7]]


@pytest.mark.parametrize("kind, name", [("string", "m{:03}".format), ("int", int)])
def test_both_ways_of_the_closure(spark, monkeypatch, kind, name):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in rows] + [(None, name(1)), (name(1), None)], f"src {kind}, dst {kind}")
    starts = spark.createDataFrame([(name(a),) for a in (0, 3, 3, 77)] + [(None,)], f"start {kind}")
    after = {}
    for a, b in rows:
        after.setdefault(name(a), set()).add(name(b))
    want = sorted((name(s), x) for s in (0, 3, 77) for x in reach(after, name(s)))
    for most in (graph.EDGES, 0):
        monkeypatch.setattr(graph, "EDGES", most)
        assert sorted(tuple(r) for r in graph.transitive_closure(edges, starts, Scratch(spark, "test")).collect()) == want
    empty = spark.createDataFrame([], edges.schema)
    assert not graph.transitive_closure(edges, spark.createDataFrame([], starts.schema), Scratch(spark, "test")).count()
    assert sorted(r.node for r in graph.transitive_closure(empty, starts, Scratch(spark, "test")).collect()) == sorted(map(name, (0, 3, 77)))


def test_chain_of_modules(spark):
    n = 200
    files = [(f"lib/m{i:03}.ex", f"defmodule M{i:03} do\n  alias M{i + 1:03}\n  def f(x), do: M{i + 1:03}.f(x)\nend") for i in range(n)]
    rule = Rule("no_transitive_dependency", paths=["lib/m000.ex"], forbidden_modules=[f"M{n - 1:03}"])
    issues = run_checks(spark.createDataFrame(files, "path string, source string"), [rule]).collect()
    assert len(issues) == 1 and " -> ".join(f"M{i:03}" for i in range(n)) in issues[0].message
