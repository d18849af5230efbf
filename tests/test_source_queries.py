import duckdb
import pytest

from rulequarry.operators.checks import _behind_guards
from rulequarry.plans import catalogue, engine, source_queries
from rulequarry.plans.engine import run_checks
from rulequarry.sources.config import Rule

DATA = "/root/testdata/sf0.001"
OWN = [n for n, f in catalogue.queries().items() if f.__module__ == source_queries.__name__]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", OWN)
def test_like_its_sql(spark, tables, name):
    got = catalogue.queries()[name](spark, DATA)
    found = tables.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(map(str, (tuple(r) for r in got.select(*columns).collect())))
    assert rows and rows == sorted(map(str, found.fetchall()))


def test_many_rules_are_joined(spark, monkeypatch):
    want = sorted(source_queries.rule_selection(spark, DATA).collect())
    monkeypatch.setattr(engine, "LITERAL_RULES", 1)
    assert sorted(source_queries.rule_selection(spark, DATA).collect()) == want


def test_guards_of_any_depth(spark):
    deep = "_x"
    for _ in range(30):
        deep = f"({deep} when a)"
    source = f"defmodule M do\n  def f(x) do\n    with {deep} <- g(x),\n         ({{:ok, _}} when b) <- x do\n      x\n    end\n  end\nend"
    got = run_checks(spark.createDataFrame([("lib/m.ex", source)], "path string, source string"), [Rule("no_discarding_arrow_in_with", paths=["lib/*.ex"])]).collect()
    assert [(r.line_no, r.trigger) for r in got] == [(3, "_x")]
    assert _behind_guards
