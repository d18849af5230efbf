"""Sources are parsed once, by all cores, and joins of tree rows are never broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from rulequarry.operators.facts import Facts
from rulequarry.plans import catalogue
from rulequarry.plans.engine import run_checks
from rulequarry.sources import files as source
from rulequarry.sources.config import Rule

DATA = "/root/testdata/sf0.001"


def test_small_rows_of_one_file_are_dealt(spark):
    files = spark.range(400).coalesce(1).select(F.concat(F.lit("p"), "id").alias("path"), F.lit("defmodule M do\nend").alias("source"))
    parts = source.tree_rows(files).select(F.spark_partition_id().alias("p"), "path").distinct().groupBy("p").count().collect()
    assert len(parts) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in parts) == 400


@pytest.mark.parametrize("name", ["parsed_modules", "used_modules", "module_graph", "function_records", "plain_parameters", "documentation_ranges"])
def test_plans(spark, name):
    df = catalogue.queries()[name](spark, DATA)
    df.write.mode("overwrite").format("noop").save()
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "MapInArrow" not in plan  # the tree is a written table
    assert not re.search(r"BroadcastHashJoin \[path", plan.split("Initial Plan")[-1])


def test_a_tree_without_forms_above(spark):
    text = "defmodule A do\n  use B\n  @doc \"x\"\n  def f(x, {y, z}) when x > 1, do: y\n  defp g(a), do: a\nend"
    files = spark.createDataFrame([("a.ex", text)], "path string, source string")
    new = Facts(files)
    old = Facts(files, new.tree.drop("up_form", "up2_form"))
    for name in ("modules", "uses", "defs", "bare_args", "doc_ranges", "edges", "status"):
        want = sorted(map(str, getattr(old, name).collect()))
        assert want and sorted(map(str, getattr(new, name).collect())) == want, name


def test_issues_are_written_check_by_check(spark):
    files = spark.createDataFrame([("a.ex", "defmodule A do\n  def b(x), do: x\n  def a(x), do: x\nend")], "path string, source string")
    found = run_checks(files, [Rule("alphabetized_functions", paths=["*.ex"]), Rule("max_file_length", paths=["*.ex"], max_lines=1)])
    assert sorted(r.check for r in found.collect()) == ["alphabetized_functions"] * 2 + ["max_file_length"]
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Join" not in plan and "Exchange" not in plan


def test_text_checks_parse_nothing(spark, monkeypatch):
    """With rules by path only, and a check that reads lines."""
    files = spark.createDataFrame([("a.ex", "defmodule A do\n  use B\n  def b(x), do: x\nend"), ("b.ex", "x")], "path string, source string")
    rules = [Rule("max_file_length", paths=["*.ex"], max_lines=1), Rule("max_file_length", pattern="A", max_lines=2), Rule("max_file_length", uses_module="B", max_lines=3)]
    want = [sorted((r.rule_id, r.path) for r in run_checks(files, own).collect()) for own in (rules, rules[:1])]
    assert want == [[(0, "a.ex"), (1, "a.ex"), (2, "a.ex")], [(0, "a.ex")]]

    def own_lines(facts, matched, scratch, compat):
        found = matched.select("rule_id", "path").join(facts.lines, "path")
        return found.select(F.lit("own").alias("check"), "rule_id", F.lit("own").alias("category"), "path", "line_no", F.lit("n").alias("trigger"), F.col("text").alias("message"))

    def never(files):
        raise AssertionError("parsed")

    monkeypatch.setattr(source, "tree_rows", never)
    monkeypatch.setattr("rulequarry.plans.engine.tree_rows", never, raising=False)
    found = run_checks(files, [Rule("own", paths=["b.ex"])], checks={"own": own_lines}).collect()
    assert [(r.path, r.line_no, r.message) for r in found] == [("b.ex", 1, "x")]


def test_a_check_alone_keeps_the_rows_it_needs(spark, monkeypatch):
    kept = []
    real = Facts.written.__func__
    monkeypatch.setattr(Facts, "written", classmethod(lambda cls, *how: kept.append(real(cls, *how)) or kept[-1]))
    text = "defmodule A do\n  def f(x) do\n    with {:ok, a} <- g(x),\n         _b when a > 1 when a < 9 <- h(a) do\n      a\n    end\n  end\n  def z(x), do: [x, x, x]\nend"
    files = spark.createDataFrame([("a.ex", text)], "path string, source string")
    arrow, other = Rule("no_discarding_arrow_in_with", paths=["*.ex"]), Rule("alphabetized_functions", paths=["*.ex"])
    alone = [str(r) for r in run_checks(files, [arrow]).collect()]
    assert len(kept) == 1 and 0 < kept[0].tree.count() < source.tree_rows(files).count()
    assert len(alone) == 1 and alone == [str(r) for r in run_checks(files, [arrow, other]).collect() if r.check == "no_discarding_arrow_in_with"] and len(kept) == 1
