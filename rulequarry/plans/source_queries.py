"""Queries over source files made of whole tables, a module for each row: the files go through the reader, the facts, rule selection and the checks as any
others do. The SQL beside each query tells what must come out from the same rows, without reading a source."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulequarry.operators.facts import ARG_ROWS, DEF_ROWS, DOC_ROWS, MODULE_ROWS, USE_ROWS, Facts
from rulequarry.plans import engine
from rulequarry.plans.catalogue import _read, query
from rulequarry.session import Scratch, ship
from rulequarry.sources.config import Rule, discover, rules_table

#: The file of a row; <x> stands for a value of VALUES. Line numbers in the SQL below are those of this text.
MODULE = '''defmodule Shop.P<k> do
  @moduledoc """
  Number <k>
  """
  use Base<k3>
  alias Shop.P<up>
  defstruct [:id, name: nil]

  @doc "short"
  def <getter>(%__MODULE__{<field>: v}), do: v
  defp b<k3>(x, y) do
    with {:ok, a} <- f(x),
         <pattern> <- g(y) do
      a
    end
  end
  def a<k4>(x) do
    if <test> do
      <body>
    end
  end
  def c(x, %{y: y}) do
    case <subject> do
      _ -> x
    end
  end
  def z(<head>, x), do: x
end
'''
AGAIN = "defmodule Shop.P<k> do\n  alias Shop.P<third>\nend\n"
#: Each value as an expression that Spark and DuckDB both read; k is the row's key.
VALUES = {
    "k": "k", "k3": "k % 3", "k4": "k % 4", "up": "cast(floor(k / 2) AS BIGINT)", "third": "cast(floor(k / 3) AS BIGINT)",
    "field": "CASE k % 2 WHEN 0 THEN 'id' ELSE 'name' END",
    "getter": "CASE WHEN k % 3 = 0 THEN 'get_' ELSE '' END || CASE k % 2 WHEN 0 THEN 'id' ELSE 'name' END",
    "pattern": "CASE k % 6 WHEN 0 THEN '_' WHEN 1 THEN '_skip' WHEN 2 THEN '{:ok, _b}' WHEN 3 THEN '_c when a > 1' WHEN 4 THEN '(((((_d when a) when a) when a) when a) when a)' ELSE 'b' END",
    "test": "CASE k % 4 WHEN 0 THEN 'x > 1' WHEN 1 THEN 'ok?(x)' WHEN 2 THEN 'not (x == 1)' ELSE 'x' END",
    "body": "CASE k % 5 WHEN 0 THEN 'for i <- x, do: Shop.P' || cast(floor(k / 2) AS BIGINT) || '.run(i)' WHEN 1 THEN 'x |> Other.M' || k % 3 || '.run() |> f()' ELSE 'Other.M' || k % 3 || '.run(x)' END",
    "subject": "CASE k % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'f(x)' END",
    "head": "CASE k % 4 WHEN 0 THEN '{:ok, a}' WHEN 1 THEN '[{:ok, a}]' WHEN 2 THEN '{:error, e}' ELSE 'a' END",
}
_PATH = "'apps/shop' || k % 4 || '/lib/p' || k || '.ex'"


def _made(form: str):
    return F.concat(*(F.expr(f"cast({VALUES[x[1:-1]]} AS STRING)") if re.fullmatch(r"<\w+>", x) else F.lit(x) for x in re.split(r"(<\w+>)", form) if x))


def _keys(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    ship(spark)
    return _read(spark, sf_dir, table).where(f"{key} is not null").select(F.col(key).cast("long").alias("k"))


def _files(keys: DataFrame) -> DataFrame:
    return keys.select(F.expr(_PATH.replace("k % 4", "cast(k % 4 AS STRING)")).alias("path"), _made(MODULE).alias("source"))


def _part_files(spark, sf_dir):
    return _files(_keys(spark, sf_dir, "part", "p_partkey"))


_PARTS = f"p AS (SELECT *, {_PATH} AS path FROM (SELECT p_partkey::BIGINT AS k FROM part))"
_SUPPLIERS = f"p AS (SELECT *, {_PATH} AS path FROM (SELECT s_suppkey::BIGINT AS k FROM supplier))"


def _value(name: str) -> str:
    return f"({VALUES[name]})"


_UP, _THIRD, _GETTER, _FIELD = map(_value, ("up", "third", "getter", "field"))


@query(f"WITH {_PARTS} SELECT path, CASE WHEN k % 17 = 0 THEN 'error' ELSE 'ok' END AS parse_status, CASE WHEN k % 17 <> 0 THEN 'Shop.P' || k END AS module FROM p")
def parsed_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state and the module of each file; every 17th lacks its last end."""
    cut = F.when(F.regexp_extract("path", r"p(\d+)\.ex$", 1).cast("long") % 17 == 0, F.expr("substring(source, 1, length(source) - 4)")).otherwise(F.col("source"))
    facts = Facts.written(_part_files(spark, sf_dir).withColumn("source", cut), Scratch(spark, "modules"), MODULE_ROWS)
    return facts.status.join(facts.modules.select("path", "module"), "path", "left").select("path", "parse_status", "module")


_REFERENCES = f"""r AS (SELECT k, path, 'Shop.P' || k AS dep, 1 AS line FROM p UNION ALL SELECT k, path, 'Base' || k % 3, 5 FROM p UNION ALL SELECT k, path, 'Shop.P' || {_UP}, 6 FROM p
    UNION ALL SELECT k, path, CASE k % 5 WHEN 0 THEN 'Shop.P' || {_UP} ELSE 'Other.M' || k % 3 END, 19 FROM p)"""
_DEPS = f"{_REFERENCES}, d AS (SELECT k, path, dep, max(line)::BIGINT AS last_line FROM r GROUP BY ALL)"


@query(f"WITH {_PARTS}, {_DEPS} SELECT path, dep, last_line FROM d")
def direct_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules that a file names, with the line of the last reference."""
    return Facts(_part_files(spark, sf_dir)).deps.select("path", "dep", F.col("last_line").cast("long").alias("last_line"))


@query(f"WITH {_PARTS} SELECT path, 'Base' || k % 3 AS used FROM p")
def used_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3, X6"""
    return Facts.written(_part_files(spark, sf_dir), Scratch(spark, "uses"), USE_ROWS).uses


@query(f"""WITH {_PARTS}, {_DEPS} SELECT 'Shop.P' || k AS src, dep AS dst FROM d WHERE k % 10 <> 5
    UNION ALL SELECT 'Shop.P' || k, unnest(['Shop.P' || k, 'Shop.P' || {_THIRD}]) FROM p WHERE k % 10 = 5""")
def module_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between modules; every tenth has a second file, which wins."""
    keys = _keys(spark, sf_dir, "part", "p_partkey")
    again = keys.where("k % 10 = 5").select(F.concat(F.lit("apps/shop"), (F.col("k") % 4).cast("string"), F.lit("/lib/p"), F.col("k").cast("string"), F.lit("_again.ex")).alias("path"), _made(AGAIN).alias("source"))
    return Facts.written(_files(keys).union(again), Scratch(spark, "graph"), f"{MODULE_ROWS} or form = '__aliases__'").edges


_DEFS = f"""SELECT path, {_GETTER} AS name, 1 AS arity, 10 AS line, 'public' AS visibility FROM p UNION ALL SELECT path, 'b' || k % 3, 2, 11, 'private' FROM p UNION ALL SELECT path, 'a' || k % 4, 1, 17, 'public' FROM p
    UNION ALL SELECT path, 'c', 2, 22, 'public' FROM p UNION ALL SELECT path, 'z', 2, 27, 'public' FROM p"""


@query(f"WITH {_PARTS} SELECT path, name, arity::BIGINT AS arity, line::BIGINT AS line, visibility FROM ({_DEFS})")
def function_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of a file."""
    return Facts.written(_part_files(spark, sf_dir), Scratch(spark, "functions"), DEF_ROWS).clauses.select("path", "name", F.col("arity").cast("long").alias("arity"), F.col("line").cast("long").alias("line"), "visibility")


@query(f"WITH {_PARTS} SELECT path, unnest([2, 9])::BIGINT AS start_line, unnest([5, 9])::BIGINT AS end_line FROM p")
def documentation_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X24"""
    return Facts.written(_part_files(spark, sf_dir), Scratch(spark, "docs"), DOC_ROWS).doc_ranges.select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query(f"""WITH {_PARTS}, a AS (SELECT path, 11 AS line, unnest(['x', 'y']) AS arg FROM p UNION ALL SELECT path, 17, 'x' FROM p UNION ALL SELECT path, 22, 'x' FROM p UNION ALL SELECT path, 27, 'x' FROM p
    UNION ALL SELECT path, 27, 'a' FROM p WHERE k % 4 = 3) SELECT path, line::BIGINT AS line, arg FROM a""")
def plain_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that are plain names, by the line of their function."""
    facts = Facts.written(_part_files(spark, sf_dir), Scratch(spark, "parameters"), ARG_ROWS)
    lines = facts.clauses.select("path", F.col("pre").alias("def_pre"), F.col("line").cast("long").alias("line"))
    return facts.bare_args.join(lines, ["path", "def_pre"]).select("path", "line", "arg")


@query(f"""WITH {_PARTS}, h AS (SELECT path, 'def' AS kind, {_GETTER} AS name, '%__MODULE__{{' || {_FIELD} || ': v}}' AS args, 10 AS line FROM p UNION ALL SELECT path, 'defp', 'b' || k % 3, 'x, y', 11 FROM p
    UNION ALL SELECT path, 'def', 'a' || k % 4, 'x', 17 FROM p UNION ALL SELECT path, 'def', 'c', 'x, %{{y: y}}', 22 FROM p UNION ALL SELECT path, 'def', 'z', {_value("head")} || ', x', 27 FROM p)
    SELECT path, kind, name, args, line::BIGINT AS line FROM h""")
def heads_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function heads found by pattern, with the line of their offset."""
    return Facts(_part_files(spark, sf_dir)).text_heads.select("path", "kind", "name", "args", F.col("line").cast("long").alias("line"))


_SELECTING = [
    Rule("must_use_module", paths=["apps/*/lib/p1*.ex"]), Rule("must_use_module", paths=["**/shop3/**/*7.ex"], recursive=True), Rule("must_use_module", pattern="Shop.P1*"),
    Rule("must_use_module", uses_module="Base2"), Rule("must_use_module", paths=["lib/*.ex"]), Rule("must_use_module", paths=["apps/shop0/*/*.ex", "apps/shop1/lib/*.ex"], pattern="No.*", uses_module="No"),
]


@query(f"""WITH {_PARTS} SELECT path, 0 AS rule_id FROM p WHERE starts_with(k::VARCHAR, '1') UNION ALL SELECT path, 1 FROM p WHERE k % 4 = 3 AND k % 10 = 7 UNION ALL SELECT path, 2 FROM p WHERE starts_with(k::VARCHAR, '1')
    UNION ALL SELECT path, 3 FROM p WHERE k % 3 = 2 UNION ALL SELECT path, 5 FROM p WHERE k % 4 < 2""")
def rule_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that each rule holds for: by path, by module, by a used module, or none."""
    facts = Facts.written(_part_files(spark, sf_dir), Scratch(spark, "selection"), f"{MODULE_ROWS} or {USE_ROWS}")
    return engine.match_rules(rules_table(spark, _SELECTING), facts, len(_SELECTING)).select("path", "rule_id")


# the checks, as run_checks runs them; each rule's type names its check

_FOUND = {
    "no_direct_dependency": "SELECT path, last_line AS line_no, dep AS trigger, 'Module has forbidden direct dependency on ' || dep AS message FROM d WHERE dep IN ('Other.M1', 'Shop.P1')",
    "no_transitive_dependency": f"""SELECT p.path, d.last_line AS line_no, w.target AS trigger, 'Module has transitive dependency on forbidden module ' || w.target || CASE WHEN len > 2 THEN ' (dependency chain: ' || chain || ')' ELSE '' END AS message
        FROM p JOIN w ON w.k = p.k JOIN d ON d.path = p.path AND d.dep = 'Shop.P' || {_UP.replace('k', 'p.k')} WHERE w.here IN (1, 2) AND w.len > 1""",
    "must_use_module": "SELECT path, 1 AS line_no, 'Base0' AS trigger, 'Module must use Base0' AS message FROM p WHERE k % 3 = 1",
    "module_pattern_restrictions": f"""SELECT path, line AS line_no, name AS trigger, 'Module defines non-allowed function: ' || name AS message
        FROM ({_DEFS.replace('SELECT path', 'SELECT k, path')}) WHERE starts_with(k::VARCHAR, '1') AND name NOT IN ('c', 'z')""",
    "single_control_flow": """SELECT path, 17 AS line_no, 'a' || k % 4 AS trigger, 'Function clause `a' || k % 4 || '` contains 2 control-flow structures (maximum allowed: 1). Control-flow structures include: pipe chains (|>), cond, with, case, if, unless, for, and receive. Favor extracting pipe chains to helpers before extracting other structures.' AS message
        FROM p WHERE k % 5 < 2""",
    "no_tuple_match_in_head": "SELECT path, 27 AS line_no, 'z' AS trigger, 'Function `z` pattern matches on :ok/:error tuple in its public function head. Consider having the calling function use a case statement on the value instead.' AS message FROM p WHERE k % 4 IN (0, 2)",
    "case_on_bare_arg": "SELECT path, 23 AS line_no, 'case' AS trigger, 'Case statement operates on bare argument `x` in function `c`. Consider using function head pattern matching instead.' AS message FROM p WHERE k % 3 = 0",
    "alphabetized_functions": f"""SELECT path, 10 AS line_no, {_GETTER} || '/1' AS trigger, 'public function `' || {_GETTER} || '/1` is not in alphabetical order. It should appear after c/2.' AS message FROM p
        UNION ALL SELECT path, 17, 'a' || k % 4 || '/1', 'public function `a' || k % 4 || '/1` is not in alphabetical order. It should appear after the beginning.' FROM p
        UNION ALL SELECT path, 22, 'c/2', 'public function `c/2` is not in alphabetical order. It should appear after a' || k % 4 || '/1.' FROM p
        UNION ALL SELECT path, 11, 'b' || k % 3 || '/2', 'private function `b' || k % 3 || '/2` appears before public functions. In :separate mode, all public functions must come before private functions.' FROM p""",
    "max_file_length": "SELECT path, 1 AS line_no, path AS trigger, 'File contains 22 lines of code (maximum allowed: 20). Consider breaking this file into smaller, more focused modules.' AS message FROM p",
    "no_comparison_in_if": "SELECT path, 18 AS line_no, 'if' AS trigger, 'Avoid direct comparisons in `if` statements. Extract the comparison to a function in the appropriate module with a descriptive name.' AS message FROM p WHERE k % 4 IN (0, 2)",
    "no_discarding_arrow_in_with": """SELECT path, 13 AS line_no, name AS trigger, 'Unnecessary arrow (<-) in with clause. Pattern `' || name || '` only discards the value. Remove the arrow and pattern to simplify' AS message
        FROM (SELECT path, CASE k % 6 WHEN 0 THEN '_' WHEN 1 THEN '_skip' WHEN 3 THEN '_c' WHEN 4 THEN '_d' END AS name FROM p) WHERE name IS NOT NULL""",
    "struct_getter_convention": f"""SELECT path, 10 AS line_no, {_GETTER} AS trigger, 'Getter function `' || {_GETTER} || '` should be named `' || {_FIELD} || '` to match the field it extracts' AS message FROM p WHERE k % 3 = 0""",
}
_WALKS = "w AS (SELECT k, k AS here, 'Shop.P' || k AS target, 'Shop.P' || k AS chain, 1 AS len FROM p UNION ALL SELECT k, here // 2, 'Shop.P' || (here // 2), chain || ' -> Shop.P' || (here // 2), len + 1 FROM w WHERE here > 1)"
_OPTIONS = {
    "no_direct_dependency": {"forbidden_modules": ["Other.M1", "Shop.P1"]}, "no_transitive_dependency": {"forbidden_modules": ["Shop.P1", "Shop.P2"]},
    "must_use_module": {"paths": [], "uses_module": "Base1", "required_modules": ["Base0", "Base1"]}, "module_pattern_restrictions": {"paths": [], "pattern": "Shop.P1*", "allowed_functions": ["c", "z"]},
    "max_file_length": {"max_lines": 20},
}


def _rule(kind: str) -> Rule:
    return Rule(kind, **{"paths": ["apps/*/lib/*.ex"]} | _OPTIONS.get(kind, {}))


def _issues(files: DataFrame, *kinds: str) -> DataFrame:
    found = engine.run_checks(files, [_rule(k) for k in kinds])
    return found.select("check", "path", F.col("line_no").cast("long").alias("line_no"), "trigger", "message")


def _told(kind: str) -> str:
    return f"""SELECT '{kind}' AS "check", path, line_no::BIGINT AS line_no, trigger, message FROM ({_FOUND[kind]})"""


@query(f"WITH RECURSIVE {_SUPPLIERS}, {_DEPS}, {_WALKS} {_told('no_transitive_dependency')}")
def no_transitive_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden modules that a module leads to, with the chain."""
    return _issues(_files(_keys(spark, sf_dir, "supplier", "s_suppkey")), "no_transitive_dependency")


@query(f"WITH {_PARTS} {_told('no_discarding_arrow_in_with')}")
def discarding_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With clauses that discard a value, behind up to five guards."""
    return _issues(_part_files(spark, sf_dir), "no_discarding_arrow_in_with")


@query(f"WITH {_PARTS} {_told('struct_getter_convention')}")
def getter_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12, X29, X30"""
    return _issues(_part_files(spark, sf_dir), "struct_getter_convention")


@query(f"WITH {_PARTS} {_told('no_comparison_in_if')}")
def comparison_in_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10, X26"""
    return _issues(_part_files(spark, sf_dir), "no_comparison_in_if")


@query(f"WITH RECURSIVE {_SUPPLIERS}, {_DEPS}, {_WALKS} {' UNION ALL '.join(map(_told, _FOUND))}")
def all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of all twelve checks in one table."""
    return _issues(_files(_keys(spark, sf_dir, "supplier", "s_suppkey")), *_FOUND)


def _long_files(facts, matched, scratch, compat):
    """A check of a user: files of over 27 lines."""
    found = matched.select("rule_id", "path").join(facts.lines.where("text <> ''").groupBy("path").agg(F.count("*").alias("n")), "path").where("n > 26")
    return found.select(F.lit("long").alias("check"), "rule_id", F.lit("own").alias("category"), "path", F.lit(1).alias("line_no"), F.lit("n").alias("trigger"), F.col("n").cast("string").alias("message"))


@query(f"WITH {_PARTS} SELECT 'long' AS \"check\", path, 1::BIGINT AS line_no, '27' AS message FROM p WHERE k % 4 = 2")
def own_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check that a user brings."""
    found = engine.run_checks(_part_files(spark, sf_dir), [Rule("long", paths=["apps/shop2/**/*.ex"], recursive=True)], checks={"long": _long_files})
    return found.select("check", "path", F.col("line_no").cast("long").alias("line_no"), "message")


_YAML = """rules:
  - type: must_use_module
    paths: ["lib/**/*.ex", "web/*.ex"]
    required_modules: [A.B, C]
    recursive: true
  - {type: max_file_length, pattern: My.*, max_lines: 7, unknown: 1}
  - {type: alphabetized_functions, uses_module: Tool, mode: all}
"""


@query(r"""SELECT * FROM (VALUES (0, 'must_use_module', '^lib/(.*/)?[^/]*\.ex$', NULL, NULL, 'A.B,C', NULL::INTEGER, NULL), (0, 'must_use_module', '^web/[^/]*\.ex$', NULL, NULL, 'A.B,C', NULL, NULL),
    (1, 'max_file_length', NULL, '^My\..*$', NULL, '', 7, NULL), (2, 'alphabetized_functions', NULL, NULL, 'Tool', '', NULL, 'all'))
    AS r(rule_id, type, path_regex, module_regex, uses_module, required, max_lines, mode)""")
def rule_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the file that is found from an app of an umbrella; the driver reads it."""
    with tempfile.TemporaryDirectory() as top:
        here = Path(top, "apps", "one")
        (here / "apps").mkdir(parents=True)
        Path(top, ".rulequarry.yml").write_text(_YAML)
        table = rules_table(spark, discover(str(here)))
    return table.select("rule_id", "type", F.explode_outer("path_regexes").alias("path_regex"), "module_regex", "uses_module", F.array_join("required_modules", ",").alias("required"), "max_lines", "mode")
