"""Goldens: small sources with the issues that each check must give. Inputs are written anew after the cases of the fixture ledger."""

import pytest

from rulequarry.operators.checks import REGISTERED, REGISTRY, Compat
from rulequarry.plans.engine import run_checks
from rulequarry.sources.config import Rule


def body(n):
    return "defmodule M do\n" + "\n".join(f"  def f{i}, do: {i}" for i in range(n)) + "\nend\n"


HEREDOC = '"""'
CASES = [
    # check, rule options, source, expected (line, trigger)
    ("no_direct_dependency", {"forbidden_modules": ["A.Repo", "X"]}, "defmodule M do\n  alias A.Repo\n  def f, do: A.Repo.all()\n  def g, do: A.Repo.Q.x()\nend", [(3, "A.Repo")]),
    ("no_direct_dependency", {"forbidden_modules": ["M", "B"]}, "defmodule M do\n  alias A.{B, C}\nend", [(1, "M"), (2, "B")]),
    ("must_use_module", {"required_modules": ["A.B", "C"]}, "defmodule M do\n  use A.B, opt: 1\n  use X.{C, D}\nend", [(1, "C")]),
    ("must_use_module", {"required_modules": ["A"]}, "defmodule M do def (", []),
    ("module_pattern_restrictions", {"allowed_functions": ["new"]}, "defmodule M do\n  def new(x), do: x\n  def bad(1), do: 1\n  def bad(2), do: 2\n  defp worse(x) when x > 1, do: x\n  def bare\nend", [(4, "bad"), (5, "worse"), (6, "bare")]),
    ("single_control_flow", {}, "defmodule M do\n  def f(x) do\n    x |> a() |> b()\n  end\n  def g(x) do\n    if x do\n      case x do\n        1 -> 2\n      end\n    end\n  end\n  def h(x) do\n    a(x |> b)\n    x |> c()\n  rescue\n    e -> e\n  end\nend", [(5, "g"), (12, "h")]),
    ("single_control_flow", {}, "defmodule M do\n  def f(x) when x > 1 do\n    for y <- x, do: y\n    with {:ok, z} <- x, do: z\n  end\n  def g do\n    if a, do: 1\n    if b, do: 2\n  end\nend", [(2, "f")]),
    ("no_tuple_match_in_head", {}, "defmodule M do\n\n  def f({:ok, x}), do: x\n  defp g(a, {:error , e}) when e, do: a\n  def h([{:ok, x}]), do: x\n  def i(%{a: {:ok, x}}), do: x\n  def j(x), do: {:ok, x}\nend", [(3, "f"), (4, "g")]),
    ("case_on_bare_arg", {}, "defmodule M do\n  def f(x, %{y: y}, z \\\\ 1) do\n    case x do\n      1 -> case y do\n        2 -> 3\n      end\n    end\n    case z do\n      _ -> x |> case do\n        1 -> 1\n      end\n    end\n  end\n  defp g(a) when is_list(a) do\n    case a do\n      [] -> 1\n    end\n  end\nend", [(3, "case"), (15, "case")]),
    ("alphabetized_functions", {}, "defmodule M do\n  def b(x), do: x\n  def a(x), do: x\n  defp d(x), do: x\n  defp c(x), do: x\nend", [(2, "b/1"), (3, "a/1"), (4, "d/1"), (5, "c/1")]),
    ("alphabetized_functions", {}, "defmodule M do\n  defp z(x), do: x\n  def b(x), do: x\n  def b(x, y), do: x\nend", [(2, "z/1")]),
    ("alphabetized_functions", {"mode": "all"}, "defmodule M do\n  def a(x), do: x\n  defp B(x), do: x\nend", []),
    ("alphabetized_functions", {"mode": "all"}, "defmodule M do\n  def apple(x), do: x\n  defp banana(x), do: x\n  defmacro aVocado(x) when x, do: x\nend", [(3, "banana/1"), (4, "aVocado/1")]),
    ("alphabetized_functions", {"mode": "public_only"}, "defmodule M do\n  def a(x), do: x\n  defp z(x), do: x\n  def b(x), do: x\n  defp y(x), do: x\nend", []),
    ("max_file_length", {}, body(398), []),
    ("max_file_length", {}, body(399), [(1, "lib/m.ex")]),
    ("max_file_length", {"max_lines": 5}, f"defmodule M do\n  @moduledoc {HEREDOC}\n  one\n  two\n  {HEREDOC}\n\n  # note\n  @doc false\n  def a(x), do: x\n  @doc \"short\"\n  def b(x), do: x\n  def c(x), do: x\n  def d(x), do: x\nend\n", [(1, "lib/m.ex")]),
    ("max_file_length", {"max_lines": 6}, f"defmodule M do\n  @moduledoc {HEREDOC}\n  one\n  two\n  {HEREDOC}\n\n  # note\n  @doc false\n  def a(x), do: x\n  @doc \"short\"\n  def b(x), do: x\n  def c(x), do: x\n  def d(x), do: x\nend\n", []),
    ("no_comparison_in_if", {}, "defmodule M do\n  def f(x) do\n    if x > 1 do\n      :a\n    else\n      :b\n    end\n    if ok?(x), do: x == 1\n    unless x == 2, do: 1\n    if not (a and b(x != 1)), do: 1\n  end\nend", [(3, "if"), (10, "if")]),
    ("no_discarding_arrow_in_with", {}, "defmodule M do\n  def f(x) do\n    with {:ok, a} <- g(x),\n         _ <- log(a),\n         _y when a > 1 <- h(a),\n         b = c(a) do\n      with _z <- b, do: a\n    end\n  end\nend", [(4, "_"), (5, "_y"), (7, "_z")]),
    ("struct_getter_convention", {}, "defmodule M do\n  defstruct [:id, name: nil]\n  def get_id(%__MODULE__{id: id}), do: id\n  def name(%__MODULE__{name: n}), do: n\n  defp x(%__MODULE__{id: i, name: n}) do\n    n\n  end\n  def y(%__MODULE__{id: i}), do: f(i)\n  def z(%Other{id: i}), do: i\nend", [(3, "get_id"), (5, "x")]),
    ("struct_getter_convention", {}, "defmodule M do\n  def get_id(%__MODULE__{id: id}), do: id\nend", []),
]


@pytest.fixture(scope="module")
def found(spark):
    """All cases in one run: a file and a rule for each."""
    files = spark.createDataFrame([(f"lib/m.ex#{i}", source) for i, (_, _, source, _) in enumerate(CASES)], "path string, source string")
    rules = [Rule(check, paths=[f"lib/m.ex#{i}"], **how) for i, (check, how, _, _) in enumerate(CASES)]
    out = {}
    for r in run_checks(files, rules).collect():
        out.setdefault(int(r.path.split("#")[1]), []).append(r)
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    check, _, _, expected = CASES[i]
    got = found.get(i, [])
    assert sorted((r.line_no, r.trigger.split("#")[0]) for r in got) == sorted(expected)
    assert all(r.check == check and r.message for r in got)
    assert all((r.rule_id is None) == (check in ("case_on_bare_arg", "no_discarding_arrow_in_with", "struct_getter_convention")) for r in got)


def test_transitive(spark):
    source = {"a": "defmodule A do\n  def f, do: B.x()\n  def g, do: C.x()\nend", "b": "defmodule B do\n  alias D\nend", "c": "defmodule C do\n  alias B\n  alias A\nend", "d": "defmodule D do\n  alias E\nend"}
    files = spark.createDataFrame([(f"lib/{k}.ex", v) for k, v in source.items()], "path string, source string")
    rules = [Rule("no_transitive_dependency", paths=["lib/a.ex"], forbidden_modules=["E", "B", "Z", "A"])]
    got = {r.trigger: (r.line_no, r.message) for r in run_checks(files, rules).collect()}
    assert got == {
        "E": (2, "Module has transitive dependency on forbidden module E (dependency chain: A -> B -> D -> E)"),
        "B": (2, "Module has transitive dependency on forbidden module B"),
    }


def test_selection_and_compat(spark):
    source = "defmodule My.App do\n  use Tool\n\n  def f({:ok, x}) when x, do: x\nend"
    files = spark.createDataFrame([("apps/a/lib/x.ex", source), ("lib/y.ex", "defmodule Other do\nend"), ("lib/bad.ex", None)], "path string, source string")
    rules = [
        Rule("must_use_module", paths=["apps/**/*.ex"], required_modules=["Q"], recursive=True),
        Rule("must_use_module", paths=["apps/**/*.ex"], required_modules=["Q"]),
        Rule("must_use_module", pattern="My.*", required_modules=["P"]),
        Rule("must_use_module", uses_module="Tool", required_modules=["T"]),
        Rule("module_pattern_restrictions", paths=["**/x.ex"], recursive=True),
        Rule("no_tuple_match_in_head", paths=["**/x.ex"], recursive=True),
        Rule("nothing_known", paths=["**"]),
    ]
    got = sorted((r.rule_id, r.path, r.trigger, r.line_no) for r in run_checks(files, rules).collect())
    x = "apps/a/lib/x.ex"
    assert got == [(0, x, "Q", 1), (2, x, "P", 1), (3, x, "T", 1), (4, x, "f", 4), (5, x, "f", 4)]
    old = sorted((r.rule_id, r.path, r.trigger, r.line_no) for r in run_checks(files, rules, compat=Compat(selectors=True, guards=True, blank_head=True)).collect())
    assert old == [(0, x, "Q", 1), (4, x, "when", 4), (5, x, "f", 3)]
    assert len(REGISTRY) == 12 and len(REGISTERED) == 7
