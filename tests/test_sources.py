import pytest

from rulequarry.functions.patterns import module_glob, path_glob
from rulequarry.operators.facts import Facts
from rulequarry.operators.graph import first_paths, transitive_closure
from rulequarry.session import Scratch
from rulequarry.sources.config import ConfigError, candidate_paths, discover, load_rules, parse_rules
from rulequarry.sources.elixir import SyntaxProblem, parse, rows
from rulequarry.sources.files import lines, read_sources


def shape(node):
    if node.kind == "var":
        return node.form
    if node.kind == "literal":
        return repr(node.lit)
    if node.form == "__aliases__":
        return node.lit
    name = node.form or {"list": "[]", "pair": "()"}[node.kind]
    if node.callee is not None:
        name = f"<{shape(node.callee)}>"
    return f"{name}({', '.join(map(shape, node.args))})"


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("a + b * c", "+(a, *(b, c))"),
        ("a |> f() |> g(1)", "|>(|>(a, f()), g('1'))"),
        ("f a, b: 1", "f(a, [](()('b', '1')))"),
        ("if foo bar do 1 end", "if(foo(bar), [](()('do', '1')))"),
        ("x = case y do\n  1 -> 2\n  _ -> 3\nend", "=(x, case(y, [](()('do', [](->([]('1'), '2'), ->([](_), '3'))))))"),
        ("A.b(1).c", "<.(<.(A, 'b')>('1'), 'c')>()"),
        ("alias A.{B, C}", "alias(<.(A, '{}')>(B, C))"),
        ("fn a, b -> a end", "fn(->([](a, b), a))"),
        ("%S{a: 1}", "%(S, %{}(()('a', '1')))"),
        ("%{m | a: 1}", "%{}(|(m, [](()('a', '1'))))"),
        ("a not in b", "not(in(a, b))"),
        ("f -1", "f(-('1'))"),
        ("f - 1", "-(f, '1')"),
        ("&(&1 + 1)", "&(+(&('1'), '1'))"),
        ("@doc false", "@(doc('false'))"),
        ("{1, 2}", "()('1', '2')"),
        ('"a#{b}c"', "<<>>('a', ::(b, binary), 'c')"),
        ("~r/a(b)/i", "sigil_r(<<>>('a(b)'), []())"),
        ("x\n|> f()", "|>(x, f())"),
        ("a != b", "!=(a, b)"),
        ("f!(x)", "f!(x)"),
        ("with {:ok, a} <- b, do: a", "with(<-(()('ok', a), b), [](()('do', a)))"),
    ],
)
def test_tree(source, expected):
    assert shape(parse(source)) == expected


def test_tree_rows_and_problems():
    out = rows(parse("f(a, g(b))"))
    assert [(r[0], r[1], r[2], r[3], r[6]) for r in out] == [(0, 3, -1, 0, "f"), (1, 1, 0, 0, "a"), (2, 3, 0, 1, "g"), (3, 3, 2, 0, "b")]
    for bad in ("def (", "a b c )", '"open', "do", "%{a: ", "f(1, 2"):
        with pytest.raises(SyntaxProblem):
            parse(bad)
    assert rows(parse(""))[0][6] == "__block__"


def test_globs():
    import re

    hit = lambda p, s: bool(re.search(p, s))
    assert hit(path_glob("lib/*.ex"), "lib/a.ex") and not hit(path_glob("lib/*.ex"), "lib/b/a.ex") and not hit(path_glob("lib/*.ex"), "lib/axex")
    assert hit(path_glob("a/**/*.ex"), "a/b/c.ex") and not hit(path_glob("a/**/*.ex"), "a/c.ex") and not hit(path_glob("a/**/*.ex"), "a/b/b/c.ex")
    for s in ("a/c.ex", "a/b/c.ex", "a/b/b/c.ex"):
        assert hit(path_glob("a/**/*.ex", True), s)
    assert hit(path_glob("lib/**", True), "lib") and hit(path_glob("lib/**", True), "lib/x/y") and hit(path_glob("**.ex", True), "a/b.ex")
    assert hit(module_glob("My.*"), "My.A.B") and not hit(module_glob("My.*"), "MyxA")


def test_config(tmp_path):
    text = "rules:\n  - type: must_use_module\n    paths: [lib/*.ex]\n    required_modules: [A]\n    recursive: true\n    mode: all\n    max_lines: '12'\n    other: 1\n  - type: no_direct_dependency\n"
    a, b = parse_rules(text)
    assert (a.type, a.paths, a.required_modules, a.recursive, a.mode, a.max_lines) == ("must_use_module", ["lib/*.ex"], ["A"], True, "all", 12)
    assert (b.recursive, b.paths, b.pattern) == (False, [], None)
    assert parse_rules(text, compat=True)[0].max_lines is None
    assert parse_rules("") == []
    for bad in ("- a", "rules: [1]", "a: [", "rules: [{mode: odd}]", "rules: [{max_lines: 0}]"):
        with pytest.raises(ConfigError):
            parse_rules(bad)
    with pytest.raises(ConfigError):
        load_rules(str(tmp_path / "none.yml"))
    assert discover(str(tmp_path)) == []
    (tmp_path / ".rulequarry.yml").write_text(text)
    assert len(discover(str(tmp_path))) == 2
    (tmp_path / "apps").mkdir()
    assert len(candidate_paths(str(tmp_path))) == 2


def test_files_and_facts(spark, tmp_path):
    (tmp_path / "a.ex").write_text("defmodule A do\n  alias B.C\n  use D\nend\n")
    (tmp_path / "b.ex").write_text("x = (")
    files = read_sources(spark, str(tmp_path / "*.ex"))
    assert {r.path.rsplit("/", 1)[1] for r in files.collect()} == {"a.ex", "b.ex"}
    facts = Facts(files)
    assert [r.parse_status for r in facts.status.orderBy("path").collect()] == ["ok", "error"]
    assert sorted(r.dep for r in facts.deps.collect()) == ["A", "B.C", "D"]
    assert [r.used for r in facts.uses.collect()] == ["D"]
    assert {(r.src, r.dst) for r in facts.edges.collect()} == {("A", "A"), ("A", "B.C"), ("A", "D")}
    assert lines(files).where("path like '%a.ex'").count() == 5


def test_last_module_wins(spark):
    files = spark.createDataFrame([("a", "defmodule M do\n  alias X\nend", 1), ("b", "defmodule M do\n  alias Y\nend", 0)], "path string, source string, file_ord int")
    assert {r.dst for r in Facts(files).edges.collect()} == {"M", "X"}
    assert {r.dst for r in Facts(files.drop("file_ord")).edges.collect()} == {"M", "Y"}


def test_graph(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("B", "D"), ("C", "A"), ("A", "A"), ("A", "D"), ("X", None)], "src string, dst string")
    starts = spark.createDataFrame([("A",), ("D",), ("Q",), (None,)], "start string")
    got = {(r.start, r.node) for r in transitive_closure(edges, starts, Scratch(spark, "test")).collect()}
    assert got == {("A", x) for x in "ABCD"} | {("D", "D"), ("Q", "Q")}
    pairs = spark.createDataFrame([("A", "D"), ("A", "C"), ("C", "D")], "start string, target string")
    assert {(r.start, r.target): r.path for r in first_paths(edges, pairs, Scratch(spark, "test")).collect()} == {("A", "D"): ["A", "B", "D"], ("A", "C"): ["A", "B", "C"], ("C", "D"): ["C", "A", "B", "D"]}
