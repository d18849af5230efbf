import random
import time

from test_lines import split_units

from rulequarry.llm.dom import Node, parse
from rulequarry.llm.unit_dedup import drop_units
from rulequarry.session import Scratch


def shape(node: Node):
    return [node.tag, [shape(c) if isinstance(c, Node) else c for c in node.children]]


def test_tags_that_nothing_closes_take_no_quadratic_time():
    n = 60_000
    began = time.time()
    for page in ("<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<b>" * n + "</div>" * n, "<svg></svg>" + "<b>" * n, "<b>" * n + "<div>x" * 20, "<li>x" * n, "<p>x" * n):
        parse(page)
    assert time.time() - began < 30


def test_end_tags():
    assert shape(parse("<p>a<b>c</i>d</b>e</p></p>f")) == ["#root", [["p", ["a", ["b", ["c", "d"]], "e"]], "f"]]
    assert shape(parse("<b><div>x</b>y</div>z")) == ["#root", [["b", [["div", ["x", "y"]], "z"]]]]
    assert shape(parse("<ul><li>a<li><b>c<li>d</ul>e")) == ["#root", [["ul", [["li", ["a"]], ["li", [["b", ["c"]]]], ["li", ["d"]]]], "e"]]
    assert shape(parse("<div><p>a<h2>b<h3>c</div>")) == ["#root", [["div", [["p", ["a"]], ["h2", ["b"]], ["h3", ["c"]]]]]]
    assert shape(parse("<svg><g><div>a</div>")) == ["#root", [["svg", [["g", []]]], ["div", ["a"]]]]


def test_many_units_of_one_text(spark):
    rng = random.Random(1)
    lines = [rng.choice(["same", "other", f"own {i}", ""]) for i in range(40_000)]
    text, began = "\n".join(lines), time.time()
    out = drop_units(spark.createDataFrame([(1, text)], "doc_id long, text string"), Scratch(spark, "test")).first()
    seen = set()
    want = [x for x in lines if not x or not (x in seen or seen.add(x))]
    assert [x for x in out.text.split("\n") if x] == [x for x in want if x] and time.time() - began < 60
    assert len(split_units(text, "line")) == len(lines)
