import pytest

from rulequarry.llm.dom import parse
from rulequarry.llm.html_extract import default_model, extract

FIRST = "<p>One two three four, and five six seven. Eight nine ten eleven twelve.</p>"
LAST = "<p>Another long line of the article, with words and stops. It goes on for a while.</p>"
WANTED = ["One two three four, and five six seven. Eight nine ten eleven twelve.", "Another long line of the article, with words and stops. It goes on for a while."]


@pytest.fixture(scope="module")
def model():
    return default_model()


def page(inner, before=""):
    return f"<html><head><title>t</title></head><body>{before}<article><h1>Head line here</h1>{FIRST}{inner}{LAST}</article><footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize("inner", [
    "<svg width='3'/>", "<math/>", "<svg><path d='M0'/><title/><script/></svg>", "<svg><g><path d='M0'>", "<object data='x'>", "<template>", "<svg><title>no text</title></svg>",
    "<object/>", "<svg><foreignObject><div>in a drawing</div></foreignObject></svg>", "<script>if (a < b) '<svg>'</script>",
])
def test_nothing_after_is_lost(model, inner):
    for html in (page(inner), page("", before=inner)):
        got = extract(html, model).split("\n")
        assert [x for x in got if x in WANTED] == WANTED
        assert "no text" not in got and "in a drawing" not in got


def test_text_in_math_and_object_is_judged(model):
    html = page("<p>The sum is <math><mi>x</mi><mo>+</mo><mn>1</mn></math> here, as shown before. So it is. <object>Text of an object.</object></p><template><p>A line in a template, with words. And more of them here.</p></template>")
    got = extract(html, model)
    assert "The sum is x+1 here, as shown before. So it is. Text of an object." in got and "A line in a template, with words." in got


def test_raw_text_stays_raw():
    assert [c.tag for c in parse("<svg><g><svg><g><p>x").children] == ["svg", "p"]
    root = parse("<p>a<script>'</p><svg>'</script>b<textarea><p>x</textarea>c")
    assert [c if isinstance(c, str) else c.tag for c in root.children[0].children] == ["a", "script", "b", "textarea", "c"]
