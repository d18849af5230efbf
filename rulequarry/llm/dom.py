"""A tolerant HTML reader: a tree of elements with text, as browsers would roughly build it."""

from __future__ import annotations

import html
import re
from collections import Counter

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag; what they hold is never main text.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
#: Elements of other languages: tags in them may close themselves, and a block element outside of an integration point ends them.
FOREIGN = frozenset({"svg", "math"})
POINTS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "legend li main menu nav ol p pre section summary table caption tbody thead tfoot tr td th ul head hr select option button noscript".split()
)
#: A start tag closes these open elements, up to the fence.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
CLOSES |= {"thead": CLOSES["tbody"], "tfoot": CLOSES["tbody"]}
P_FENCE = frozenset("html body button table td th caption article section div main aside header footer nav li blockquote form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)(?P<end>>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in reversed(list(_ATTR.finditer(self.attrs)))}


def parse(source: str) -> Node:
    """The root of the tree; children are nodes and strings whose character references are decoded. Any input gives a tree.

    What is open is counted, so that an end tag without its start tag costs no climb: by name, and for inline elements by the block that they are in.
    """
    root = here = Node("#root")
    at, end = 0, len(source)
    opened: Counter = Counter()
    inline = [Counter()]
    deciding = [root]  # the elements, from the root down, that decide whether tags are HTML or of another language

    def put(node: Node) -> None:
        nonlocal here
        here = node
        opened[node.tag] += 1
        if node.tag in BLOCK:
            inline.append(Counter())
        else:
            inline[-1][node.tag] += 1
        if node.tag in BLOCK or node.tag in FOREIGN or node.tag in POINTS:
            deciding.append(node)

    def close(upto: Node) -> None:
        nonlocal here
        while here is not upto:
            opened[here.tag] -= 1
            if here.tag in BLOCK:
                inline.pop()
            else:
                inline[-1][here.tag] -= 1
            if deciding[-1] is here:
                deciding.pop()
            here = here.parent

    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            here.children.append(html.unescape(source[at:lt]))
            at = lt
            continue
        m = _TOKEN.match(source, at) or _LOOSE.match(source, at)
        if m is None:
            here.children.append("<")
            at += 1
            continue
        at = m.end()
        name = (m.groupdict().get("name") or "").lower()
        if not name or not m["end"]:  # a comment, a declaration, or a tag that the page ends in
            continue
        if m["close"]:
            if opened[name] if name in BLOCK else inline[-1][name]:  # an inline end tag doesn't close a block
                node = here
                while node.tag != name:
                    node = node.parent
                close(node.parent)
            continue
        while deciding[-1].tag in FOREIGN and name in BLOCK:  # it was never closed
            close(deciding[-1].parent)
        if name in RAW and not (deciding[-1].tag in FOREIGN and m["attrs"].rstrip().endswith("/")):
            shut = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            at = shut.end() if shut else end
            here.children.append(Node(name, m["attrs"], here))
            continue
        if name in CLOSES:
            tags, fence = CLOSES[name]
            node, upto = here, here
            if any(opened[t] for t in tags):
                while node is not root and node.tag not in fence:
                    if node.tag in tags:
                        upto = node.parent
                    node = node.parent
            close(upto)
        elif name in BLOCK and (opened["p"] or (name in HEADINGS and any(opened[h] for h in HEADINGS))):
            node = here
            while node is not root and node.tag not in P_FENCE:
                if node.tag == "p" or (node.tag in HEADINGS and name in HEADINGS):
                    close(node.parent)
                    break
                node = node.parent
        child = Node(name, m["attrs"], here)
        here.children.append(child)
        if name not in VOID and not (m["attrs"].rstrip().endswith("/") and name not in BLOCK):
            put(child)
    return root
