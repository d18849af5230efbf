"""Main text of web pages by a tree-structured graphical model.

The variables are the block elements of a page's DOM, each content or boilerplate. A node has a potential from its features (words of its tag, class and id, link share,
length, punctuation, place), and each parent and child share a potential by the kind of child. Sum-product messages pass upward and then downward and
give the exact content marginal of every node. Both kinds of weights are trained from labelled pages by gradient steps on the likelihood.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm.dom import BLOCK, HEADINGS, RAW, Node, parse
from rulequarry.llm.labelled_pages import labelled_pages

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_STOP = re.compile(r"[.!?…]")
SIZE = 1 << 12


class Block:
    """A variable of the model: a block element, or a run of text beside block elements."""

    __slots__ = ("chars", "children", "features", "kind", "links", "node", "parent", "runs", "stops", "total")

    def __init__(self, node: Node | None, parent: int):
        self.node, self.parent, self.children, self.runs = node, parent, [], []
        self.chars = self.links = self.stops = self.total = 0
        self.features, self.kind = [], 0


def blocks_of(root: Node) -> tuple[list[Block], list[tuple[int, str]]]:
    """The variables in page order, parents first, and the text blocks ``(variable, text)`` in page order."""
    blocks, texts = [Block(root, -1)], []
    run: list[str] = []
    owner, link = 0, 0

    def flush():
        nonlocal run, link
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            b = blocks[owner]
            b.runs.append(len(texts))
            texts.append((owner, text))
            b.chars += len(text)
            b.links += min(link, len(text))
            b.stops += len(_STOP.findall(text))
        run, link = [], 0

    todo: list = [(root, 0, False, iter(root.children))]
    while todo:
        node, at, linked, rest = todo[-1]
        child = next(rest, None)
        if child is None:
            todo.pop()
            if node.tag in BLOCK:
                flush()
            owner = todo[-1][1] if todo else 0
        elif isinstance(child, str):
            run.append(child)
            link += len(child.strip()) if linked else 0
        elif child.tag == "br":
            run.append(" ")
        elif child.tag in RAW or child.tag in ("head", "svg"):
            continue
        elif child.tag in BLOCK:
            flush()
            blocks.append(Block(child, at))
            owner = len(blocks) - 1
            blocks[at].children.append(owner)
            todo.append((child, owner, False, iter(child.children)))
        else:
            todo.append((child, at, linked or child.tag in ("a", "button", "label"), iter(child.children)))
    flush()
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        b.total += b.chars
        if b.parent >= 0:
            blocks[b.parent].total += b.total
    return blocks, texts


def _place(text: str) -> int:
    value = 2166136261
    for c in text.encode():
        value = (value ^ c) * 16777619 & 0xFFFFFFFF
    return value % SIZE


_places: dict[str, int] = {}


def _feature(text: str) -> int:
    if text not in _places:
        if len(_places) > 100_000:
            _places.clear()
        _places[text] = _place(text)
    return _places[text]


def describe(blocks: list[Block]) -> None:
    """Sets the features and the kind of edge of every variable."""
    whole = max(1, blocks[0].total)
    for b in blocks:
        tag = b.node.tag
        found = [f"tag {tag}", "bias"]
        if b.node.attrs:
            own = b.node.attributes()
            named = " ".join(own.get(k, "") for k in ("class", "id", "role", "itemprop")).lower()
            found += [f"name {w}" for w in dict.fromkeys(_NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", named)))]
            if "hidden" in own or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")) or own.get("aria-hidden") == "true":
                found.append("hidden")
        if b.chars:
            share = b.links / b.chars
            found.append(f"links {min(3, int(share * 4))}")
            found.append(f"chars {min(6, int(math.log2(b.chars + 1)) - 1)}")
            found.append(f"stops {min(3, b.stops)}")
            found.append(f"{tag} links {share > 0.5}")
        else:
            found.append("no text of its own")
        found.append(f"share {min(4, int(b.total / whole * 5))}")
        b.features = [_feature(x) for x in found]
        b.kind = 0 if b.parent < 0 else 1 + (tag in HEADINGS) + 2 * (tag in ("p", "li", "pre", "blockquote", "td", "dd", "dt", "figcaption"))


KINDS = 5


class Model:
    """Weights: of the features towards content, and of each kind of edge for each pair of labels (parent, child)."""

    def __init__(self):
        self.unary = [0.0] * SIZE
        self.edge = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(KINDS)]

    def marginals(self, blocks: list[Block], want_edges: bool = False):
        """The content probability of each variable; with edges, that of each pair of labels as well."""
        n = len(blocks)
        score = [sum([self.unary[f] for f in b.features]) for b in blocks]
        # messages are odds: up[i] is what i's subtree says to its parent, as log (content / boilerplate)
        inside, up = score[:], [0.0] * n
        for i in range(n - 1, 0, -1):
            e, s = self.edge[blocks[i].kind], inside[i]
            up[i] = _sum(e[1][0], e[1][1] + s) - _sum(e[0][0], e[0][1] + s)
            inside[blocks[i].parent] += up[i]
        belief, pairs = inside[:], [None] * n
        for i in range(1, n):
            p, e = blocks[i].parent, self.edge[blocks[i].kind]
            cavity = belief[p] - up[i]
            down = _sum(e[0][1], e[1][1] + cavity) - _sum(e[0][0], e[1][0] + cavity)
            belief[i] = inside[i] + down
            if want_edges:
                raw = [e[0][0], e[0][1] + inside[i], e[1][0] + cavity, e[1][1] + cavity + inside[i]]
                top = max(raw)
                raw = [math.exp(x - top) for x in raw]
                pairs[i] = [x / sum(raw) for x in raw]
        probability = [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in belief]
        return (probability, pairs) if want_edges else probability


def _sum(a: float, b: float) -> float:
    """log (exp a + exp b)"""
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def train(pages: list[tuple[str, list[str]]], rounds: int = 8, rate: float = 1.0, decay: float = 1e-4, seed: int = 0) -> Model:
    """``pages``: html and the texts of its content blocks. A variable is content if most of the text below it is."""
    model, examples = Model(), []
    for source, wanted in pages:
        blocks, texts = blocks_of(parse(source))
        describe(blocks)
        wanted, good = set(wanted), [0] * len(blocks)
        for owner, text in texts:
            if text in wanted:
                good[owner] += len(text)
        for i in range(len(blocks) - 1, 0, -1):
            good[blocks[i].parent] += good[i]
        examples.append((blocks, [int(g * 2 > b.total) for g, b in zip(good, blocks, strict=True)]))
    order, square = np.random.default_rng(seed), [1e-8] * SIZE
    for _ in range(rounds):
        for k in order.permutation(len(examples)):
            blocks, label = examples[k]
            belief, pairs = model.marginals(blocks, True)
            for i, b in enumerate(blocks):
                g = label[i] - belief[i]
                for f in b.features:
                    square[f] += g * g
                    model.unary[f] += rate * g / (1 + math.sqrt(square[f])) - rate * decay * model.unary[f]
                if i:
                    e, own = model.edge[b.kind], 2 * label[b.parent] + label[i]
                    for j, p in enumerate(pairs[i]):
                        e[j >> 1][j & 1] += 0.1 * rate * ((j == own) - p)
    return model


_trained: dict = {}


def default_model() -> Model:
    """Trained once for a process on the labelled pages of this package."""
    if "default" not in _trained:
        _trained["default"] = train(labelled_pages())
    return _trained["default"]


def extract(source: str, model: Model) -> str:
    """The text blocks of content variables, joined in page order by a line break."""
    blocks, texts = blocks_of(parse(source))
    if not texts:
        return ""
    describe(blocks)
    belief = model.marginals(blocks)
    return "\n".join(text for owner, text in texts if belief[owner] >= 0.5)


def _extracts(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            texts = [extract(x, model) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars`` (code points).

    The whole html is read; null html is empty, and a page without main text has an empty text. page_id and url may be null or repeat. Any
    bytes give a tree, however broken or deep. An empty table gives an empty result; other columns are ignored. No shuffle.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model or default_model())  # weights of a fixed size
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extracts(shared), "page_id long, url string, text string, n_chars long")
