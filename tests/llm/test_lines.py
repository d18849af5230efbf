import random
from collections import defaultdict

import pytest

from rulequarry.llm.components import Forest
from rulequarry.llm.fuzzy_lines import drop_lines, edit_distance, line_prints, normalise, removed_lines, similar
from rulequarry.llm.unit_dedup import drop_units, removal_spans, split_units
from rulequarry.session import Scratch


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 5, 80]))) for _ in range(2))
        assert edit_distance(a, b) == levenshtein(a, b)
    assert similar("aaaaa", "aaaab") and not similar("aaaa", "aaab") and similar("", "")


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)]
    lines = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 40, 80]))) for _ in range(30)]
    docs = []
    for i in range(70):
        own = []
        for _ in range(rng.choice([0, 1, 4, 8])):
            words = rng.choice(lines).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            line = " ".join(words)
            own.append(rng.choice([line, line.upper(), f"  {line}\t", "", " "]))
        docs.append((i, "\n".join(own)))
    return docs


@pytest.mark.parametrize(("seed", "most"), [(1, 4096), (2, 3)])
def test_fuzzy_lines(spark, seed, most):
    docs = corpus(seed)
    at = [(i, k, normalise(x)) for i, t in docs for k, x in enumerate(t.split("\n"))]
    distinct = sorted({n for *_, n in at if n})
    prints = dict(zip(distinct, line_prints(distinct).tolist(), strict=True))
    forest = Forest()
    for a in distinct:
        for b in distinct:
            if a < b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 3 and similar(a, b):
                forest.join(a, b)
    seen, gone = set(), defaultdict(list)
    for i, k, n in at:
        if n:
            if forest.find(n) in seen:
                gone[i].append(k)
            seen.add(forest.find(n))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, line string").repartition(4)
    got = {r.doc_id: r for r in removed_lines(df, Scratch(spark, "test"), most=most).collect()}
    assert {i: (r.n_lines, r.n_removed, r.removed_lines) for i, r in got.items()} == {i: (len(t.split("\n")), len(gone[i]), ",".join(map(str, gone[i]))) for i, t in docs}
    if most > 3:
        kept = {r.doc_id: r.text for r in drop_lines(df, Scratch(spark, "test")).collect()}
        assert kept == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs}


def test_units(spark):
    docs = [(3, "A b\nnew\n\na  B"), (1, "x\na b "), (2, None), (5, ""), (5, "x"), (None, "new"), (7, "é" * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_units, r.n_removed, r.chars_removed, r.removed_spans) for r in removal_spans(df, Scratch(spark, "test")).collect())
    assert got == [(1, 2, 0, 0, ""), (2, 1, 0, 0, ""), (3, 4, 2, 7, "0-3,9-13"), (5, 1, 0, 0, ""), (5, 1, 1, 1, "0-1"), (7, 1, 0, 0, ""), (99, 1, 1, 3, "0-3")]
    kept = {r.doc_id: r.text for r in drop_units(df.where("doc_id in (1, 2, 3)"), Scratch(spark, "test")).collect()}
    assert kept == {1: "x\na b ", 2: None, 3: "\nnew\n"}
    assert removal_spans(df.limit(0), Scratch(spark, "test")).count() == 0
    assert removed_lines(df.limit(0), Scratch(spark, "test")).count() == 0
    assert split_units("a\n \n\nb\nc", "paragraph") == [(0, 1), (5, 8)]
