import random

import numpy as np

from rulequarry.llm.ann import nearest_neighbours
from rulequarry.llm.html_extract import default_model, extract, main_text
from rulequarry.llm.labelled_pages import labelled_pages
from rulequarry.llm.toxicity import fit
from rulequarry.session import Scratch


def test_neighbours_like_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 6)).round(1)
    x[50:90] = x[7]
    odd = [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, [1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest_neighbours(df, df.where("vec_id % 10 = 0"), Scratch(spark, "test"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i in range(0, 300, 10):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        best = np.lexsort((np.arange(300), d))[:5]
        assert [v for _, v, _ in sorted(got[i])] == best.tolist() and np.allclose([s for *_, s in sorted(got[i])], d[best])
    assert set(got) == set(range(0, 300, 10))
    assert nearest_neighbours(df.limit(0), df, Scratch(spark, "test")).count() == 0


def test_main_text(spark):
    model = default_model()
    pages = labelled_pages(100, 77)
    assert sum(extract(p, model).split("\n") == wanted for p, wanted in pages) >= 95
    html = "<body><nav><a href='/'>Home</a></nav><article><h1>A &amp; b</h1><p>One <b>two</b>\n three. Four five six.<p>Seven eight nine ten.</article><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", html), (2, None, None), (None, None, "<<</p> &am")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in main_text(df, model).collect()}
    text = "A & b\nOne two three. Four five six.\nSeven eight nine ten."
    assert got[1] == (text, len(text)) and got[2] == ("", 0) and len(got) == 3


def test_toxicity_on_held_out_texts():
    rng = random.Random(2)
    vocab = ["".join(rng.choice("aeioustrn") for _ in range(6)) for _ in range(300)]
    texts, labels = [], []
    for _ in range(400):
        words = [rng.choice(vocab) for _ in range(40)]
        labels.append(int(rng.random() < 0.3))
        if labels[-1]:
            words[3:5] = [rng.choice(["grobian", "schurke", "lump"]) for _ in range(2)]
        texts.append(" ".join(words))
    model = fit(texts[:300], labels[:300], 0.3)
    score = model.score([*texts[300:], ""])
    assert np.mean([(s >= 0.5) == y for s, y in zip(score, labels[300:], strict=False)]) > 0.95 and 0 <= score[-1] < 0.5
