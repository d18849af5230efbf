"""The tree model against enumeration, the multi-index with fewer candidates than vectors, and the classifier over tables."""

import itertools
import random
from types import SimpleNamespace

import numpy as np
from rulequarry.llm import toxicity
from rulequarry.llm.ann import nearest_neighbours
from rulequarry.llm.html_extract import KINDS, Model
from rulequarry.session import Scratch


def test_marginals_like_enumeration():
    rng = random.Random(4)
    for n in (1, 2, 5, 9):
        model = Model()
        model.unary[:n] = [rng.gauss(0, 2) for _ in range(n)]
        model.edge = [[[rng.gauss(0, 2) for _ in range(2)] for _ in range(2)] for _ in range(KINDS)]
        blocks = [SimpleNamespace(features=[i], parent=rng.randrange(i) if i else -1, kind=rng.randrange(KINDS)) for i in range(n)]
        total, content = 0.0, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=n):
            energy = sum(model.unary[i] * x for i, x in enumerate(labels))
            energy += sum(model.edge[b.kind][labels[b.parent]][labels[i]] for i, b in enumerate(blocks) if i)
            total += np.exp(energy)
            content += np.exp(energy) * np.array(labels)
        assert np.allclose(model.marginals(blocks), content / total)


def test_recall_with_fewer_candidates_than_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 16))[rng.integers(0, 60, 4000)] * 2 + rng.standard_normal((4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in nearest_neighbours(df, df.where("vec_id % 100 = 0"), Scratch(spark, "test"), centroids=16, candidates=300, share=0.1).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    for i in range(0, 4000, 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert len(got[i]) == 10 and np.allclose(list(got[i].values()), d[list(got[i])])
        hits += len(set(got[i]) & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 400


def _texts(n):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("aeioustrn") for _ in range(6)) for _ in range(300)]
    for i in range(n):
        words, bad = [rng.choice(vocab) for _ in range(40)], int(i % 3 == 0)
        if bad:
            words[3:5] = [rng.choice(["grobian", "schurke", "lump"]) for _ in range(2)]
        yield i, " ".join(words), bad


def test_toxicity_over_tables_with_odd_labels(spark):
    own = list(_texts(400))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in own] + [(900, None, None), (901, "", "y"), (None, own[0][1], "z")], "doc_id long, text string, score string")
    odd = [(900, None), (None, 1), (5000, 1), (1, 0), (0, 1), (0, 0)]  # nulls, no such document, repeated labels
    schema = "doc_id long, toxic int"
    labels = spark.createDataFrame([(i, y) for i, _, y in own] + odd, schema)
    model = toxicity.train(docs, labels)
    rows = docs.withColumn("out", toxicity.held_out(docs.doc_id)).select("doc_id", "out").collect()
    out = {r.doc_id for r in rows if r.out and r.doc_id < 400}
    assert 40 < len(out) < 120
    turned = toxicity.train(docs, spark.createDataFrame([(i, 1 - y if i in out else y) for i, _, y in own] + odd, schema))
    assert turned.bias == model.bias and np.array_equal(turned.weight, model.weight)  # held-out labels teach nothing

    got = [(r.doc_id, r.score) for r in toxicity.score(docs, model, "doc_id").collect()]
    assert len(got) == 403 and all(0 <= s <= 1 for _, s in got)
    score = dict(got)
    assert np.mean([(score[i] >= 0.5) == own[i][2] for i in out]) > 0.95 and score[900] == score[901] < 0.5
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, s in got if i is not None and s < 0.5)

    for none in (labels.limit(0), labels.where("toxic = 0")):
        blank = toxicity.train(docs, none)
        assert len(toxicity.score(docs, blank, "doc_id").collect()) == 403
    assert toxicity.score(docs.limit(0), model, "doc_id").count() == 0 and toxicity.drop_toxic(docs.limit(0), model).count() == 0
