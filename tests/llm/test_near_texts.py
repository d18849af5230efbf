import random

from corpus_pipeline import drop_near_copies
from rulequarry.llm.components import Forest
from rulequarry.llm.near_texts import shingles


def sets(text):
    words = text.lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else {()}


def test_stage_like_brute_force(spark, tmp_path):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    texts = [None, "", " \n", "one two", "One  two", "two one"]
    for n in (30, 100, 300, 1000):
        for _ in range(12):
            words = [rng.choice(vocab) for _ in range(n)]
            for share in (0, 0.005, 0.01, 0.02, 0.05):
                own = list(words)
                for _ in range(round(share * n)):
                    own[rng.randrange(n)] = rng.choice(vocab)
                texts.append(" ".join(own))
    texts += [f"{' '.join(vocab[:60])} tail{i}" for i in range(40)]  # a group too large for pairs
    rng.shuffle(texts)
    jac = lambda a, b: len(a & b) / len(a | b)
    own, forest = [sets(t or "") for t in texts], Forest()
    for i, a in enumerate(own):
        assert len(shingles((texts[i] or "").encode())) == len(a)
        for j in range(i):
            if min(len(a), len(own[j])) >= 0.8 * max(len(a), len(own[j])) and jac(a, own[j]) >= 0.8:
                forest.join(i, j)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    kept = drop_near_copies(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {forest.find(i) for i in range(len(texts))}
    assert drop_near_copies(spark, df.limit(0), str(tmp_path)).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (5, "a"), (5, "a")], "doc_id long, text string")
    assert sorted((r.text, r.doc_id) for r in drop_near_copies(spark, nulls, str(tmp_path)).collect()) == [("a", 5), ("b", None)]
