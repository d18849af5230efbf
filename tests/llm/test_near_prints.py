"""The candidates of the near-copy stage come from SimHashes and their Gray-order index."""

import random

import numpy as np
import pyarrow as pa
import pytest

from rulequarry.llm import near_texts
from rulequarry.llm.near_texts import BITS, FAR, FAR_HALF, TABLES, choices, fingerprint, jaccard, shingles
from rulequarry.session import Scratch


def bits(x):
    return int(x) & ((1 << 64) - 1)


def apart(x, y):
    return [bits(a ^ b).bit_count() for a, b in zip(x, y, strict=True)]


def pairs(n, count, seed):
    rng, vocab = random.Random(seed), [f"w{i}" for i in range(5000)]
    for _ in range(count):
        words = [rng.choice(vocab) for _ in range(n)]
        own = list(words)
        for i in rng.sample(range(n), max(1, n // 50)):
            own[i] = rng.choice(vocab)
        yield " ".join(words), " ".join(own)


def test_fingerprint():
    values = shingles(b"a b c d e f g h i j")
    low = sum(1 << b for b in range(64) if sum(int(v) >> b & 1 for v in values) * 2 > len(values))
    assert bits(fingerprint(values)[0]) == low and fingerprint(values) == fingerprint(values.copy())
    assert len(choices(TABLES, BITS)) == TABLES and {bits(a).bit_count() + bits(b).bit_count() for a, b in choices(TABLES, BITS)} == {BITS}


@pytest.mark.parametrize("copies", [1, 30])
def test_search_like_brute_force(copies):
    """One key; large groups are told as a whole, small ones as their pairs."""
    rng = random.Random(copies)
    values = []
    for _ in range(40):
        a, b = rng.getrandbits(64), rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, copies])):
            values.append([x ^ sum(1 << i for i in rng.sample(range(64), rng.choice([0, 6, 15, 19]))) for x in (a, b)])
    a, b = (np.array([v[i] for v in values], np.uint64).view(np.int64) for i in (0, 1))
    table = pa.RecordBatch.from_arrays([pa.array(np.repeat([1, 2], [len(values), 0])), pa.array(np.arange(len(values))), pa.array(a), pa.array(b)], ["key", "number", "a", "b"])
    met = {}
    for out in near_texts._search(FAR, FAR_HALF)([table.slice(0, 17), table.slice(17)]):
        for bucket, number in zip(*(c.to_pylist() for c in out.columns), strict=True):
            met.setdefault(bucket, set()).add(number)
    together = {(i, j) for s in met.values() for i in s for j in s if i < j}
    far = {(i, j): apart((a[i], b[i]), (a[j], b[j])) for j in range(len(values)) for i in range(j)}
    near = {p for p, d in far.items() if sum(d) <= FAR and d[0] <= FAR_HALF}
    assert near and near <= together
    assert all(sum(far[min(s), max(s)]) <= FAR for s in met.values() if len(s) == 2)


def test_recall_at_the_similarity(spark):
    """Of pairs at 0.8 or more at least 98 % are linked, and none below."""
    texts = [x for n in (50, 100, 500) for x in pairs(n, 60, n)]
    want = {i for i, (a, b) in enumerate(texts) if jaccard(shingles(a.encode()), shingles(b.encode())) >= 0.8}
    rows = [(2 * i + k, t[k]) for i, t in enumerate(texts) for k in (0, 1)]
    links = near_texts.near_links(spark.createDataFrame(rows, "number long, text string"), Scratch(spark, "test")).collect()
    found = {(min(r.u, r.v), max(r.u, r.v)) for r in links}
    assert found <= {(2 * i, 2 * i + 1) for i in want} and len(found) >= 0.98 * len(want)
