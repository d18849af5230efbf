import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from rulequarry.llm.components import Forest, connected_components
from rulequarry.llm.exact import BASES, MODULI, combine, drop_exact_copies, exact_groups, fingerprint
from rulequarry.llm.simhash import drop_near_copies, hamming_links, near_groups, simhash
from rulequarry.session import Scratch

DOCS = "doc_id long, text string, lang string, row long"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    by = defaultdict(list)
    for (i, _), n in zip(rows, norm, strict=True):
        by[n].append(i)
    return sorted((i, min(by[n]), len(by[n]), i == min(by[n]), hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm, strict=True))


def test_fingerprints_compose():
    data = np.frombuffer(random.Random(1).randbytes(50_000), np.uint8)
    for base, m in zip(BASES, MODULI, strict=True):
        whole = fingerprint(data, base, m)
        for cut in (0, 1, 17, 16384, 49_999):
            assert combine(fingerprint(data[:cut], base, m), fingerprint(data[cut:], base, m), len(data) - cut, base, m) == whole
    assert fingerprint(np.zeros(3, np.uint8), BASES[0], MODULI[0]) != fingerprint(np.zeros(2, np.uint8), BASES[0], MODULI[0])


@pytest.mark.parametrize("moduli", [MODULI, (3, 5)])
def test_exact_groups(spark, scratch, moduli):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        t = " ".join(rng.choice(["a", "bb", "é", " x"]) for _ in range(rng.choice([0, 1, 2, 30])))
        rows.append((i, rng.choice([t, t.replace(" ", "\t \n"), None if not t else t])))
    long = "word é " * 40
    rows += [(1000, long), (1001, long.replace(" ", "\n")), (1002, long[:-2] + "x "), (1003, long * 2)]
    rows += [(2000 + i, "hot copy") for i in range(200)]
    df = spark.createDataFrame([(i, t, "en", 7) for i, t in rows], DOCS).repartition(5)
    got = exact_groups(df, scratch, chunk=16, moduli=moduli)
    assert sorted(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == brute_exact(rows)


def test_exact_odd_input(spark, scratch):
    assert exact_groups(spark.createDataFrame([], DOCS), scratch).count() == 0
    rows = [(None, "a"), (None, "a"), (3, "a"), (3, "a"), (None, "b"), (None, None), (4, "")]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS)
    got = exact_groups(df, scratch).collect()
    assert len(got) == 7
    assert sum(r.kept for r in got) == 3
    assert {r.keep_id for r in got if r.group_size == 4} == {3}
    assert {r.doc_id for r in got if r.kept} == {3, None, 4}
    kept = drop_exact_copies(df, scratch)
    assert kept.columns == df.columns and kept.count() == 3


def test_simhash_by_hand():
    text = "The  quick\tBROWN fox É jumps"
    words = ["the", "quick", "brown", "fox", "É", "jumps"]
    h = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(4)]
    assert simhash(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 4)
    assert simhash(b"two Words") == xxhash.xxh64(b"two words", seed=42).intdigest()
    assert simhash(b" \n") == 0


def brute_components(values, distance):
    forest = Forest()
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                forest.join(a, b)
    return {v: forest.find(v) for v in values}


@pytest.mark.parametrize(("distance", "blocks", "most"), [(2, 4, 1 << 15), (2, 4, 3), (3, 5, 10)])
def test_hamming_components(spark, scratch, distance, blocks, most):
    rng = random.Random(3)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            values.add(base)
            for _ in range(rng.choice([1, 2, 3, 4])):
                base ^= 1 << rng.randrange(64)
    values = sorted(values)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(v),) for v in values], "fp long").repartition(4)
    links = hamming_links(df, scratch, distance=distance, blocks=blocks, most=most)
    got = {r.node & (1 << 64) - 1: r.component & (1 << 64) - 1 for r in connected_components(links, scratch).collect()}
    for u, v in links.collect():
        assert ((u ^ v) & (1 << 64) - 1).bit_count() <= 64
    want = brute_components(values, distance)
    classes = lambda m: {frozenset(k for k in values if m.get(k, k) == c) for c in {m.get(k, k) for k in values}}
    assert classes(got) == classes(want)


def test_components_chain(spark, scratch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100), (None, 3), (7, None)] + [(200, 201 + i) for i in range(50)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long").repartition(6), scratch).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 251)}


def test_near_groups(spark, scratch):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 5, 400]))]
        for _ in range(rng.choice([1, 3])):
            rows.append((len(rows) * 7 % 501, " ".join(words)))
            if len(words) > 100:
                words[rng.randrange(len(words))] = "changed"
    rows.append((502, None))
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], DOCS).repartition(3).drop("row")
    prints = {i: simhash((t or "").encode()) for i, t in rows}
    want = brute_components(sorted(set(prints.values())), 2)
    least = defaultdict(lambda: 1 << 60)
    for i, f in prints.items():
        least[want[f]] = min(least[want[f]], i)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in near_groups(df, scratch).collect()}
    assert got == {i: (f, least[want[f]]) for i, f in prints.items()}
    assert {r.doc_id for r in drop_near_copies(df, scratch).collect()} == set(least.values())
    assert near_groups(df.limit(0), scratch).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (5, "a"), (5, "a")], "doc_id long, text string")
    assert sorted(r.text for r in drop_near_copies(nulls, scratch).collect()) == ["a", "b"]
