import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rulequarry.llm.bpe import MergeReplay, decode, encode, encode_digests, encode_texts, read_ranks
from rulequarry.llm.packing import NAMES, TIERS, pack, pack_documents

ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
TEXTS = ["", " ", "\n\n a", "don't we'll '' 's 'rest x's  y", "a" * 3000, "é漢字 🙂🙂 <|endoftext|>", "\r\n\t  tab", "1234567 12,3", "ababab" * 50, "​\x00\x1c x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abest' \n1é漢"), st.characters(codec="utf-8")), max_size=60), max_size=6))
def test_encode_like_tiktoken(texts):
    assert encode_texts(texts) == [oracle.encode_ordinary(t) for t in texts]


def test_replay_of_odd_ranks():
    """Ranks in an order that no training gives, so that a merge makes a pair of lower rank."""
    rng = random.Random(5)
    for _ in range(200):
        tokens = {bytes([i]) for i in range(256)}
        extra = {bytes(rng.choice(b"abc") for _ in range(rng.choice([2, 3, 4]))) for _ in range(12)}
        order = list(extra)
        rng.shuffle(order)
        own = {t: i for i, t in enumerate(sorted(tokens) + order)}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.choice([1, 5, 20]))) for _ in range(8)]
        reference = tiktoken.Encoding("odd", pat_str=r".+", mergeable_ranks=own, special_tokens={})
        assert MergeReplay(own).encode(words) == [reference.encode_ordinary(w.decode()) for w in words]


def test_digests(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (0, "twice", None)], "doc_id long, text string, ids string")
    got = encode_digests(df).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id and r.doc_id > 0:
            ids = oracle.encode_ordinary(TEXTS[r.doc_id])
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TEXTS[r.doc_id].encode()).hexdigest())
    back = {r.doc_id: bytes(r.data).decode() for r in decode(encode(df.where("doc_id > 0"))).collect()}
    assert back == {i: t for i, t in enumerate(TEXTS) if i}
    assert encode_digests(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 300), st.integers(1, 9000)), max_size=80))
def test_pack(sizes):
    got = pack(sizes)
    seen = defaultdict(list)
    for b in got:
        size = sum(n for _, _, n in b)
        assert size == 2048 or (size < 2048 and size & (size - 1) == 0)
        assert all(n > 0 for _, _, n in b)
        for d, s, n in b:
            seen[d].append((s, n))
    for d, size in enumerate(sizes):
        at = 0
        for s, n in sorted(seen[d]):
            assert s == at
            at += n
        assert at == size


def test_pack_documents(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(6)
    texts = dict(enumerate([*TEXTS, *(" ".join(rng.choice(["word", "été", "x1", "it's"]) for _ in range(rng.choice([3, 400, 5000]))) for _ in range(40))]))
    df = spark.createDataFrame([(i, x, 1) for i, x in texts.items()] + [(900, None, 1)], "doc_id long, text string, length int").repartition(3)
    texts[900] = ""
    rows = pack_documents(df, buffer=20_000).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, x in texts.items():
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_length and (at == 2048 or at & (at - 1) == 0)
    assert pack_documents(df.limit(0)).columns == NAMES and pack_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack_documents(df, tiers=(2048, 1000))
    assert TIERS[0] == 2048
    assert base64
