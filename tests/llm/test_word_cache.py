import random
import time

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from rulequarry.llm import packing
from rulequarry.llm.bpe import MergeReplay, read_ranks
from rulequarry.llm.queries import op10_hierarchical_packing
from rulequarry.llm.words import WordCache


def test_cache_holds_what_was_asked():
    made = []
    cache = WordCache(lambda words: made.extend(words) or [w.upper() for w in words], most=10, room=100)
    rng = random.Random(1)
    common = list("abc")
    for i in range(200):
        words = [*common, *(f"w{rng.randrange(1000)}" for _ in range(rng.choice([0, 1, 5, 30])))]
        got = cache.lookup([words, []])
        assert all(got[w] == w.upper() for w in words), i
    assert len(cache.known) + len(cache.before) <= 2 * 40
    assert cache.lookup([["x" * 1000]])["x" * 1000] == "X" * 1000


def test_one_long_word_takes_no_quadratic_time():
    replay = MergeReplay(read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    word, began = bytes(random.Random(2).choice(b"abcdef+/") for _ in range(400_000)), time.time()
    ids = replay.encode([word])[0]
    assert replay.decode(ids) == word and time.time() - began < 60
    began = time.time()
    assert replay._finish(list(replay.single[np.frombuffer(word, np.uint8)].tolist())) == ids and time.time() - began < 60


def test_query_packs_ids_of_the_plain_library(spark, tmp_path):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext", "plain  text\n\n 's it's", "é漢字 🙂", ""]
    assert 50256 in t.encode(texts[0], add_special_tokens=False).ids
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op10_hierarchical_packing(spark, str(tmp_path)).collect() if not r.start}
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert rows[i].doc_tokens == len(ids)
    coder = packing.coder(packing.VOCABULARY, True)
    rng = random.Random(3)
    many = ["".join(rng.choice(["a", " b", "\n", "  ", "<|endoftext|>", "|>", "é", "'s", "12", "　", "\t"]) for _ in range(rng.choice([3, 50]))) for _ in range(300)]
    assert coder.encode(many) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in many]
