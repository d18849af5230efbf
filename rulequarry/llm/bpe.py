"""Byte-level BPE by corpus-level merge replay.

The distinct words of a stretch of the corpus are laid out one after another as a linked list of tokens. An inverted index from token pair to the
positions where it occurs then applies the merges in rank order; each merge touches only its positions and their neighbours. A merge whose
neighbour makes a pair of a rank that has been passed (no trained vocabulary has one) leaves its word to a linked list and a heap of its own.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm import workers
from rulequarry.llm.frames import whole_text
from rulequarry.llm.words import PATTERN, WordCache, stretches

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


#: Words of a generation of a cache.
KNOWN = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes many words at once by the ranks of a vocabulary file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.single = np.array([ranks[bytes((i,))] for i in range(256)], np.int64)
        self.shift = max(ranks.values()).bit_length()
        #: The rank of the token that two neighbours make, which is also its id, by the ids of both.
        self.pairs = {(a << self.shift) | b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
        self.first = np.array([[self.pairs.get(int(a) << self.shift | int(b), -1) for b in self.single] for a in self.single], np.int64)

    def _index(self, data: bytes) -> tuple[list[int], dict[int, list[int]]]:
        """The tokens of single bytes, -1 for the zero that stands before, between and after words, and the places of each pair, by rank."""
        codes = np.frombuffer(data, np.uint8)
        inside = np.ones(len(codes), bool)
        inside[self._walls] = False
        rank = np.where(inside[:-1] & inside[1:], self.first[codes[:-1], codes[1:]], -1)
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at], prepend=-1, append=-1)) if len(at) else np.zeros(1, np.int64)
        places, own = at.tolist(), rank[at].tolist()
        where = {own[a]: places[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
        return np.where(inside, self.single[codes], -1).tolist(), where

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word. A word that is a token is that token; else the pair of lowest rank merges first, leftmost among equals."""
        out: list = [[whole] if (whole := self.ranks.get(word)) is not None else [] for word in words]
        open_ = [w for w, word in enumerate(words) if word and not out[w]]
        if not open_:
            return out
        heads = np.cumsum([0, *(len(words[w]) + 1 for w in open_)]) + 1
        self._walls = heads - 1
        token, where = self._index(b"\0" + b"\0".join([words[w] for w in open_]) + b"\0")
        heads = heads[:-1].tolist()
        left, right = list(range(-1, len(token) - 1)), list(range(1, len(token) + 1))
        shift, pair, push, pop = self.shift, self.pairs.get, heapq.heappush, heapq.heappop
        ranks = list(where)
        heapq.heapify(ranks)
        alone: set[int] = set()
        while ranks:
            rank = pop(ranks)
            for i in sorted(where.pop(rank)):
                a, j = token[i], right[i]
                if a < 0 or (b := token[j]) < 0 or pair(a << shift | b) != rank or (alone and bisect.bisect(heads, i) in alone):
                    continue  # an earlier merge took one of the two
                token[i], token[j] = rank, -1
                right[i] = k = right[j]
                left[k], h = i, left[i]
                if (c := token[h]) >= 0 and (r := pair(c << shift | rank)) is not None:
                    if r <= rank:  # it comes before what is left of this rank: this word goes on by itself
                        alone.add(bisect.bisect(heads, i))
                    elif (own := where.get(r)) is not None:
                        own.append(h)
                    else:
                        where[r] = [h]
                        push(ranks, r)
                if (c := token[k]) >= 0 and (r := pair(rank << shift | c)) is not None:
                    if r <= rank:
                        alone.add(bisect.bisect(heads, i))
                    elif (own := where.get(r)) is not None:
                        own.append(i)
                    else:
                        where[r] = [i]
                        push(ranks, r)
        for n, (w, i) in enumerate(zip(open_, heads, strict=True)):
            ids = []
            while token[i] >= 0:
                ids.append(token[i])
                i = right[i]
            out[w] = self._finish(ids) if n + 1 in alone else ids
        return out

    def _finish(self, ids: list[int]) -> list[int]:
        """The rest of one word: a linked list of its tokens and a heap of its pairs."""
        n, shift, pair = len(ids), self.shift, self.pairs.get
        token, left, right = [*ids, -1], [-1, *range(n)], [*range(1, n + 1), n]
        heap = [(r, i) for i in range(n - 1) if (r := pair(ids[i] << shift | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if token[i] < 0 or token[j] < 0 or pair(token[i] << shift | token[j]) != rank:
                continue
            token[i], token[j] = rank, -1
            right[i] = k = right[j]
            left[k] = i
            for x in (left[i], i):
                if x >= 0 and token[right[x]] >= 0 and (r := pair(token[x] << shift | token[right[x]])) is not None:
                    heapq.heappush(heap, (r, x))
        return [t for t in token if t >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_coders: dict = {}
workers.keeps("bpe", _coders.clear)


class Coder:
    """What a worker process keeps for a vocabulary: of distinct words, their ids, or what is joined for a text."""

    def __init__(self, path: str):
        self.replay = MergeReplay(read_ranks(path))
        self.ids = WordCache(self._encode, KNOWN)
        self.told = WordCache(lambda words: [(b",".join([b"%d" % i for i in ids]), self.replay.decode(ids)) for ids in self._encode(words)], KNOWN)

    def _encode(self, words: list[str]) -> list[list[int]]:
        return self.replay.encode([w.encode() for w in words])


def coder(path: str) -> Coder:
    """One for each vocabulary of a worker process."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode_texts(texts: list[str], path: str = VOCABULARY) -> list[list[int]]:
    """The ids of each whole text, without special tokens."""
    return [[i for ids in values for i in ids] for values in coder(path).ids.values([PATTERN.findall(t) for t in texts])]


def _digests(path):
    def run(batches):
        workers.begin("bpe")
        cache = coder(path).told
        for batch in batches:
            texts, rows = batch.column("text").to_pylist(), []
            for a, b in stretches(texts):
                for values in cache.values([PATTERN.findall(t) for t in texts[a:b]]):
                    told, decoded = zip(*values, strict=True) if values else ((), ())
                    ids = b",".join(told)
                    rows.append((ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()))
            n, ids, back = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``ids_sha256`` of the decimal ids joined by commas, ``decoded_sha256`` of the ids decoded again.

    A null text is empty and has no tokens. doc_id may be null or repeat; every row gives a row. An empty table gives an empty result, and other
    columns are ignored. Texts are never cut; a worker holds one Arrow batch and bounded numbers and bytes of distinct words. No shuffle.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text")).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode_column(path):
    def run(batches):
        workers.begin("bpe")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = [x for a, b in stretches(texts) for x in encode_texts(texts[a:b], path)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of each whole text; odd input as in encode_digests."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text")).mapInArrow(_encode_column(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``data``, the bytes behind ``ids``; null ids give null bytes, and an id outside the vocabulary is an error."""

    def run(batches):
        workers.begin("bpe")
        replay = coder(path).replay
        for batch in batches:
            data = [None if x is None else replay.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
