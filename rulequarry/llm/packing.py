"""Hierarchical multi-length packing.

A document becomes pieces of at most the longest window; what is left over after its full windows is routed to the smallest of several
context sizes (tiers) that holds it. Each tier is packed by best fit, gaps of long windows are filled from shorter tiers, and what a tier cannot
fill is cut into exact smaller windows. Sequences of equal length are then dealt to step groups.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm import workers
from rulequarry.llm.frames import whole_text
from rulequarry.llm.words import PATTERN, STRETCH, WordCache, stretches

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WINDOW = 2048
#: Context sizes, longest first; each is a power of two.
TIERS = (2048, 1024, 512, 256)
END = 1
#: Tokens that are gathered before they are packed; bounds the memory of a task.
BUFFER = 2_000_000

#: Words that are encoded by one call, and characters of the texts that are split at a time: what is at hand then stays in a processor's cache.
JOINED = 10_000
NEAR = 1 << 17
#: Words of a generation of the cache; of fewer, many common ones are encoded again and again.
KNOWN = 600_000

_coders: dict = {}
workers.keeps("packing", _coders.clear)


class Coder:
    """The tokenizers library for a worker process, with the little-endian 32-bit ids of each distinct word of the pattern that it has met.

    ``added``: a literal added token of the vocabulary in a text is that token, as the library does of itself; else it is text like any other.
    """

    def __init__(self, path: str, added: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.cache = WordCache(self._word_ids, KNOWN)
        self.break_ = self._ids("\n")
        tokens = [t for t in self.tokenizer.get_added_tokens_decoder().values() if added or not t.special]
        if any(t.lstrip or t.rstrip or t.single_word for t in tokens):
            raise ValueError("added tokens that take in white space or whole words only are not supported")
        self.literals = {t.content for t in tokens}
        self.literal = re.compile(f"({'|'.join(map(re.escape, sorted(self.literals, key=lambda t: (-len(t), t))))})") if tokens else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Words are encoded many at a time, with a line break before each; the ids between the breaks are theirs."""
        out: dict[str, bytes] = {w: self._ids(w).tobytes() for w in words if w.isspace()}
        rest, at = [w for w in words if w not in out], 0
        while at < len(rest):
            size, end = 0, at
            while end < len(rest) and end - at < JOINED and size < STRETCH:
                size, end = size + len(rest[end]), end + 1
            own, at = rest[at:end], end
            ids = self._ids("".join([f"\n{w}" for w in own]))
            cuts = np.append(np.flatnonzero(ids == self.break_[0]), len(ids)).tolist()
            if len(self.break_) == 1 and len(cuts) == len(own) + 1:
                data = ids.tobytes()
                out.update((w, data[4 * (a + 1) : 4 * b]) for w, a, b in zip(own, cuts[:-1], cuts[1:], strict=True))
            else:  # a vocabulary in which a line break is no token of its own
                out.update((w, self._ids(w).tobytes()) for w in own)
        return [out[w] for w in words]

    def words(self, text: str) -> list[str]:
        """A word is one unit to the tokenizer in any surroundings."""
        if self.literal is None or not self.literal.search(text):
            return PATTERN.findall(text)
        parts = self.literal.split(text)  # texts and literals by turns
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else PATTERN.findall(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(b"".join, self.cache.values([self.words(t) for t in texts])))


def coder(path: str, added: bool) -> Coder:
    if (path, added) not in _coders:
        _coders[path, added] = Coder(path, added)
    return _coders[path, added]


def pack(sizes: list[int], window: int = WINDOW, tiers: tuple = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` for documents of the given numbers of tokens.

    Each sequence is full (``window``) or exactly a power of two, so nothing is padded; a document of at most ``window``
    tokens is cut only to close a gap.
    """
    full: list = []
    routed: dict[int, list] = {t: [] for t in tiers}
    for d, n in enumerate(sizes):
        cut = n - n % window
        full += [[(d, s, window)] for s in range(0, cut, window)]
        if n > cut:
            routed[min((t for t in tiers if t >= n - cut), default=window)].append((n - cut, d, cut))
    # pack each tier: the largest first, into the bin that it fills best
    bins: dict[int, list] = {}
    for t in tiers:
        done, room = [], []  # room: sorted (free, bin)
        for n, d, s in sorted(routed[t], key=lambda x: (-x[0], x[1])):
            i = bisect.bisect_left(room, (n, -1))
            if i < len(room):
                free, b = room.pop(i)
            else:
                free, b = t, len(done)
                done.append([])
            done[b].append((d, s, n))
            if free > n:
                bisect.insort(room, (free - n, b))
        bins[t] = done
    # windows of the shorter tiers that are full stand; the rest fills gaps of long ones, largest piece that fits first
    out = full + [b for t in tiers for b in bins[t] if sum(p[2] for p in b) == t]
    gaps = [b for b in bins[window] if sum(p[2] for p in b) < window]
    spare = sorted((p[2], p[0], p[1]) for t in tiers[1:] for b in bins[t] if sum(p[2] for p in b) < t for p in b)
    open_ = []
    for b in gaps:
        free = window - sum(p[2] for p in b)
        while spare and (i := bisect.bisect_left(spare, (free + 1,))) > 0:
            n, d, s = spare.pop(i - 1)
            b.append((d, s, n))
            free -= n
        open_.append((free, b))
    # pieces that are left go one after another into the gaps, cut where a gap closes, then into new windows
    rest = [(d, s, n) for n, d, s in spare]
    closed = []
    for free, b in sorted(open_, key=lambda x: x[0]):
        while free and rest:
            d, s, n = rest.pop()
            k = min(n, free)
            b.append((d, s, k))
            free -= k
            if n > k:
                rest.append((d, s + k, n - k))
        closed.append(b)
    while rest:
        b, free = [], window
        while free and rest:
            d, s, n = rest.pop()
            k = min(n, free)
            b.append((d, s, k))
            free -= k
            if n > k:
                rest.append((d, s + k, n - k))
        closed.append(b)
    # what is still short: all of it in a row, in full windows, then the tail in powers of two
    short = [p for b in closed if sum(p[2] for p in b) < window for p in b]
    out += [b for b in closed if sum(p[2] for p in b) == window]
    total, i, used = sum(p[2] for p in short), 0, 0
    while total:
        want = window if total >= window else 1 << (total.bit_length() - 1)
        total -= want
        b = []
        while want:
            d, s, n = short[i]
            k = min(n - used, want)
            b.append((d, s + used, k))
            want -= k
            used += k
            if used == n:
                i, used = i + 1, 0
        out.append(b)
    return out


def _pack_rows(path, added, window, tiers, buffer, groups):
    def run(batches):
        workers.begin("packing")
        own, base, done = coder(path, added), TaskContext.get().partitionId() << 33, 0
        ids, data = [], []

        def flush():
            nonlocal done, ids, data
            rows = []
            for b in pack([len(x) // 4 for x in data], window, tiers):
                at, size = 0, sum(p[2] for p in b)
                for d, s, n in b:
                    rows.append((ids[d], s, n, zlib.crc32(memoryview(data[d])[4 * s : 4 * (s + n)]), len(data[d]) // 4, base + done, at, size, (done % groups)))
                    at += n
                done += 1
            ids, data = [], []
            for i in range(0, len(rows), 50_000):
                cols = zip(*rows[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], NAMES)

        tokens, end = 0, np.array([END], "<u4").tobytes()
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in stretches(texts, NEAR):
                for key, found in zip(keys[a:b], own.encode(texts[a:b]), strict=True):
                    data.append(found + end)
                    ids.append(key)
                    tokens += len(data[-1]) // 4
                if tokens >= buffer:
                    yield from flush()
                    tokens = 0
        if data:
            yield from flush()

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]


def pack_documents(docs: DataFrame, *, path: str = VOCABULARY, window: int = WINDOW, tiers: tuple = TIERS, buffer: int = BUFFER, groups: int = 8, added: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group``.

    Each task packs the documents that it reads, ``buffer`` tokens at a time, so there is no shuffle and a document of any length is held
    by one task as its ids only. A sequence is ``window`` long or exactly a power of two. ``step_group`` deals sequences in order of tier,
    so groups get equally many of each length. A null text is empty and is its end token alone. Rows without
    doc_id, or with the same one, are documents of their own; an empty table gives no pieces; other columns are ignored. ``added``: the string
    of an added token (``<|endoftext|>``) in a text is that token, as the tokenizers library reads it of itself; else it is ordinary text.
    """
    if sorted(tiers, reverse=True) != list(tiers) or tiers[0] != window or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two from the window down")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    return rows.mapInArrow(_pack_rows(path, added, window, tiers, buffer, groups), ", ".join(f"{n} long" for n in NAMES))
