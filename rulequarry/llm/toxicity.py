"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

The features of a text are the character n-grams of its distinct words, hashed into a table. Each is scaled by the smoothed log ratio of its counts in
toxic and other labelled texts, and a logistic regression is fitted on the scaled counts. Since a text's score is a sum over its distinct words, each word
is scored once for a worker.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.llm import workers
from rulequarry.llm.frames import whole_text
from rulequarry.llm.words import WordCache

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
SIZES = (3, 4, 5)
TABLE = 1 << 20
#: Labelled texts of each class that the model is fitted on at most, the first by hash of doc_id.
FIT_ROWS = 1_500
#: The toxic class weighs this share at least, so that few labels suffice.
LEAST_SHARE = 0.3


def grams(word: str) -> list[int]:
    """Places in the table of the n-grams of a word between two marks; a very long word gives all of its own."""
    w = f"^{word}$"
    return [zlib.crc32(w[i : i + n].encode()) % TABLE for n in SIZES for i in range(len(w) - n + 1)] or [zlib.crc32(w.encode()) % TABLE]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


class Model:
    """Weights of the table and the intercept."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias
        self._cache = WordCache(self._score_words)

    def __getstate__(self):
        return self.weight, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def _score_words(self, words):
        return [float(self.weight[grams(w)].sum()) for w in words]

    def score(self, texts: list[str]) -> list[float]:
        """The probability of each text to be toxic."""
        words = [words_of(t) for t in texts]
        known = self._cache.lookup(words)
        raw = np.array([self.bias + sum(map(known.__getitem__, sorted(w))) for w in words])
        return (1 / (1 + np.exp(-np.clip(raw, -500, 500)))).tolist()


def fit(texts: list[str], labels: list[int], share: float | None = None, *, penalty: float = 0.01, smooth: float = 0.1, rounds: int = 100) -> Model:
    """Naive Bayes ratios, then a ridge logistic regression by accelerated gradient steps. ``share``: the weight of the toxic class, of 1."""
    y = np.array(labels, float)
    weight = np.zeros(TABLE, np.float32)
    if not 0 < y.sum() < len(y):
        return Model(weight, 0.0 if not len(y) else (30.0 if y[0] else -30.0))
    number: dict[str, int] = {}
    doc, word, of, places = (array("q") for _ in range(4))
    for d, t in enumerate(texts):
        for w in words_of(t):
            if w not in number:
                number[w] = len(number)
                own = grams(w)
                places.extend(own)
                of.extend([number[w]] * len(own))
            doc.append(d)
            word.append(number[w])
    doc, word, of, places = (np.array(x, np.int32) for x in (doc, word, of, places))
    place, gram = np.unique(places, return_inverse=True)
    gram, number, places = gram.astype(np.int32), len(number), None
    n, v, g = len(y), number, len(place)
    spread = lambda x: np.bincount(doc, weights=np.bincount(of, weights=x[gram], minlength=v)[word], minlength=n)  # noqa: E731  of grams to texts
    gather = lambda e: np.bincount(gram, weights=np.bincount(word, weights=e[doc], minlength=v)[of], minlength=g)  # noqa: E731  of texts to grams
    p, q = gather(y) + smooth, gather(1 - y) + smooth
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum())) if share is None else np.where(y > 0, share / y.sum(), (1 - share) / (n - y.sum()))
    w, b, before = np.zeros(g), 0.0, (np.zeros(g), 0.0)
    norm, x = 1.0, np.random.default_rng(0).standard_normal(g)
    for _ in range(12):  # the largest curvature, by power iteration
        x /= np.linalg.norm(x)
        x = ratio * gather(each * spread(ratio * x)) / 4
        norm = np.linalg.norm(x)
    step, ridge = 1 / (norm + 1 + penalty / n), penalty / n
    for t in range(rounds):
        k = t / (t + 3)
        u, c = w + k * (w - before[0]), b + k * (b - before[1])
        error = each * (1 / (1 + np.exp(-np.clip(spread(ratio * u) + c, -500, 500))) - y)
        before = (w, b)
        w, b = u - step * (ratio * gather(error) + ridge * u), c - step * error.sum()
    weight[place] = (ratio * w).astype(np.float32)
    return Model(weight, float(b))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, whole: bool = False) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0 (``whole``: on all), at most ``fit_rows`` of each class, the first by hash.

    A doc_id labelled more than once is toxic if any of its labels says so; null labels, null ids and labels without a document count for nothing.
    """
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    own = own.where(F.lit(True) if whole else ~held_out(F.col("doc_id")))
    total = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = own.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).union(own.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    rows = texts.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").collect()  # at most 2 * fit_rows ids
    return fit([r.text for r in rows], [r.toxic for r in rows], max(LEAST_SHARE, total.get(1, 0) / max(1, sum(total.values()))))


def _scores(shared):
    def run(batches):
        workers.begin("toxicity")
        model = shared.value
        for batch in batches:
            score = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """``keys`` and ``score`` from 0 to 1 for each row. Null texts are empty and get the score of the intercept. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the table of fixed size
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, whole_text(docs).alias("text")).mapInArrow(_scores(shared), f"{kinds}, score double")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with all their columns. Any row may lack any value; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        workers.begin("toxicity")
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            keep = [s < 0.5 for a in range(0, len(texts), 128) for s in shared.value.score(texts[a : a + 128])]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return docs.select("*", whole_text(docs).alias("_toxicity_text")).mapInArrow(run, docs.schema)
