"""Quality classifier by supervised subword embeddings (operator 4).

Words, pairs of words and runs of characters are hashed into one table of learned vectors; a document is the mean of
its vectors, a softmax layer over it gives the classes, and stochastic gradient descent in numpy fits both.  As the output is linear in
the mean, scoring needs one number a table row: the vector's product with the difference of the two
output rows.  A whole batch of texts is hashed at once by prefix sums of a polynomial hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import read, small_batches
from plotweave.llm.training import fit_in_task, held_out, sample
from plotweave.storage import materialise

FOLDS, FOLD = 3, 1
#: At most so many labelled rows of each class, with their whole texts, are fitted on.
TRAIN_ROWS = 1_500
TABLE_BITS, DIM, EPOCHS, RATE = 17, 8, 8, 0.5
CHAR_RUNS = (3, 4)

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_PAD = 8
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the hash's base and of its inverse modulo 2^64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        pair = []
        for base in (_R, _R_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _POWERS[size] = (pair[0], pair[1])
    up, down = _POWERS[size]
    return up[:n], down[:n]


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x2545F4914F6CDD1D % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (document, table row), one array each per kind of feature, for a batch of texts.

    Kinds: runs of 3 and 4 bytes, words, pairs of neighbouring words (a word followed by itself is always
    the same pair).  Documents are numbered from 0; a feature never reaches into another text.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer((b"\0" * _PAD).join([*raw, b""]) + b"\0" * _PAD, np.uint8)
    starts = np.cumsum(sizes + _PAD) - sizes - _PAD
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * up[:-1], out=prefix[1:])
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(doc)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    for k, n in enumerate(CHAR_RUNS):
        yield doc, _bucket((prefix[at + n] - prefix[at]) * down[at], k)
    blank = (data == 32) | (data - 9 < 5) | (data == 0)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[::2], edge[1::2]
    word_doc = np.searchsorted(starts, begin, "right") - 1
    h = (prefix[end] - prefix[begin]) * down[begin]
    yield word_doc, _bucket(h, 100)
    if len(h) > 1:
        same = word_doc[1:] == word_doc[:-1]
        a, b = h[:-1][same], h[1:][same]
        yield word_doc[1:][same], _bucket(np.where(a == b, np.uint64(1), a * np.uint64(31) + b), 200)


@dataclass
class Model:
    """``weight`` has a number a table row; the score of class 1 is the logistic of its mean plus ``bias``."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for doc, row in features(texts):
            total += np.bincount(doc, self.weight[row], len(texts))
            count += np.bincount(doc, minlength=len(texts))
        z = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(texts: list[str], y: np.ndarray, seed: int = 0) -> Model:
    """Fit on texts with classes 0 and 1; with one class only, or none, the score is the smoothed share of class 1."""
    y = np.asarray(y, np.int64)
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = np.array([0.0, float(np.log(prior / (1 - prior)))])
    if len(np.unique(y)) < 2:
        return Model(np.zeros(1 << TABLE_BITS, np.float32), float(bias[1]))
    rng = np.random.default_rng(seed)
    rows, shares = [], []
    for text in texts:
        found = np.concatenate([r for _, r in features([text])])
        row, count = np.unique(found, return_counts=True)
        rows.append(row)
        shares.append((count / max(1, len(found))).astype(np.float32))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << TABLE_BITS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    # Both classes weigh the same, so that one half divides them.
    each = len(y) / (2 * np.bincount(y, minlength=2))
    bias[:] = 0
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = RATE * (1 - done / steps)
            done += 1
            mean = shares[i] @ vectors[rows[i]]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            g = (p / p.sum()).astype(np.float32)
            g[y[i]] -= 1
            g *= each[y[i]]
            back = g @ out
            out -= rate * np.outer(g, mean)
            bias -= rate * 0.1 * g
            # Each vector moves by its share; scaled up as most shares are tiny.
            vectors[rows[i]] -= (rate * 20) * shares[i][:, None] * back
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> Model:
    return fit_in_task(sample(docs, labels, label, FOLDS, FOLD, TRAIN_ROWS, id_col), fit)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for each row, over the whole text; null and empty texts get the score of no features.

    Null and repeated ids are kept, equal texts score alike; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for s in texts:
            part = [t or "" for t in s]
            out, at = [], 0
            while at < len(part):  # about a megabyte at a time
                upto, size = at, 0
                while upto < len(part) and (size < 1 << 20 or upto == at):
                    size += len(part[upto])
                    upto += 1
                out.append(model.scores(part[at:upto]))
                at = upto
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    with small_batches(spark, 512):
        return materialise(docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("score")), "scores")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents, by a model of the labels that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    out = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
