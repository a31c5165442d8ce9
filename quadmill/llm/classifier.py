"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters or digits and runs of ASCII punctuation; features are hashed single tokens and pairs, where
every pair of equal tokens is the one feature "repeated".  A document is the mean of its features; its score is a sparse
dot product with the weights, which have a fixed size and go to every task.

Training uses at most SAMPLE labelled rows, chosen by a hash of doc_id (a documented bound); scoring reads every text.

Odd cases: a null or empty text has no features, and the score of the bias; a null doc_id is scored and never learned
from; a document with several labels has the highest; without labels every weight is zero and every score 1/2;
repeated rows get one score each; an empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadmill.llm import words as W

#: The most labelled documents to learn from.
SAMPLE = 6000
BITS = 18
EPOCHS = 3
#: Follow-the-regularised-leader: learning rate, its offset, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
#: Features are means of a document's n-grams times this.
SCALE = 20.0

_KIND = np.full(256, 2, np.uint8)
_KIND[33:127] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 2
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_REPEATED = np.uint64(0x1B873593CC9E2D51)


def tokens(column: pa.Array) -> W.Words:
    """Runs of letters and digits (any byte over 127 is one) and runs of ASCII punctuation."""
    buf, offsets = W.string_bytes(column)
    n = len(buf)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return W.Words(buf, empty, empty, np.zeros(len(offsets), np.int64))
    kind = _KIND[buf]
    change = np.ones(n + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets[offsets < n]] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    return W.Words(buf, starts, ends, np.searchsorted(starts, offsets))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of each text, repeats included, and n+1 offsets."""
    t = tokens(column)
    h = t.hashes()
    one = h >> np.uint64(64 - BITS)
    two = W.ngrams(h, 2) >> np.uint64(64 - BITS)
    if len(h) > 1:
        two[:-1][h[1:] == h[:-1]] = _REPEATED >> np.uint64(64 - BITS)
    both = np.stack((one, two), 1).ravel().astype(np.int64)
    # a document's last token has no pair
    last = t.first[1:][np.diff(t.first) > 0] - 1
    use = np.ones(len(both), bool)
    use[2 * last + 1] = False
    n = np.diff(t.first)
    return both[use], np.concatenate(([0], np.cumsum(np.maximum(2 * n - 1, 0))))


class FTRL:
    """Logistic regression; the last weight is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - s * w
        self.n[at] += g * g


def train(texts: list[str | None], labels: list[int]) -> np.ndarray:
    """The weights (float32; the last is the bias) learned from texts in the order given."""
    model = FTRL()
    rows = []
    for a in range(0, len(texts), 200):
        found, at = features(pa.array(texts[a : a + 200], pa.string()))
        for d in range(len(at) - 1):
            k, c = np.unique(found[at[d] : at[d + 1]], return_counts=True)
            rows.append((np.append(k, 1 << BITS).astype(np.int32), np.append(SCALE * c / max(c.sum(), 1), 1.0).astype(np.float32)))
    for _ in range(EPOCHS):
        for (k, x), y in zip(rows, labels):
            model.learn(k, x, y)
    return model.weights(slice(None)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from at most ``sample`` of the labels' (doc_id, label) rows."""
    chosen = labels.dropna(subset=["doc_id", "label"]).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows are broadcast, and at most their texts' weight comes to the driver
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text", "label").limit(sample).toArrow()
    return train(rows.column("text").to_pylist(), rows.column("label").to_pylist())


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score (the probability of label 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for s in W.slices(batches):
            found, at = features(s.column("text"))
            total = np.concatenate(([0.0], np.cumsum(w[found])))
            n = np.diff(at)
            logit = SCALE * (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1) + w[-1]
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], ["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
