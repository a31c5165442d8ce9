"""Language identification of words by a linear-chain conditional random field.

A word's features are hashed byte n-grams over the word and its bounds (so they hold its affixes), the word itself, and
its entry in a lexicon of the training words with their languages.  A transition matrix is learned from training
texts mixed in runs, as code-switched text is.  Forward-backward gives every word the probabilities of the languages; a
document's language is the one with the largest mean.  A document's words are cut into blocks whose transfer
matrices are multiplied in parallel, so a very long text costs no more for each word than a short one.

Training uses at most SAMPLE documents of each language (a documented bound), whole texts; labelling reads every text.

Odd cases: a null text, or one without a letter, is ``und`` with score 0; a null lang is not learned from; without any
language all documents are ``und``; repeated rows are labelled each; an empty table gives no rows.  Only doc_id, text
and, for training, lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadmill.llm import words as W

#: The most documents of a language to learn from.
SAMPLE = 120
#: The most words of the lexicon.
LEXICON = 50_000
BITS = 16
RUN = (4, 40)
SEQUENCE = 64
EPOCHS = 2
BATCH = 256
RATE = 0.15
BLOCK = 64

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (2^BITS, langs)
    transitions: np.ndarray  # (langs, langs), logarithms
    lexicon: np.ndarray  # sorted word hashes
    lexicon_scores: np.ndarray  # (words, langs)
    trust: np.ndarray  # (langs,): weight of the lexicon's scores

    def emissions(self, w: W.Words, one: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Scores (words, langs) of the words at ``one`` with hashes h."""
        at, owner = word_features(w, one, h)
        edges = np.searchsorted(owner, np.arange(len(one)))
        out = np.add.reduceat(self.weights[at], edges, axis=0) if len(one) else np.zeros((0, len(self.langs)))
        return out + self.trust * self.known(h)

    def known(self, h: np.ndarray) -> np.ndarray:
        """The lexicon's scores of words by hash; zero for others."""
        out = np.zeros((len(h), len(self.langs)))
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
            found = self.lexicon[at] == h
            out[found] = self.lexicon_scores[at[found]]
        return out


def word_features(w: W.Words, one: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words at ``one``, by word: their places in the weights, and whose they are."""
    starts, lengths = w.starts[one], w.ends[one] - w.starts[one]
    # each word between two spaces
    total = np.concatenate(([0], np.cumsum(lengths + 2)))
    buf = np.full(int(total[-1]) + 3, 32, np.uint64)
    inside = np.repeat(total[:-1] + 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    buf[inside] = w.buf[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
    places, owners = [(h * _MULTIPLY) >> np.uint64(64 - BITS)], [np.arange(len(one))]
    for n in (2, 3, 4):
        count = np.maximum(lengths + 3 - n, 0)
        at = np.repeat(total[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        key = np.full(len(at), n, np.uint64)
        for k in range(n):
            key = key * np.uint64(257) + buf[at + k]
        places.append(W.mix64(key) >> np.uint64(64 - BITS))
        owners.append(np.repeat(np.arange(len(one)), count))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(places)[order].astype(np.int64), owner[order]


def forward_backward(emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The probabilities (words, langs) of each word's language.  emit and move: not logarithms; first: n+1 offsets of the documents.

    Blocks of BLOCK words: their transfer matrices in parallel, then the documents' chains of blocks, then all words."""
    k = move.shape[0]
    n = np.diff(first)
    per = -(-n // BLOCK)
    blocks = int(per.sum())
    if not blocks:
        return np.zeros((0, k))
    head = np.concatenate(([0], np.cumsum(per)))
    start = np.repeat(first[:-1], per) + BLOCK * (np.arange(blocks) - np.repeat(head[:-1], per))
    size = np.minimum(BLOCK, np.repeat(first[1:], per) - start)
    order = np.argsort(-size, kind="stable")  # full blocks first, so that step t is a prefix
    live = [int((size >= t + 1).sum()) for t in range(int(size.max()))]
    e = np.ones((len(live), blocks, k))
    for t, m in enumerate(live):
        e[t, :m] = emit[start[order[:m]] + t]
    transfer = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t, m in enumerate(live):
        x = (transfer[:m].reshape(-1, k) @ move).reshape(m, k, k) * e[t, :m, None, :]
        transfer[:m] = x / x.sum((1, 2), keepdims=True)
    own = np.empty_like(transfer)
    own[order] = transfer
    before, after = np.full((blocks, k), 1.0 / k), np.full((blocks, k), 1.0)
    for j in range(1, int(per.max())):
        d = np.flatnonzero(per > j)
        b = head[d] + j
        x = np.einsum("bi,bij->bj", before[b - 1], own[b - 1])
        before[b] = x / x.sum(1, keepdims=True)
        b = head[d + 1] - 1 - j
        x = np.einsum("bij,bj->bi", own[b + 1], after[b + 1])
        after[b] = x / x.sum(1, keepdims=True)
    out = np.empty_like(emit)
    a, b = before[order], after[order]
    ahead = []
    for t, m in enumerate(live):
        x = (a[:m] @ move) * e[t, :m]
        a[:m] = x / x.sum(1, keepdims=True)
        ahead.append(a[:m].copy())
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        x = ahead[t] * b[:m]
        out[start[order[:m]] + t] = x / x.sum(1, keepdims=True)
        x = (b[:m] * e[t, :m]) @ move.T
        b[:m] = x / x.sum(1, keepdims=True)
    return out


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """A model from whole texts and their languages."""
    langs = sorted(set(labels))
    k = len(langs)
    empty = np.zeros(0, np.uint64)
    model = Model(langs, np.zeros((1 << BITS, k)), np.zeros((k, k)), empty, np.zeros((0, k)), np.ones(k))
    w = W.cut(pa.array(texts, pa.string()), lower=True)
    h = w.hashes()
    if k < 2 or not len(h):
        return model
    rng = np.random.default_rng(seed)
    label = np.repeat(np.array([langs.index(x) for x in labels]), np.diff(w.first))
    distinct, one, which, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    by = np.stack([np.bincount(which[label == c], minlength=len(distinct)) for c in range(k)], 1) + 0.0
    top = np.sort(np.argsort(-count, kind="stable")[:LEXICON])
    top = top[count[top] > 1]
    model.lexicon = distinct[top]
    share = (by[top] + 0.5) / (by.sum(0) + 0.5 * len(distinct))
    model.lexicon_scores = np.clip(np.log(share) - np.log(share.mean(1, keepdims=True)), -3, 3)
    at, owner = word_features(w, one, distinct)
    edges = np.searchsorted(owner, np.arange(len(one) + 1))
    # code-switched sequences: runs of the texts, shuffled
    runs, place = [], 0
    while place < len(h):
        to = min(place + int(rng.integers(*RUN)), len(h))
        runs.append(np.arange(place, to))
        place = to
    stream = np.concatenate([runs[i] for i in rng.permutation(len(runs))])
    stream = stream[: len(stream) // SEQUENCE * SEQUENCE].reshape(-1, SEQUENCE) if len(stream) >= SEQUENCE else stream.reshape(1, -1)
    squares = [np.full(model.weights.shape, 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)]
    known = model.known(distinct)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(stream)), max(1, len(stream) // BATCH)):
            part = stream[rows]
            m, n = part.shape
            used, inverse = np.unique(which[part], return_inverse=True)
            inverse = inverse.reshape(m, n)
            lengths = edges[used + 1] - edges[used]
            take = np.repeat(edges[used] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            score = np.add.reduceat(model.weights[at[take]], np.cumsum(lengths) - lengths, axis=0) + model.trust * known[used]
            e = np.exp(score - score.max(1, keepdims=True))[inverse]
            move = np.exp(model.transitions)
            a, b = np.empty((n, m, k)), np.ones((n, m, k))
            x = np.full((m, k), 1.0 / k)
            for t in range(n):
                x = (x @ move) * e[:, t]
                x /= x.sum(1, keepdims=True)
                a[t] = x
            for t in range(n - 2, -1, -1):
                x = (b[t + 1] * e[:, t + 1]) @ move.T
                b[t] = x / x.sum(1, keepdims=True)
            post = a * b
            post /= post.sum(2, keepdims=True)
            pair = a[:-1, :, :, None] * move * (e.transpose(1, 0, 2)[1:] * b[1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            truth = label[part].T
            error = post.transpose(1, 0, 2).copy()
            np.put_along_axis(error, label[part][:, :, None], np.take_along_axis(error, label[part][:, :, None], 2) - 1, 2)
            by_word = np.stack([np.bincount(inverse.ravel(), error[:, :, c].ravel(), len(used)) for c in range(k)], 1)
            spread = np.repeat(by_word, lengths, axis=0)
            g = np.stack([np.bincount(at[take], spread[:, c], 1 << BITS) for c in range(k)], 1)
            gt = pair.sum((0, 1))
            np.add.at(gt, (truth[:-1].ravel(), truth[1:].ravel()), -1)
            for value, grad, square in ((model.weights, g, squares[0]), (model.transitions, gt, squares[1]), (model.trust, (by_word * known[used]).sum(0), squares[2])):
                square += grad * grad
                value -= RATE * grad / np.sqrt(square)
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` documents of each language of docs (doc_id, text, lang)."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    share = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("c"))
    place = (F.xxhash64("doc_id", "lang").cast("double") + 2.0**63) / 2.0**64
    # about three times the sample by hash first, so that no language's rows meet in one task
    some = rows.join(F.broadcast(share), "lang").where(place * F.col("c") <= 3 * sample + 50)
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))).where(F.col("nth") <= sample)
    chosen = F.broadcast(some.select("doc_id", "lang").distinct())
    got = docs.where("text IS NOT NULL").select("doc_id", "text", "lang").join(chosen, ["doc_id", "lang"]).orderBy("doc_id", "lang", "text").select("text", "lang").toArrow()
    return train(got.column("text").to_pylist(), got.column("lang").to_pylist())


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def label(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred and score of every row; spans: also its runs of words of one language (start, length, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"])
        move = np.exp(m.transitions)
        k = len(m.langs)
        for s in W.slices(batches):
            letters = s.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            w = W.cut(s.column("text"), lower=True)
            n = np.diff(w.first)
            best, score, post = np.full(len(n), k), np.zeros(len(n)), np.zeros((0, max(k, 1)))
            if k and len(w.starts):
                h = w.hashes()
                distinct, one, which = np.unique(h, return_index=True, return_inverse=True)
                x = m.emissions(w, one, distinct)
                post = forward_backward(np.exp(x - x.max(1, keepdims=True))[which], move, w.first)
                mean = np.diff(np.concatenate((np.zeros((1, k)), np.cumsum(post, 0)))[w.first], axis=0) / np.maximum(n, 1)[:, None]
                use = letters & (n > 0)
                best[use], score[use] = mean.argmax(1)[use], np.clip(mean.max(1)[use], 0.0, 1.0)
            columns = [s.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score)]
            if spans:
                word = post.argmax(1) if len(post) else np.zeros(0, np.int64)
                rows = []
                for d, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    if best[d] == k or a == b:
                        rows.append([])
                        continue
                    cuts = np.concatenate(([a], a + 1 + np.flatnonzero(word[a + 1 : b] != word[a : b - 1]), [b])).tolist()
                    rows.append([{"start": x - a, "length": y - x, "lang": m.langs[word[x]]} for x, y in zip(cuts, cuts[1:])])
                columns.append(pa.array(rows, pa.list_(span)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), has_letter(F.col("text")).alias("letters"))
    more = ", spans array<struct<start:long,length:long,lang:string>>" if spans else ""
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double{more}")
