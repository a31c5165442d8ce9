"""Learned operators: held-out accuracy, and the parts of the methods against slow versions."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from quadmill.llm import classifier, language, neighbours
from quadmill.llm import words as W
from quadmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_classifier_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op3_quality_classifier"](spark, SF).collect()
    assert len(rows) == 1000
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 40 and sum(p == q for p, q in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_ftrl_learns_and_ignores_order_of_nothing():
    rng = random.Random(1)
    good = [" ".join(rng.choice("the of and to".split()) for _ in range(30)) for _ in range(60)]
    bad = [x.replace(" ", "*** ") for x in good]
    w = classifier.train(good + bad, [1] * 60 + [0] * 60)
    found, at = classifier.features(pa.array([good[0], bad[0], "", None], pa.string()))
    logit = [classifier.SCALE * w[found[a:b]].sum() / max(b - a, 1) + w[-1] for a, b in zip(at, at[1:])]
    assert logit[0] > 1 > -1 > logit[1] and logit[2] == logit[3] == w[-1]
    assert not classifier.train([], []).any()


def test_classifier_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 5.0), (None, None, 1.0), (2, "", 1.0), (2, "", 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, label int")
    rows = classifier.score(docs, classifier.fit(docs, none)).collect()
    assert [r.score for r in rows] == [0.5] * 4
    assert classifier.score(docs.limit(0), classifier.fit(docs, none)).count() == 0


def test_language_on_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op5_language"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def slow_posteriors(e, move):
    """By enumeration of all label sequences; a uniform start, then a transition into the first word."""
    n, k = e.shape
    post = np.zeros((n, k))
    start = np.full(k, 1 / k) @ move
    for labels in itertools.product(range(k), repeat=n):
        p = start[labels[0]] * e[0, labels[0]]
        for t in range(1, n):
            p *= move[labels[t - 1], labels[t]] * e[t, labels[t]]
        for t, c in enumerate(labels):
            post[t, c] += p
    return post / post.sum(1, keepdims=True)


def test_forward_backward(monkeypatch):
    rng = np.random.default_rng(3)
    move = rng.random((3, 3)) + 0.1
    first = np.array([0, 7, 7, 8, 12])
    e = rng.random((12, 3)) + 0.01
    want = np.concatenate([slow_posteriors(e[a:b], move) for a, b in zip(first, first[1:]) if b > a])
    for block in (1, 2, 3, 64):
        monkeypatch.setattr(language, "BLOCK", block)
        assert np.allclose(language.forward_backward(e, move, first), want)


def test_language_of_code_switched_text(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("lang IN ('en', 'de') AND n_chars BETWEEN 400 AND 3000").orderBy("doc_id").select("text", "lang").limit(140).collect()
    model = language.train([r.text for r in rows[:100]], [r.lang for r in rows[:100]])
    en, de = (next(r.text for r in rows[100:] if r.lang == x).split()[:30] for x in ("en", "de"))
    docs = spark.createDataFrame([(1, " ".join(en + de), "x"), (2, None, "x"), (None, "123 !", "x"), (4, "", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language.label(docs, model).collect()}
    words = [s.lang for s in got[1].spans for _ in range(s.length)]
    assert len(words) == 60 and sum(a == b for a, b in zip(words, ["en"] * 30 + ["de"] * 30)) >= 52
    assert [(got[d].lang_pred, got[d].score, got[d].spans) for d in (2, None, 4)] == [("und", 0.0, [])] * 3
    empty = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.label(docs, empty).collect()} == {"und"}


def exact(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, v in ok:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in ok if j != i)[:k]
            out[i] = near
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8) + 3 * (i % 5)]) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 8) for i in range(300)]  # one frequent vector
    rows += [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] * 8), (5300, [float("inf")] + [1.0] * 7), (5400, [None] + [1.0] * 7), (5500, [1.0] * 3), (None, [1.0] * 8)]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, query_id string")
    got = {}
    from pyspark.sql import functions as F

    for r in neighbours.k_nearest(docs, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    want = exact(rows, 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, near in want.items():
        found = [got[q][k] for k in range(1, 11)]
        assert found == sorted(found) and q not in [j for _, j in found]
        hits += len({j for _, j in found} & {j for _, j in near})
    assert hits / (10 * len(want)) >= 0.95
    assert [j for _, j in (got[2000][k] for k in range(1, 11))] == list(range(2001, 2011))  # ties by vec_id
    few = docs.where("vec_id IN (0, 1, 2)")
    assert neighbours.k_nearest(few, F.col("vec_id") % 100 == 0).count() == 2
    assert neighbours.k_nearest(docs.limit(0), F.lit(True)).count() == 0


def test_neighbours_in_a_large_group_of_near_copies(spark):
    """Near copies share a code, so that their asymmetric distances are one tie."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x[rng.permutation(6000)[:900]] = x[0] + 1e-3 * rng.normal(size=(900, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = [i for i in range(6000) if np.abs(x[i] - x[0]).max() < 0.01][:40]
    got = {}
    for r in neighbours.k_nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(queries)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in queries:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / (10 * len(queries)) >= 0.95


def test_search_of_a_block_is_exact():
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.normal(size=(700, 16)), np.ones(16) + 1e-4 * rng.normal(size=(800, 16))))
    index = neighbours.train(x[:700], 1)  # so that the copies have one code
    at, codes = index.encode(x)
    ids = np.arange(len(x))
    for q, near, score in neighbours.search(index, 0, codes, x, ids, x[::50], ids[::50], 10):
        d = np.sqrt(((x - x[50 * q]) ** 2).sum(1))
        d[50 * q] = np.inf
        want = np.lexsort((ids, d))[:10]
        assert near.tolist() == want.tolist() and np.allclose(score, d[want])


@pytest.mark.parametrize("n", [1, 5, 40])
def test_best(n):
    d = np.array([3, 1, 2, 1, 1, 5] * 7, float)[:40]
    assert sorted(neighbours.best(d, n).tolist()) == sorted(np.argsort(d, kind="stable")[:n].tolist())


def test_words():
    texts = ["", None, " a", "b ", "A\tbé\n\x0bc", "x" * 70]
    w = W.cut(pa.array(texts, pa.string()), lower=True)
    got = [[w.buf[a:b].tobytes().decode() for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert got == [[], [], ["a"], ["b"], ["a", "bé", "c"], ["x" * 70]]
    same = W.cut(pa.array(["q x" + "y" * 5 + " é", "x" + "y" * 5 + " é"], pa.string()))
    h = same.hashes()
    assert h[1] == h[3] and h[2] == h[4] and len(set(h.tolist())) == 3
    assert [s.num_rows for s in W.slices([pa.RecordBatch.from_pydict({"text": ["aaaa", "b", "c", None, "dddddd"]})], limit=4)] == [1, 3, 1]
