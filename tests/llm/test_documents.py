"""Operators on documents against brute force: quality rules, line dedup, substring dedup, the Jaccard join."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from quadmill.llm import jaccard, line_dedup, quality_rules, substrings
from quadmill.llm.shared import Scope

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "one", "a b c", "a b c d e f g h i j k l m n o p", "x " * 3000, "é ñ\x0bü\x0cß 漢字\xa0z", "l1 a\nl2 b\n\nl1 a\nl2 b\nl3", "A B C D E", "a b c d e"]


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """Texts with copies, near copies, shared lines and passages; some rows repeat, one has no id."""
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and to in a is that".split()) if rng.random() < 0.3 else "w%d" % rng.randrange(4000)
    line = lambda k: " ".join(word() for _ in range(k))
    passage, common = line(40), [line(9) for _ in range(4)]
    texts = list(ODD)
    base = line(120)
    for i in range(n):
        lines = [line(rng.randint(1, 14)) for _ in range(rng.randint(1, 9))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), common[0])
        if i % 4 == 0:
            k = rng.randrange(len(lines) + 1)
            lines[k:k] = common[1:3]
        if i % 5 == 0:
            lines.append(passage)
        text = "\n".join(lines)
        if i % 6 == 0:
            words = base.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        if i % 11 == 0 and texts[-1]:
            text = texts[-1]
        texts.append(text)
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(d, t, "clash", 1, 2.0) for d, t in zip(order, texts)]
    return [*rows, rows[-1], rows[20], (None, "no id " * 30, "clash", 1, 2.0), (None, None, "clash", 1, 2.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, score double")


def repeats(words: list[str]) -> int:
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)})


def test_quality_rules(spark):
    rows = corpus(1)
    docs = frame(spark, rows)
    trusted = spark.createDataFrame([(d,) for d in range(0, 60, 2)] + [(None,), (4,)], "doc_id long")
    buckets = quality_rules.BUCKETS
    got = quality_rules.judge(docs, trusted).collect()
    assert len(got) == len(rows)
    good, raw = Counter(), Counter()
    grams = lambda t: [x for w in [WORD.findall(t or "")] for x in [*[(a,) for a in w], *zip(w, [*w[1:], ""])]]
    for d, t, *_ in rows:
        for g in grams(t):
            raw[g] += 1
            good[g] += d is not None and d % 2 == 0 and d < 60
    hashed = {}
    all_grams = list(raw)
    flat = spark.createDataFrame([(i, *g, *[None] * (2 - len(g))) for i, g in enumerate(all_grams)], "i long, a string, b string")
    for r in flat.selectExpr("i", f"pmod(CASE WHEN b IS NULL THEN xxhash64(a) ELSE xxhash64(a, b) END, {buckets}) AS h").collect():
        hashed[all_grams[r.i]] = r.h
    g_by, r_by = Counter(), Counter()
    for g in all_grams:
        g_by[hashed[g]] += good[g]
        r_by[hashed[g]] += raw[g]
    share = sum(good.values()) / sum(raw.values())
    ratio = {h: round(math.log((g_by[h] + quality_rules.PSEUDO) / (r_by[h] * share + quality_rules.PSEUDO)) * quality_rules.SCALE) for h in r_by}
    expected = Counter()
    for d, t, *_ in rows:
        w, g = WORD.findall(t or ""), grams(t)
        n = repeats(w)
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * n > 30 * len(w)
        score = sum(ratio[hashed[x]] for x in g) / len(g) / quality_rules.SCALE if g else 0.0
        expected[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), n, failed, round(score, 5), not failed and score >= quality_rules.LEAST_SCORE] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.score, 5), r.kept) for r in got) == expected


def test_buckets_grow_with_the_corpus(spark):
    from pyspark.sql import functions as F

    assert quality_rules.BUCKETS >= 1 << 18
    docs = frame(spark, corpus(1))
    assert quality_rules.buckets_for(docs) == quality_rules.buckets_for(docs.limit(0)) == quality_rules.BUCKETS
    words = quality_rules.BUCKETS * quality_rules.LOAD // 2
    one = spark.range(1).select("id", F.repeat(F.lit("a "), words).alias("text"))
    assert quality_rules.buckets_for(one) == quality_rules.BUCKETS
    assert quality_rules.buckets_for(one.withColumn("text", F.concat("text", F.lit("b")))) == 2 * quality_rules.BUCKETS


def test_scores_with_a_shuffled_table(spark):
    docs = frame(spark, corpus(1)).where("doc_id IS NOT NULL")
    trusted = docs.where("doc_id % 2 = 0").select("doc_id").distinct()
    table = quality_rules.ratios(docs, trusted, Scope(spark), 1 << 12)
    found = lambda n: sorted(tuple(r) for r in quality_rules.scores(docs, table, 1 << 12, n).collect())
    assert found(1 << 12) == found(1 << 6) == found(1) and any(r[2] for r in found(1))


def test_dense_tables_give_the_scores_of_joined_ones(spark, monkeypatch):
    docs = frame(spark, corpus(1))
    trusted = spark.createDataFrame([(d,) for d in range(0, 60, 2)] + [(None,), (4,)], "doc_id long")
    found = lambda **k: sorted(map(str, quality_rules.judge(docs, trusted, **k).collect()))
    assert found(buckets=1 << 12, dense=1) == found(buckets=1 << 12)
    monkeypatch.setattr(quality_rules, "PART", 1 << 9)
    assert found(buckets=1 << 12, dense=1) == found(buckets=1 << 12)


def test_quality_rules_without_trust_or_rows(spark):
    docs = frame(spark, [(1, "word " * 5 + " ".join(map(str, range(30))), "x", 1, 1.0)])
    none = spark.createDataFrame([], "doc_id long")
    assert [(r.kept, r.score) for r in quality_rules.judge(docs, none).collect()] == [(True, 0.0)]
    assert quality_rules.judge(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup(spark, least):
    rows = corpus(2)
    got = Counter((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup(frame(spark, rows).drop("kept"), least).collect())
    first = {}
    held = lambda t: [i for i, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        at = held(t)
        if d is not None:
            for k in range(len(at) - least + 1):
                key = tuple(lines[i] for i in at[k : k + least])
                first[key] = min(first.get(key, (d, k)), (d, k))
    expected = Counter()
    for d, t, *_ in rows:
        lines, at, gone = (t or "").split("\n"), held(t), set()
        if d is not None:
            for k in range(len(at) - least + 1):
                if first[tuple(lines[i] for i in at[k : k + least])] < (d, k):
                    gone |= set(at[k : k + least])
        expected[d, t if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)] += 1
    assert got == expected


@pytest.mark.parametrize("frequent", [4096, 3])
def test_substrings(spark, frequent):
    rows = corpus(3)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept if r.kept is not None else None, r.words_sha256) for r in substrings.dedup(frame(spark, rows), frequent=frequent).collect())
    first = {}
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12):
            if d is not None:
                first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), d), d)
    expected = Counter()
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = {i + k for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for k in range(13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else None
        expected[d, len(w), len(gone), kept, hashlib.sha256(" ".join(w).encode()).hexdigest()] += 1
    assert got == expected and any(k[2] for k in expected)
    assert substrings.dedup(frame(spark, rows[:1]).limit(0)).count() == 0


def ids_with_two_texts():
    run = "first line\nsecond line"
    many = " ".join(f"w{i}" for i in range(20))
    return [(1, f"{run}\n{many}"), (2, "short\nthis stays\nand this"), (2, f"own\nmore\nyet more\n{run}"), (3, f"{many} a b"), (3, f"x y z {many}"), (3, "c d"), (3, "e " * 15 + many), (4, "c d")]


def test_line_dedup_of_ids_with_two_texts(spark):
    docs = spark.createDataFrame(ids_with_two_texts(), "doc_id long, text string")
    got = sorted((r.text, r.n_removed) for r in line_dedup.dedup(docs).where("doc_id = 2").collect())
    assert got == [("own\nmore\nyet more", 2), ("short\nthis stays\nand this", 0)]


def test_maximal_runs_of_lines(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\n\nd\ny\na\nb"), (3, "q\nb\nc\nd\ne\nb\nc"), (3, "z\nx\nb"), (None, "a\nb"), (4, None)]
    docs = spark.createDataFrame([(*r, "p", "q") for r in rows], "doc_id long, text string, _held string, _places string")
    with Scope(spark) as scope:
        runs = line_dedup.repeated_runs(docs, 2, scope)
        got = sorted((r.doc_id, r.k, r.length, r.first_doc_id, r.first_k) for r in runs.collect())
    assert got == [(2, 1, 3, 1, 1), (2, 5, 2, 1, 0), (3, 1, 2, 2, 0), (3, 1, 4, 1, 1), (3, 5, 2, 1, 1)]
    done = line_dedup.dedup(docs)
    assert done.columns == ["doc_id", "text", "_held", "_places", "n_lines", "n_removed"]
    texts = {(r.doc_id, r.text, r._held, r._places) for r in done.collect()}
    assert texts == {(1, rows[0][1], "p", "q"), (2, "x\n\ny", "p", "q"), (3, "q", "p", "q"), (3, "z", "p", "q"), (None, "a\nb", "p", "q"), (4, None, "p", "q")}


def test_equal_text_has_a_place_of_its_own_in_no_other_row(spark):
    rows = [(7, "one a\ntwo b\nthree c"), (7, "one a\ntwo b\nother d"), (7, "one a\ntwo b\nthree c")]
    got = [r.text.split("\n") for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    lines = {x for t in got for x in t}
    assert lines == {"one a", "two b", "three c", "other d"} and sum(len(t) == 3 for t in got) in (1, 2)


def test_words_that_a_polynomial_hash_takes_for_one(spark):
    import numpy as np
    import pyarrow as pa

    from quadmill.llm import words as W

    word = lambda n, flip: "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))
    for n in (64, 256, 1024, 4096):
        h = W.cut(pa.array([word(n, 0), word(n, 1), word(n, 0)])).hashes()
        assert h[0] == h[2] != h[1] and len(np.unique(h)) == 2
    one, two = word(1024, 0), word(1024, 1)
    rest = " ".join(f"v{i}" for i in range(20))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, " ".join([one] * 13)), (4, " ".join([two] * 13))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in substrings.dedup(docs).collect()}
    assert got == {1: (0, None), 2: (20, two), 3: (0, None), 4: (0, None)}
    assert {r.doc_id: r.component_id for r in jaccard.similar(docs.where("doc_id > 2"), 4, 85).collect()} == {3: 3, 4: 4}


def test_identities_that_clash():
    import numpy as np

    from quadmill.llm import shingles as S

    sets, at = np.array([1, 2, 3, 4, 5], np.uint64), np.array([0, 2, 5])
    one, two = S.set_ids(sets, at)
    assert jaccard.identities(sets, at, one[:1]).tolist() == [two[0], one[1]]
    h, first = np.arange(1, 30, dtype=np.uint64), np.array([0, 10, 10, 29])
    own = substrings.sequence_ids(h, first)
    other = substrings.sequence_ids(h, first, own[:1])
    assert other[0] != own[0] and other[1] == own[1] == 0 and other[2] == own[2]


def test_substrings_of_ids_with_two_texts(spark):
    docs = spark.createDataFrame(ids_with_two_texts(), "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed, r.kept) for r in substrings.dedup(docs).where("doc_id = 3").collect())
    assert [x[:2] for x in got] == [(2, 0), (22, 20), (23, 20), (35, 20)]
    assert [x[2] for x in got[1:]] == ["a b", "x y z", " ".join("e" * 15)]


def test_automaton():
    rng = random.Random(4)
    for _ in range(60):
        strings = [[rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(5)]
        a = substrings.Automaton()
        for label, s in enumerate(strings):
            a.add(s, label)
        query = [rng.randrange(4) for _ in range(15)]
        lengths, labels = a.statistics(query, 4)
        inside = lambda x, s: any(s[i : i + len(x)] == x for i in range(len(s) - len(x) + 1))
        for i in range(len(query)):
            n = max(k for k in range(min(4, i + 1) + 1) if k == 0 or any(inside(query[i - k + 1 : i + 1], s) for s in strings))
            assert lengths[i] == n
            if n:
                assert labels[i] == min(j for j, s in enumerate(strings) if inside(query[i - n + 1 : i + 1], s))


def brute_components(rows, shingle, percent):
    sets = defaultdict(list)
    for d, t, *_ in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d].append(frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else []))
    ids = [d for d in sets if d is not None]
    top = {d: d for d in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = find(x), find(y)
                top[max(a, b)] = min(a, b)
    return Counter((d, len(s), None if d is None else find(d)) for d, own in sets.items() for s in own)


@pytest.mark.parametrize("heavy", [None, 0, 12])
def test_jaccard(spark, monkeypatch, heavy):
    rows = corpus(5, 90)
    rows += [(500, rows[12][1] + " x", "clash", 1, 2.0), (500, "quite another text " * 3, "clash", 1, 2.0), (501, "quite another text " * 3, "clash", 1, 2.0)]
    if heavy is not None:
        monkeypatch.setattr(jaccard, "NEAREST", 1)
        monkeypatch.setattr(jaccard, "boundary", lambda *_: heavy)
        monkeypatch.setattr(jaccard, "BLOCK", 4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(frame(spark, rows), 4, 85).collect())
    expected = brute_components(rows, 4, 85)
    assert got == expected
    assert len({k[2] for k in expected}) < len(expected) - 5


def test_jaccard_of_nothing(spark):
    assert jaccard.similar(frame(spark, [(1, "x", "x", 1, 1.0)]).limit(0)).count() == 0
