"""Substring dedup: suffix automata of reference shards tell, for each run of words, the first document that holds it.

A window is ``window`` consecutive words; a word goes if a window over it also starts in a document with a smaller
doc_id.  The reference is the corpus itself, so its automata are sharded and each shard is sent only to where it can
match, as sending every shard everywhere would grow with the square of the corpus:

1. Every window has a *minimizer*, its 5-word run of least hash; equal windows have equal minimizers.  Minimizers held
   by one text only (most of them) are dropped.
2. What is left of a text is cut into segments, the runs of windows that share a minimizer; the minimizer gives the
   shard.  Windows of a minimizer that very many texts hold (a frequent line, say) are keyed by all their words instead,
   and dropped if only one text holds them, so no shard grows with the frequency of a line.
3. A shard's *distinct* segments become one generalised suffix automaton, in the order of their first documents; each
   state keeps the first document of its strings.  The segments are streamed through it (matching statistics, cut
   to the window's length), and every window gets its first document.
4. Segments of documents join their windows' first documents by content; windows whose first is smaller than the
   document's mark their words, and marked words make maximal spans, which are removed.

Texts with equal words are one text from the start, of the smallest doc_id; the copies lose all words if they have a
window.

Odd cases: a null text has no words; a row with null doc_id is returned unchanged and is no reference; rows that repeat
a doc_id do not remove from each other; texts shorter than a window stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadmill.llm import words as W
from quadmill.llm.routing import BUCKET_ROWS, shared_keys
from quadmill.llm.shared import Scope

WINDOW = 13
#: Words of a minimizer.
ANCHOR = 5
#: Texts beyond which a minimizer's windows are keyed by all their words.
FREQUENT = 4096
#: Segments that a shard is planned to hold.
SHARD_SEGMENTS = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_CONTENT = np.uint64(0x2545F4914F6CDD1D)
_PLACE = np.uint64(0x8CB92BA72F3D8DD7)


def sequence_ids(h: np.ndarray, first: np.ndarray, clashing: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit identity of each document's word sequence (0 without words).  Those of ``clashing``, which different
    sequences share, are replaced by others."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        inside = (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(np.uint64)
        out[full] = W.mix64(np.add.reduceat(W.mix64(h + inside * _PLACE), first[:-1][full]) + n[full].astype(np.uint64))
        if clashing is not None and (again := np.isin(out, clashing) & (n > 0)).any():
            other = W.mix64(np.add.reduceat(W.mix64((h ^ _CONTENT) + inside * _PLACE), first[:-1][full]))
            out[full] = np.where(again[full], other, out[full])
    return out


def minimizers(h: np.ndarray, window: int, anchor: int = ANCHOR) -> np.ndarray:
    """The minimizer of the window that starts at each word (windows that end behind the words are not valid)."""
    low = W.ngrams(h, anchor)
    span, done = window - anchor + 1, 1
    while done < span:
        step = min(done, span - done)
        low[: len(low) - step] = np.minimum(low[: len(low) - step], low[step:])
        done += step
    return low


class Automaton:
    """A generalised suffix automaton over integers; first[s]: the least label of the strings of state s."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def add(self, string: list[int], label: int) -> None:
        """Labels must not fall from one string to the next."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for c in string:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                first.append(label)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                last = cur
                if p == -1:
                    continue
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    continue
                link[cur] = self._split(p, c, q)
            else:
                last = self._split(last, c, q)

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings of p followed by c."""
        nxt, link = self.next, self.link
        copy = len(nxt)
        nxt.append(nxt[q].copy())
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.first.append(self.first[q])
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def statistics(self, string: list[int], most: int) -> tuple[list[int], list[int]]:
        """For each place, the longest suffix there that the automaton holds (at most ``most``), and its label."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        s, n, lengths, labels = 0, 0, [], []
        for c in string:
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                n += 1
            while length[link[s]] >= most if s else False:
                s = link[s]
            n = min(n, most)
            lengths.append(n)
            labels.append(first[s])
        return lengths, labels


def summaries(docs: DataFrame, clashing: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_words, seq_id, words_sha256 (of the words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in W.slices(batches):
            w = W.cut(s.column("text"))
            buf, at = W.string_bytes(s.column("text"))
            data = buf.tobytes()
            digests = [hashlib.sha256(b" ".join(data[a:b].split())).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            ids = sequence_ids(w.hashes(), w.first, clashing).view(np.int64)
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(np.diff(w.first)), pa.array(ids), pa.array(digests)], ["doc_id", "n_words", "seq_id", "words_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_words long, seq_id long, words_sha256 string")


def _valid(first: np.ndarray, window: int, total: int) -> np.ndarray:
    """Which words start a window of their document."""
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(total) + window <= ends


def _anchors(window: int, clashing: np.ndarray | None):
    def emit(s: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        w = W.cut(s.column("text"))
        h = w.hashes()
        if not len(h):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        ok = _valid(w.first, window, len(h))
        low = minimizers(h, window)[ok]
        who = np.repeat(sequence_ids(h, w.first, clashing), np.diff(w.first))[ok]
        new = np.concatenate((np.ones(min(len(low), 1), bool), (low[1:] != low[:-1]) | (who[1:] != who[:-1])))
        return low[new], who[new]

    return emit


def _lists(s: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and n+1 offsets; null is empty."""
    lists = s.column(column)
    sizes = np.array(lists.value_lengths().fill_null(0), np.int64)
    return np.asarray(lists.flatten(), np.int64).view(np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def _own(s: pa.RecordBatch, ids: np.ndarray) -> np.ndarray:
    """Which texts are the ones that the row's seq_id means (rows may repeat a doc_id with another text)."""
    return np.asarray(s.column("seq_id"), np.int64).view(np.uint64) == ids


def _frequent_windows(window: int, clashing: np.ndarray | None):
    def emit(s: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        w = W.cut(s.column("text"))
        h = w.hashes()
        grams, low, ids = W.ngrams(h, window), minimizers(h, window), sequence_ids(h, w.first, clashing)
        frequent, at = _lists(s, "frequent")
        keys, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for d in np.flatnonzero(_own(s, ids) & (np.diff(at) > 0)).tolist():
            a, b = w.first[d], w.first[d + 1] - window + 1
            if b > a:
                x = grams[a:b][np.isin(low[a:b], frequent[at[d] : at[d + 1]])]
                keys.append(x)
                who.append(np.full(len(x), ids[d]))
        return np.concatenate(keys), np.concatenate(who)

    return emit


def _segments(window: int, shards: int, clashing: np.ndarray | None):
    """Of each candidate text: shard, content and content2 (its id), words (the bytes), doc_id, seq_id, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in W.slices(batches):
            w = W.cut(s.column("text"))
            h = w.hashes()
            n = len(h)
            grams, low, ids = W.ngrams(h, window), minimizers(h, window), sequence_ids(h, w.first, clashing)
            rare, frequent, repeated = (_lists(s, c) for c in ("rare", "frequent", "repeated"))
            use, single = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
            for d in np.flatnonzero(_own(s, ids)).tolist():
                x = slice(w.first[d], max(w.first[d + 1] - window + 1, w.first[d]))
                keys = [v[at[d] : at[d + 1]] for v, at in (rare, frequent, repeated)]
                if len(keys[0]):
                    use[x] = np.isin(low[x], keys[0])
                if len(keys[1]) and len(keys[2]):
                    single[x] = np.isin(low[x], keys[1]) & np.isin(grams[x], keys[2])
            live = use | single
            key = np.concatenate((np.where(single[:-1], grams, low), [np.uint64(0)]))
            doc = np.repeat(np.arange(s.num_rows), np.diff(w.first))
            new = live.copy()
            new[1:] &= ~live[:-1] | (key[1:] != key[:-1]) | single[1:] | single[:-1]
            begins = w.first[:-1][np.diff(w.first) > 0]
            new[begins] = live[begins]
            i = np.flatnonzero(new)
            stops = np.flatnonzero(new | ~live)
            j = stops[np.searchsorted(stops, i, "right")] if len(i) else i
            last = j + window - 1  # behind the last word
            powers, inverse = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, x)))) for x in (_BASE, _INVERSE))
            contents = []
            for tag in (np.uint64(0), _CONTENT):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix64(h ^ tag) * powers[:n])))
                contents.append(W.mix64((total[last] - total[i]) * inverse[i] + W.mix64(key[i] + (last - i).astype(np.uint64))))
            content, other = contents
            data = w.buf.tobytes()
            words = [data[a:b] for a, b in zip(w.starts[i].tolist(), w.ends[last - 1].tolist())]
            where = pa.array(doc[i])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((key[i] % np.uint64(shards)).astype(np.int64)), pa.array(content.view(np.int64)), pa.array(other.view(np.int64)), pa.array(words, pa.binary()),
                    s.column("doc_id").take(where), s.column("seq_id").take(where), pa.array(i - w.first[doc[i]]),
                ],
                ["shard", "content", "content2", "words", "doc_id", "seq_id", "start"],
            )

    return run


def _first_documents(window: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("content", "ascending")]).combine_chunks()
        w = W.cut(group.column("words").combine_chunks())
        _, names = np.unique(w.hashes(), return_inverse=True)
        strings = [names[a:b].tolist() for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
        automaton = Automaton()
        for string, label in zip(strings, group.column("doc_id").to_pylist()):
            automaton.add(string, label)
        firsts = [automaton.statistics(string, window)[1][window - 1 :] for string in strings]
        return pa.table({"content": group.column("content"), "content2": group.column("content2"), "firsts": pa.array(firsts, pa.list_(pa.int64()))})

    return run


def _without(window: int, clashing: np.ndarray | None):
    """The words of each text that its row's seq_id means that no marked window covers, and the maximal spans of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in W.slices(batches):
            w = W.cut(s.column("text"))
            s = s.filter(pa.array(_own(s, sequence_ids(w.hashes(), w.first, clashing))))
            kept, spans, removed = [], [], []
            for text, starts in zip(s.column("text").to_pylist(), s.column("starts").to_pylist()):
                own = (text or "").encode().split()
                change = np.zeros(len(own) + 1, np.int64)
                at = np.unique(np.array(starts, np.int64))
                change[at] += 1
                change[at + window] -= 1
                gone = np.concatenate(([0], np.cumsum(change)[:-1] > 0, [0])).astype(np.int8)
                edges = np.flatnonzero(np.diff(gone))
                spans.append([{"start": a, "length": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
                left = np.flatnonzero(gone[1:-1] == 0).tolist()
                kept.append(b" ".join([own[i] for i in left]).decode())
                removed.append(len(own) - len(left))
            span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
            yield pa.RecordBatch.from_arrays([s.column("seq_id"), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.string())], ["seq_id", "removed", "spans", "kept"])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, frequent: int = FREQUENT) -> DataFrame:
    """Of every row: doc_id, n_words, n_removed, spans (of removed words), kept (the other words, joined by one space;
    null if nothing is removed) and words_sha256 (of all words, joined so)."""
    with Scope(docs.sparkSession) as scope:
        return scope.leave(scope.keep(_deduplicated(docs, window, frequent, scope), "documents"))


def _deduplicated(docs: DataFrame, window: int, frequent: int, scope: Scope) -> DataFrame:
    keep = scope.keep
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summary = keep(summaries(docs), "sequences")
    both = summary.where("n_words > 0").groupBy("seq_id").agg(F.min("words_sha256").alias("low"), F.max("words_sha256").alias("high"))
    # different texts of one 64-bit hash: none in corpora of less than billions of documents, a few beyond
    if found := [r["seq_id"] for r in both.where("low <> high").select("seq_id").collect()]:
        scope.drop(summary)
        clashing = np.array(found, np.int64).view(np.uint64)
        summary = keep(summaries(docs, clashing), "sequences")
    else:
        clashing = None
    named = docs.where(F.col("doc_id").isNotNull())
    long = summary.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    nodes = keep(long.groupBy("seq_id").agg(F.min("doc_id").alias("first_id"), F.first("n_words").alias("n")), "texts")
    # a minimizer starts every (window - anchor + 2) / 2 words on average
    words = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = keep(shared_keys(named, _anchors(window, clashing), max(1, 2 * words // (window - ANCHOR + 2) // BUCKET_ROWS)), "anchors")
    often = keep(held.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > frequent).select("key", F.lit(True).alias("often")), "often")
    marked = held.join(often, "key", "left").groupBy(F.col("value").alias("seq_id"))
    marked = marked.agg(F.collect_list(F.when(F.col("often").isNull(), F.col("key"))).alias("rare"), F.collect_list(F.when(F.col("often"), F.col("key"))).alias("frequent"))
    wanted = marked.join(nodes.select("seq_id", F.col("first_id").alias("doc_id")), "seq_id")
    texts = keep(named.join(wanted, "doc_id"), "candidates")
    again = shared_keys(texts, _frequent_windows(window, clashing), 64) if not often.isEmpty() else held.limit(0)
    again = again.groupBy(F.col("value").alias("seq_id")).agg(F.collect_list("key").alias("repeated"))
    shards = max(1, held.count() // SHARD_SEGMENTS)
    rows = texts.join(again, "seq_id", "left").mapInArrow(_segments(window, shards, clashing), "shard long, content long, content2 long, words binary, doc_id long, seq_id long, start long")
    rows = keep(rows, "segments")
    distinct = rows.groupBy("shard", "content", "content2").agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words"))
    firsts = keep(distinct.groupBy("shard").applyInArrow(_first_documents(window), "content long, content2 long, firsts array<long>"), "firsts")
    at = rows.drop("words", "shard").join(firsts, ["content", "content2"])
    at = at.withColumn("starts", F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull()))
    starts = at.where(F.size("starts") > 0).groupBy("seq_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    found = texts.select("seq_id", "text", "doc_id").join(starts, "seq_id").dropDuplicates(["seq_id", "text"])
    found = found.mapInArrow(_without(window, clashing), "seq_id long, removed long, spans array<struct<start:long,length:long>>, kept string")
    # texts of the same words may differ in white space
    found = keep(found.dropDuplicates(["seq_id"]), "removed")
    df = summary.join(nodes.select("seq_id", "first_id"), "seq_id", "left").join(found, "seq_id", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    own = F.col("doc_id").isNotNull()
    return df.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(own, F.coalesce("removed", F.lit(0))).otherwise(F.lit(0)).alias("n_removed"),
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length")))).when(own, F.col("spans")).alias("spans"),
        F.when(copy, F.lit("")).when(own, F.col("kept")).alias("kept"),
        "words_sha256",
    )
