"""Harmonic packing of token sequences.

Lengths are sorted into *reciprocal-capacity classes*: class k holds what fits k times into a sequence of
``capacity`` tokens.  As documents may be cut, a document's remainder is cut greedily into pieces of exactly
floor(capacity / k) tokens, the largest first, so every bin of class k is filled with exactly k pieces and wastes
capacity mod floor(capacity / k) tokens at most (a fraction of a percent on average; about three pieces a remainder).

Workers fill their classes' bins independently: each numbers its own pieces in each class as it cuts them, and one
prefix sum over the counts of (class, partition) places every piece; pieces never move to be packed.  What does not
fill a last bin (less than one bin of each class, a bounded number of pieces for any corpus) is placed first-fit
decreasing; that plan needs only the classes' counts.

Results for the odd cases: a null or empty text is a document of one token (the end token); a null doc_id stays null
and its document is packed like any other; repeated rows are packed once per row; an empty table gives no rows.
Columns of the input other than doc_id and text are not read, so no name can clash.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadmill.llm import words as W
from quadmill.llm.shared import keep

#: Entries of a worker's word cache; beyond, it starts anew.
CACHE_WORDS = 700_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:127] = ~_LETTER[33:127]
_PUNCTUATION[48:58] = False

_CACHES: dict[str, "WordIds"] = {}


class WordIds:
    """Token ids of words by a tokenizers file, each distinct word encoded once.

    Only for tokenizers whose tokens never span ASCII white space (they drop it before the merges)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def ids_of(self, new: list[str]) -> list[np.ndarray]:
        """The ids of each part.  Parts of plain letters are encoded many to a text, as each ends with a word end."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        plain = [i for i, x in enumerate(new) if x.isascii() and x.isalpha()] if self.ends.any() else []
        out: list[np.ndarray] = [None] * len(new)  # type: ignore[list-item]
        if plain:
            groups = [" ".join([new[i] for i in plain[a : a + 1000]]) for a in range(0, len(plain), 1000)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in encode(groups, add_special_tokens=False)])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(plain):
                for i, x in zip(plain, np.split(ids, cuts)):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, encode([new[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def add(self, new: list[bytes]) -> None:
        ids = self.ids_of([x.decode() for x in new])
        lengths = np.array([len(x) for x in ids], np.int64)
        at = len(self.place)
        self.place.update(zip(new, range(at, at + len(new))))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate([self.flat, *ids])

    def parts(self, column: pa.Array) -> W.Words:
        """The words, cut before ASCII punctuation that follows an ASCII letter (a bound of the tokenizer's pattern,
        wherever it is), and lower-cased where all ASCII.  A text near a special token is left as it is."""
        w = W.cut(column)
        n = len(w.buf)
        high = np.concatenate(([0], np.cumsum(w.buf > 127)))
        mixed = high[w.ends] > high[w.starts]
        inside = np.zeros(n + 1, np.int8)
        inside[w.starts[mixed]] += 1
        inside[w.ends[mixed]] -= 1
        low = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, w.buf, W._LOWER[w.buf])
        data = low.tobytes()
        if any(t in data for t in self.added):
            return w
        edge = np.zeros(n + 1, bool)
        if n:
            edge[1:-1] = _LETTER[low[:-1]] & _PUNCTUATION[low[1:]]
        starts, ends = edge.copy(), edge
        starts[w.starts] = True
        ends[w.ends] = True
        starts = np.flatnonzero(starts)
        return W.Words(low, starts, np.flatnonzero(ends), np.searchsorted(starts, W.string_bytes(column)[1]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and n+1 offsets."""
        w = self.parts(column)
        h, second = w.hashed()
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        other = np.flatnonzero(second != second[one][which])
        if len(other):  # words of one hash are told apart by their bytes
            which[other] = len(one) + np.arange(len(other))
            one = np.concatenate((one, other))
        data = w.buf.tobytes()
        distinct = [data[a:b] for a, b in zip(w.starts[one].tolist(), w.ends[one].tolist())]
        if len(self.place) > CACHE_WORDS:
            self.clear()
        if new := [x for x in dict.fromkeys(distinct) if x not in self.place]:
            self.add(new)
        rows = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[which]
        lengths = self.lengths[rows]
        total = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(self.starts[rows] - total[:-1], lengths) + np.arange(total[-1])
        return self.flat[at], total[w.first]


def class_lengths(capacity: int) -> np.ndarray:
    """The lengths floor(capacity / k), descending."""
    return np.array(sorted({capacity // k for k in range(1, capacity + 1)}, reverse=True), np.int64)


def piece_lengths(length: int, capacity: int, classes: np.ndarray) -> list[int]:
    """How a document of so many tokens is cut."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        fits = int(classes[np.searchsorted(-classes, -rest)])
        out.append(fits)
        rest -= fits
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """The pieces of every document: doc_id, start, length (its class), ids (binary, little-endian uint32; null unless
    with_ids), ids_crc32, doc_tokens; part and nth say which worker cut it and which of that worker's pieces of the class it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _CACHES.get(tokenizer) or _CACHES.setdefault(tokenizer, WordIds(tokenizer))
        classes = class_lengths(capacity)
        seen = np.zeros(capacity + 1, np.int64)
        cuts: dict[int, list[int]] = {}
        part = TaskContext.get().partitionId()
        for s in W.slices(batches):
            ids, first = coder.encode(s.column("text"))
            n = s.num_rows
            tokens = np.diff(first) + 1
            # the end token goes behind each document's ids
            place = np.arange(len(ids)) + np.repeat(np.arange(n), tokens - 1)
            stream = np.full(len(ids) + n, end_id, "<u4")
            stream[place] = ids
            lengths: list[int] = []
            counts = np.zeros(n, np.int64)
            for d, size in enumerate(tokens.tolist()):
                rest = size % capacity
                if rest not in cuts:
                    cuts[rest] = piece_lengths(rest, capacity, classes)
                own = [capacity] * (size // capacity) + cuts[rest]
                counts[d] = len(own)
                lengths += own
            length = np.array(lengths, np.int64)
            ends = np.cumsum(length)
            doc = np.repeat(np.arange(n), counts)
            start = ends - length - np.repeat(np.cumsum(tokens) - tokens, counts)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], np.diff(length[order]) != 0))) if len(order) else order
            size = np.diff(np.concatenate((edges, [len(order)])))
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(order)) - np.repeat(edges, size) + seen[length[order]]
            seen[length[order[edges]]] += size
            data = stream.tobytes()
            at = np.concatenate(([0], ends * 4))
            view = memoryview(data)
            sums = pa.array([zlib.crc32(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())
            blob = pa.nulls(len(length), pa.binary())
            if with_ids:
                blob = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [s.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), blob, sums, pa.array(tokens[doc]), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)],
                ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "part", "nth"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, part int, nth long")


def place_rest(left: list[tuple[int, int]], capacity: int, first_bin: int) -> list[tuple[int, int, int, int]]:
    """First-fit decreasing for (length, count) pairs: (length, t, bin, offset) of the t-th piece of each length."""
    used: list[int] = []
    out = []
    for length, count in sorted(left, reverse=True):
        b = 0
        for t in range(count):
            while b < len(used) and used[b] + length > capacity:
                b += 1
            if b == len(used):
                used.append(0)
            out.append((length, t, first_bin + b, used[b]))
            used[b] += length
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its ids (if with_ids) and its place: sequence_id, and offset from 0 without gaps.

    A sequence holds at most ``capacity`` tokens."""
    spark = docs.sparkSession
    pieces = keep(cut_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = keep(by_part.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "ahead")
    # one row for each class: at most 2 sqrt(capacity) rows for any corpus
    totals = [(r["length"], r["n"]) for r in ahead.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("length")).collect()]
    base, rows, left = 0, [], []
    for length, n in totals:
        k = capacity // length
        rows.append((length, k, n // k * k, base))
        base += n // k
        left.append((length, n % k))
    rest = place_rest(left, capacity, base)
    classes = spark.createDataFrame(rows, "length long, k long, in_full long, base long")
    rest = spark.createDataFrame(rest, "length long, t long, rest_bin long, rest_offset long")
    # classes and rest are bounded by capacity alone; ahead grows with the number of partitions, so its join is left to the optimizer
    at = pieces.join(ahead.drop("n"), ["length", "part"]).withColumn("at", F.col("ahead") + F.col("nth")).drop("ahead", "nth", "part")
    at = at.join(F.broadcast(classes), "length").withColumn("t", F.col("at") - F.col("in_full"))
    at = at.join(F.broadcast(rest), ["length", "t"], "left")
    full = F.col("t") < 0
    return at.select(
        "doc_id", "start", "length", *(["ids"] if with_ids else []), "ids_crc32", "doc_tokens",
        F.when(full, F.col("base") + F.expr("at div k")).otherwise(F.col("rest_bin")).alias("sequence_id"),
        F.when(full, F.expr("at % k") * F.col("length")).otherwise(F.col("rest_offset")).alias("offset"),
    )
