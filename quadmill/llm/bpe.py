"""Byte-pair encoding and decoding.

Encoding: a text is cut at special tokens and by the tokenizer's pattern; in each part the merge of lowest rank is
taken from a priority queue, over symbols in a doubly linked list, entries whose symbols have changed meanwhile being
skipped as stale.  A part of n bytes costs O(n log n), so no text is too long.  Decoding concatenates the vocabulary's
byte strings.

A null text has the ids of an empty one (none) and decodes to "".  Repeated rows stay; an empty table gives no rows.
Other columns are kept as they are, but for columns named like the output, which it replaces.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadmill.llm import words as W

#: Entries of a worker's cache of parts; beyond, it starts anew.
CACHE_PARTS = 500_000
#: Longer parts are not cached.
CACHED_LENGTH = 64

#: Fixed value: the pattern of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_CODERS: dict[str, "ByteBPE"] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary (a tokenizers JSON file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.byte_ids = [vocab[c] for c in chars]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        size = max([*vocab.values(), *added.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.parts = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one part."""
        ids = [self.byte_ids[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(*merges[pair], i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in merges]
        queue = [(rank, i, new, pair) for rank, new, i, pair in queue]
        heapq.heapify(queue)
        while queue:
            _, i, new, pair = heapq.heappop(queue)
            j = right[i]
            if j < 0 or ids[i] != pair[0] or ids[j] != pair[1]:  # stale: a neighbour, or the symbol itself, has merged
                continue
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            right[j] = -1
            if k >= 0:
                left[k] = i
                if (pair := (new, ids[k])) in merges:
                    rank, to = merges[pair]
                    heapq.heappush(queue, (rank, i, to, pair))
            if (h := left[i]) >= 0 and (pair := (ids[h], new)) in merges:
                rank, to = merges[pair]
                heapq.heappush(queue, (rank, h, to, pair))
        return [x for x in ids if x >= 0]

    def encode_part(self, part: str) -> bytes:
        ids = np.array(self.merge(part.encode()), "<u4").tobytes()
        if len(part) <= CACHED_LENGTH:
            if len(self.cache) >= CACHE_PARTS:
                self.cache.clear()
            self.cache[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian uint32."""
        out: list[bytes] = []
        get, encode = self.cache.get, self.encode_part
        for piece in self.special.split(text) if self.special else (text,):
            if piece in self.added:
                out.append(self.added[piece])
            elif piece:
                out += [get(p) or encode(p) for p in self.parts.findall(piece)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def coder(path: str) -> ByteBPE:
    return _CODERS.get(path) or _CODERS.setdefault(path, ByteBPE(path))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column of the text's ids (little-endian uint32), in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for s in W.slices(batches, text):
            at = s.schema.get_field_index(text)
            found = pa.array([c.encode(x or "") for x in s.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(x for i, x in enumerate(s.columns) if i != at), found], [*(x for i, x in enumerate(s.schema.names) if i != at), ids])

    rest = docs.drop(ids) if ids != text else docs
    return rest.mapInArrow(run, _schema(rest, text, f"`{ids}` binary"))


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of their ids beside them; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for s in W.slices(batches, ids):
            found = pa.array([c.decode(x or b"") for x in s.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*s.columns, found], [*s.schema.names, text])

    rest = rows.drop(text)
    return rest.mapInArrow(run, _schema(rest, None, f"`{text}` string"))


def _schema(df: DataFrame, without: str | None, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != without), more])


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the decoded text of every document."""
    return decode(encode(docs.select("doc_id", F.col("text").cast("string").alias("text")), tokenizer), tokenizer)
