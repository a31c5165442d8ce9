"""Vectorised word handling over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D (``[^\\x20\\x09-\\x0D]+``).  UTF-8 never
uses those bytes inside a longer character, so cutting bytes and cutting characters agree.

Everything here works on slices of bounded size (``SLICE_BYTES`` of text, at least one document), so the
memory of a Python worker does not depend on the size of an Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 3 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANE = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xD1342543DE82EF95)
#: Longer words are hashed one at a time.
LONG = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of some documents: word i is ``buf[starts[i]:ends[i]]``; document d has words first[d]:first[d+1]."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def lanes(self) -> np.ndarray:
        """The eight bytes at each place of buf as one number; zeros follow the end."""
        wide = np.concatenate((self.buf, np.zeros(8, np.uint8)))
        return np.ndarray(len(self.buf) + 1, "<u8", wide.data, 0, (1,))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every process."""
        return self.hashed()[0]

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each word's bytes.

        Eight bytes a step, each step of the first mixed, so no kind of word collides more than chance has it."""
        lengths = self.ends - self.starts
        out = mix64(lengths.astype(np.uint64) * _LANE)
        two = lengths.astype(np.uint64)
        if not len(out):
            return out, two
        lanes, at, k = self.lanes(), np.flatnonzero(lengths <= LONG), 0
        while len(at):
            x, left = lanes[self.starts[at] + 8 * k], lengths[at] - 8 * k
            short = np.flatnonzero(left < 8)
            x[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
            out[at] = mix64((out[at] ^ x) * _LANE)
            two[at] = two[at] * _SECOND + x
            k += 1
            at = at[left > 8]
        for i in np.flatnonzero(lengths > LONG).tolist():
            digest = hashlib.blake2b(self.buf[self.starts[i] : self.ends[i]].tobytes(), digest_size=16).digest()
            out[i], two[i] = np.frombuffer(digest, "<u8")
        return out, two


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n+1 offsets; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()) if not pa.types.is_binary(column.type) else column, np.int32
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = string_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def cut(column: pa.Array, lower: bool = False) -> Words:
    """The words of each string; lower: with A-Z as a-z."""
    buf, offsets = string_bytes(column)
    if lower:
        buf = _LOWER[buf]
    n = len(buf)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(buf, empty, empty, np.zeros(len(offsets), np.int64))
    space = _SPACE[buf]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, offsets))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words that start at each word; the last n-1 entries are not windows of n words."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        out[: len(hashes) - k] += hashes[k:] * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1) ** 3 | 1) & (2**64 - 1))
    return mix64(out)
