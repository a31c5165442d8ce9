"""Numbers sent from map tasks to buckets as packed bytes, and the groups of equal keys found there.

A key's first row of each map batch is routed to the bucket of its key; where a batch holds a key more than once, its
rows are known to share it, and travel spread over all buckets.  So a bucket receives one row of a key for each map
batch at most, however frequent the key, and no task holds a frequent key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadmill.llm import words as W

#: Rows that a map task holds before it packs and sends them; packing takes some hundred bytes a row.
FLUSH = 1 << 18
#: Bytes of text of which signatures are made at a time, as several numbers for each word are.
SLICE_BYTES = 1 << 20
#: Rows that a bucket is planned to receive.
BUCKET_ROWS = 1 << 19


def _packed(bucket: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    data = np.ascontiguousarray(rows[order])
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    ends = [*edges[1:].tolist(), len(bucket)]
    return bucket[edges], [data[a:b].tobytes() for a, b in zip(edges.tolist(), ends)]


def repeated(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, value) rows sorted; which of them begin a key; which belong to a key with two values or more."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    if len(keys):
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])))
        keys, values = keys[new], values[new]
    same = keys[1:] == keys[:-1]
    begins = np.concatenate((np.ones(min(len(keys), 1), bool), ~same))
    shared = np.zeros(len(keys), bool)
    shared[1:] |= same
    shared[:-1] |= same
    return keys, values, begins, shared


def packets(batches: Iterator[pa.RecordBatch], emit: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """What one map task sends: (bucket, first, known), the (key, value) rows that ``emit`` makes of the batches, packed."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def pack() -> pa.RecordBatch:
        keys, values, begins, shared = repeated(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))
        held.clear()
        rows = np.stack((keys, values), 1)
        to, blobs = _packed((keys % np.uint64(buckets)).astype(np.int64)[begins], rows[begins])
        known, others = _packed((W.mix64(keys + values) % np.uint64(buckets)).astype(np.int64)[shared], rows[shared])
        none = [None] * len(blobs), [None] * len(others)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((to, known)).astype(np.int64)), pa.array([*blobs, *none[1]], pa.binary()), pa.array([*none[0], *others], pa.binary())], ["bucket", "first", "known"]
        )

    for s in W.slices(batches, limit=SLICE_BYTES):
        held.append(emit(s))
        if sum(len(k) for k, _ in held) >= FLUSH:
            yield pack()
    if held:
        yield pack()


def shared_keys(docs: DataFrame, emit: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """The distinct (key, value) rows whose key has two values or more, of all that ``emit`` makes of the documents."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packets(batches, emit, buckets)

    def meet(group: pa.Table) -> pa.Table:
        first = np.frombuffer(b"".join(x for x in group.column("first").to_pylist() if x), np.uint64).reshape(-1, 2)
        known = np.frombuffer(b"".join(x for x in group.column("known").to_pylist() if x), np.uint64).reshape(-1, 2)
        keys, values, _, shared = repeated(first[:, 0], first[:, 1])
        keys = np.concatenate((keys[shared], known[:, 0])).view(np.int64)
        values = np.concatenate((values[shared], known[:, 1])).view(np.int64)
        return pa.table({"key": keys, "value": values})

    sent = docs.mapInArrow(send, "bucket long, first binary, known binary")
    return sent.groupBy("bucket").applyInArrow(meet, "key long, value long").groupBy("key", "value").agg(F.lit(1).alias("_")).drop("_")
