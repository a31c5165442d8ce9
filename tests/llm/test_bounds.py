"""What operators hold at a time, and what they shuffle, does not depend on how large the input is."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quadmill.llm import jaccard, line_dedup, routing


def test_a_map_task_holds_few_signatures():
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 1500))) for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    emit = jaccard.signatures(5, 80, 36, np.zeros(0, np.uint64))
    tracemalloc.start()
    rows = 0
    for x in routing.packets([batch], emit, 8):
        rows += sum(map(len, filter(None, x.column("first").to_pylist()))) // 16
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    keys, values = emit(batch)
    assert rows == len(np.unique(np.stack((keys, values.view(np.uint64)), 1), axis=0))
    assert most < 33e6


def test_line_dedup_joins_small_tables_as_large_ones(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "x\na\nb"), (3, None)], "doc_id long, text string")
    done = line_dedup.dedup(docs)
    assert {r.doc_id: r.text for r in done.collect()} == {1: "a\nb\nc", 2: "x", 3: None}
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
