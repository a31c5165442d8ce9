"""Tool-call linking on small cases, and the queries that have SQL against DuckDB."""

import glob
import json
import os
import random

import duckdb
import pytest

from quadmill.llm import tool_calls
from quadmill.llm.queries import ORACLES, QUERIES

SCHEMAS = {"add": {"required": ["a"], "properties": {"a": "integer", "b": "number", "s": "string", "l": "array", "o": "object", "f": "boolean"}}}
CALLS = [
    (1, "x", 0, "add", '{"b": 1.5, "a": 1, "s": "é\\n"}', []),
    (1, "y", 1, "add", '{"a": 2}', ["x"]),
    (1, "z", 2, "add", '{"a": 3, "l": [1, {"k": 2, "j": 1}], "o": {}, "f": true}', ["y", "x"]),
    (1, "dup", 4, "add", '{"a": 9}', None),
    (1, "dup", 3, "add", '{"a": 8}', None),
    (1, "u", 5, "sub", '{"a": 1}', None),
    (1, "n", 6, None, '{"a": 1}', None),
    (1, "bad", 7, "add", "{not json", None),
    (1, "nul", 8, "add", None, None),
    (1, "arr", 9, "add", "[1]", None),
    (1, "type", 10, "add", '{"a": "1"}', None),
    (1, "none", 11, "add", "{}", None),
    (1, "extra", 12, "add", '{"a": 1, "q": 2}', None),
    (1, "lost", 13, "add", '{"a": 1}', ["nowhere"]),
    (1, "c1", 14, "add", '{"a": 1}', ["c2"]),
    (1, "c2", 15, "add", '{"a": 1}', ["c1"]),
    (1, "c3", 16, "add", '{"a": 1}', ["c2"]),
    (1, "wait", 17, "add", '{"a": 1}', []),
    (2, "x", 0, "add", '{"a": 5}', []),
    (None, "x", 0, "add", '{"a": 5}', []),
    (2, None, 0, "add", '{"a": 5}', []),
]
RESULTS = [(1, "x", 1, "one"), (1, "x", 3, "later"), (1, "y", 2, 'q"'), (1, "z", 3, ""), (1, "dup", 9, "d"), (1, "ghost", 9, "g"), (1, "wait", 9, None), (2, "x", 1, "two"), (None, "x", 1, "no")]
RESULTS += [(1, k, 20, "r") for k in ("u", "n", "bad", "nul", "arr", "type", "none", "extra", "lost", "c1", "c2", "c3")]


def test_link(spark):
    calls = spark.createDataFrame([(*c, "clash") for c in CALLS], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, status string")
    results = spark.createDataFrame(RESULTS, "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results, SCHEMAS).collect()}
    status = {k[1]: r.status for k, r in got.items() if k[0] == 1}
    assert status == {
        "x": "ok", "y": "ok", "z": "ok", "dup": "ok", "u": "unknown_tool", "n": "unknown_tool", "bad": "invalid_arguments", "nul": "invalid_arguments", "arr": "invalid_arguments",
        "type": "invalid_arguments", "none": "invalid_arguments", "extra": "invalid_arguments", "lost": "missing_dependency", "c1": "cycle", "c2": "cycle", "c3": "cycle",
        "wait": "missing_result", "ghost": "orphan_result",
    }
    assert got[2, "x"].status == "ok" and len(got) == len(status) + 1
    assert [got[1, k].level for k in ("x", "y", "z", "c1")] == [0, 1, 2, None]
    assert got[1, "x"].json == '{"arguments":{"a":1,"b":1.5,"s":"é\\n"},"id":"x","name":"add","result":"one"}'
    assert got[1, "z"].json == '{"arguments":{"a":3,"f":true,"l":[1,{"j":1,"k":2}],"o":{}},"id":"z","name":"add","result":""}'
    assert json.loads(got[1, "dup"].json)["arguments"] == {"a": 8}
    assert tool_calls.link(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def statuses(spark, arguments, schema):
    calls = spark.createDataFrame([(1, f"c{i:02}", i, "f", a, []) for i, a in enumerate(arguments)], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = calls.selectExpr("conv_id", "call_id", "turn", "'r' AS content")
    return [(r.status, r.json) for r in tool_calls.link(calls, results, {"f": schema}).orderBy("call_id").collect()]


def test_nested_schemas_and_large_numbers(spark):
    point = {"type": "object", "required": ["x"], "properties": {"x": "integer", "unit": {"type": "string", "enum": ["mm", "m"]}}}
    schema = {"required": ["it's"], "properties": {"it's": "integer", "path": {"type": "array", "items": point}, "any": {"type": "object", "properties": {}, "additionalProperties": True}}}
    good = ['{"it\'s": 12345678901234567890123}', '{"it\'s": 1, "path": []}', '{"it\'s": -3, "path": [{"x": 1}, {"x": 2, "unit": "mm"}]}', '{"it\'s": 1, "any": {"q": [null]}}']
    bad = ['{"it\'s": 1.5}', '{"it\'s": 1, "path": [{"x": 1}, {"unit": "m"}]}', '{"it\'s": 1, "path": [{"x": 1, "unit": "km"}]}', '{"it\'s": 1, "path": [{"x": 1, "z": 1}]}', '{"path": []}', '{"it\'s": null}', '{"it\'s": 1, "path": [1]}']
    got = statuses(spark, good + bad, schema)
    assert [x[0] for x in got] == ["ok"] * len(good) + ["invalid_arguments"] * len(bad)
    assert '"it\'s":12345678901234567890123' in got[0][1]


def brute_levels(deps):
    level = {}
    while new := {c: max([1 + level[d] for d in ds if d in deps], default=0) for c, ds in deps.items() if c not in level and all(d in level for d in ds if d in deps)}:
        level.update(new)
    return level


def test_levels_of_chains_and_graphs(spark):
    rng = random.Random(3)
    rows = [(1, f"c{i}", i, [f"c{i - 1}"] if i else []) for i in range(5000)]
    graph = {f"g{i}": [f"g{j}" for j in rng.sample(range(i), min(i, rng.choice((0, 1, 1, 1, 2, 3))))] for i in range(120)}
    graph |= {"l1": ["l2"], "l2": ["l3"], "l3": ["l1"], "l4": ["l1"], "l5": ["l4", "g3"], "self": ["self"], "dup": ["g1", "g1"], "gone": ["nowhere", "g2"]}
    rows += [(2, c, i, d) for i, (c, d) in enumerate(graph.items())]
    calls = spark.createDataFrame([(v, c, t, "f", "{}", d) for v, c, t, d in rows], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in tool_calls.link(calls, calls.selectExpr("conv_id", "call_id", "turn", "'r' AS content").limit(0), {"f": {}}).collect()}
    assert len(got) == len(rows)
    assert all(got[1, f"c{i}"] == i for i in range(5000))
    assert {c: got[2, c] for c in graph} == {c: brute_levels(graph).get(c) for c in graph}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, want = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in df.collect()))) == sorted(map(repr, want.select(*order).fetchall()))
