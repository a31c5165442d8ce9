"""Tool-call linking: calls and results joined by identifier, in topological order, checked against schemas and
serialised as canonical JSON.

A call names the calls that it depends on.  Its level is 0 if it depends on none, else one more than the deepest of
those; (level, turn, call_id) is a topological order of a conversation.  Chains of calls with one dependency each are
contracted first, by pointer jumping, in rounds that grow with the logarithm of the longest chain; what is left is
peeled for all conversations at once, each round joining only the calls that wait with those just placed.  A long conversation is
never gathered in one task, and every round's plan is as small as the first.

Arguments are parsed once as variants; canonical JSON has keys in order, no white space, and no null members.  Schemas
have type, properties, required, additionalProperties (false unless it is true), items and enum, at any depth; a property may be
given by its type alone.  Integers of up to 38 digits are exact; longer ones, and numbers with an exponent, are read as
double precision, so they are of type number, not integer.

Statuses, the first that holds: ``orphan_result`` (no call has its id), ``unknown_tool``, ``invalid_arguments`` (not a
JSON object, or not as the schema says), ``missing_dependency``, ``cycle`` (on a cycle, or behind one), ``missing_result``, ``ok``.

Odd cases: rows with a null conv_id or call_id are left out; calls that share an id are one call, the first by turn (then
by name and arguments), as are results; null arguments are invalid, null content is an absent result; a null among the
dependencies is none; an empty table gives no rows.  Other columns are not read, so no name can clash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadmill.llm.shared import Scope

#: JSON types of schemas, as patterns of the schema of a variant.
KINDS = {
    "string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DECIMAL\(.*|DOUBLE)$", "boolean": "^BOOLEAN$",
    "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID$",
}
KEY = ["conv_id", "call_id"]


def valid(value: Column, schema: dict | str) -> Column:
    """Whether a variant is as the schema says; false of null."""
    if isinstance(schema, str):
        schema = {"type": schema}
    kind = schema.get("type") or ("object" if "properties" in schema else None)
    ok = value.isNotNull()
    if kind:
        kinds = [kind] if isinstance(kind, str) else kind
        right = F.lit(False)
        for k in kinds:
            right = right | F.schema_of_variant(value).rlike(KINDS[k])
        ok = ok & right
    if "enum" in schema:
        allowed = [json.dumps(x, separators=(",", ":"), ensure_ascii=False, sort_keys=True) for x in schema["enum"]]
        ok = ok & F.to_json(value).isin(allowed)
    if kind == "object" and "properties" in schema:
        properties = schema["properties"]
        members = F.try_variant_get(value, "$", "map<string,variant>")
        for name, own in properties.items():
            member = F.get(F.filter(F.map_entries(members), lambda e: e["key"] == F.lit(name)), 0)["value"]  # noqa: B023
            ok = ok & (valid(member, own) if name in schema.get("required", ()) else member.isNull() | valid(member, own))
        for name in set(schema.get("required", ())) - set(properties):
            ok = ok & F.array_contains(F.map_keys(members), name)
        if schema.get("additionalProperties") is not True:
            names = F.array(*[F.lit(n) for n in properties]).cast("array<string>")
            ok = ok & (F.size(F.array_except(F.map_keys(members), names)) == 0)
    if kind == "array" and "items" in schema:
        ok = ok & F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: valid(x, schema["items"]))
    return F.coalesce(ok, F.lit(False))


def chains(edges: DataFrame, scope: Scope) -> DataFrame:
    """Of calls with one dependency each (conv_id, call_id, dep): to, the first call down the chain that has another number
    of them, and steps to it.  On a cycle, or behind one, ``open`` stays true."""
    own = edges.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("open"))
    ends = edges.join(own, ["conv_id", "dep"], "left")
    ptr = scope.keep(ends.select(*KEY, F.col("dep").alias("to"), F.lit(1).cast("long").alias("steps"), F.coalesce("open", F.lit(False)).alias("open")), "chains")
    # a chain is no longer than its conversation
    most = ptr.where("open").groupBy("conv_id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    reach = 1
    while reach <= most:
        ahead = ptr.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("open").alias("still"))
        moved = ptr.where("open").join(ahead, ["conv_id", "to"]).select(*KEY, F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"))
        last, ptr = ptr, scope.keep(ptr.where("NOT open").unionByName(moved), "chains")
        scope.drop(last)
        reach *= 2
        if ptr.where("open").isEmpty():
            break
    return ptr


def levels(calls: DataFrame, scope: Scope) -> DataFrame:
    """(conv_id, call_id, level) of the calls (conv_id, call_id, depends_on) that are on no cycle and behind none.
    Dependencies on ids that no call has are ignored here."""
    nodes = calls.select(*KEY)
    edges = calls.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("dep"))
    edges = scope.keep(edges.join(nodes.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi"), "edges")
    degree = scope.keep(edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "degrees")
    ptr = chains(edges.join(degree.where("n = 1"), KEY, "left_semi"), scope)
    found = scope.append(nodes.join(degree, KEY, "left_anti").withColumn("level", F.lit(0).cast("long")))
    to = ptr.select("conv_id", F.col("call_id").alias("dep"), "to", "steps", "open")
    wait = edges.join(degree.where("n > 1"), KEY, "left_semi").join(to, ["conv_id", "dep"], "left")
    # a dependency on an open chain never comes
    end = F.when(~F.coalesce("open", F.lit(False)), F.coalesce("to", "dep"))
    wait = scope.keep(wait.select(*KEY, end.alias("to"), (1 + F.coalesce("steps", F.lit(0))).alias("steps"), F.lit(0).cast("long").alias("best")), "waiting")
    new = scope.table(found)
    while not wait.isEmpty():
        step = wait.join(new.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"], "left")
        step = scope.keep(step, "step")
        by = step.groupBy(*KEY).agg(F.max(F.greatest("best", F.coalesce(F.col("level") + F.col("steps"), F.lit(0)))).alias("best"), F.count_if(F.col("level").isNull()).alias("left"))
        by = scope.keep(by, "state")
        ready = scope.keep(by.where("left = 0").select(*KEY, F.col("best").alias("level")), "ready")
        if ready.isEmpty():
            break
        scope.append(ready, found)
        later = step.where("level IS NULL").drop("best", "level").join(by.where("left > 0").drop("left"), KEY)
        last, wait = wait, scope.keep(later.select(*KEY, "to", "steps", "best"), "waiting")
        scope.drop(last, step, by, *([] if new is None else [new]))
        new = ready
    placed = scope.table(found)
    behind = ptr.where("NOT open").join(placed.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"])
    return placed.unionByName(behind.select(*KEY, (F.col("level") + F.col("steps")).alias("level")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Of calls (conv_id, call_id, turn, name, arguments: JSON, depends_on: array) and results (conv_id, call_id, turn,
    content): conv_id, call_id, turn, level, status and json, a row for each id."""
    with Scope(calls.sparkSession) as scope:
        return scope.leave(scope.keep(_linked(calls, results, schemas, scope), "linked"))


def _linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], scope: Scope) -> DataFrame:
    calls = calls.dropna(subset=KEY).groupBy(*KEY).agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("x")).select(*KEY, "x.*")
    own = F.filter(F.coalesce("depends_on", F.array().cast("array<string>")), lambda x: x.isNotNull())
    calls = scope.keep(calls.withColumn("depends_on", own), "calls")
    results = results.dropna(subset=[*KEY, "content"]).groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("y")).select(*KEY, F.col("y.content").alias("result"), F.lit(True).alias("has_result"))
    named = calls.select("conv_id", F.col("call_id").alias("dep"))
    lost = calls.select(*KEY, F.explode("depends_on").alias("dep")).join(named, ["conv_id", "dep"], "left_anti").select(*KEY).distinct().withColumn("lost", F.lit(True))
    df = calls.withColumn("has_call", F.lit(True)).join(levels(calls, scope), KEY, "left").join(lost, KEY, "left").join(results, KEY, "full")
    df = df.withColumn("args", F.try_parse_json("arguments"))
    right = F.lit(False)
    for name, schema in schemas.items():
        right = right | ((F.col("name") == name) & valid(F.col("args"), {"type": "object", "properties": {}, **schema}))
    known = F.col("name").isin(*schemas) if schemas else F.lit(False)
    status = (
        F.when(F.col("has_call").isNull(), "orphan_result")
        .when(~F.coalesce(known, F.lit(False)), "unknown_tool")
        .when(~F.coalesce(right, F.lit(False)), "invalid_arguments")
        .when(F.col("lost").isNotNull(), "missing_dependency")
        .when(F.col("level").isNull(), "cycle")
        .when(F.col("has_result").isNull(), "missing_result")
        .otherwise("ok")
    )
    json = F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), "name", "result"))
    return df.select(*KEY, "turn", F.col("level").cast("int").alias("level"), status.alias("status"), json.alias("json"))
