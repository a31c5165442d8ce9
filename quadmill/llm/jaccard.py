"""Size-aware heavy-light join on the Jaccard similarity of word-shingle sets, and its components.

*Light* sets meet by fixed-size subsets, *heavy* sets in inverted lists over the least elements (by hash) of heavy sets
and of the sets just below (see ``shingles``).  The boundary is the size at which the cost of the lists falls below that
of the subsets; it is computed from the sizes of all sets, and changes the cost only, never the result.  Linked sets
share more signatures, or entries, than one, so every set disregards its most frequent ones, whose groups are large.

Equal sets are one node from the start.  The sets of one signature are a *group*.  They are compared in waves:

1. every set with the one set, of all that it shares a group with, that shares most; the links' components are found;
2. what one group still has in different components: parity bitmaps bound how far two sets differ, and the nearest
   of each other component are compared;
3. where none of those linked but more may, all that the bitmaps allow.

So no link between components is lost, and a group of near copies costs a comparison for each member instead of
one for each pair.  In a group, members of the largest component never meet each other again.

Odd cases: a text without words, or null, has the empty set and is linked with nothing (its own component); a row with
null doc_id gets its set's size, and a null component, and links nothing; rows that repeat a doc_id are one document
with each of their texts, and link with each other if they have words; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadmill.llm import shingles as S
from quadmill.llm import words as W
from quadmill.llm.components import components
from quadmill.llm.routing import BUCKET_ROWS, SLICE_BYTES, shared_keys
from quadmill.llm.shared import Scope

#: Members of a group that are compared with each other in one task; a larger group is dealt over pairs of blocks.
BLOCK = 2048
#: The nearest sets of another component that are compared first.
NEAREST = 32
#: Bytes of sets, or rows of groups, that a task is planned to compare.
TASK_BYTES, TASK_ROWS = 16 << 20, 20_000


def summaries(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n (size of its set), set_id and alt_id (0: empty), class (of size), bits (the bitmap), drop0 and drop1 (how
    many signatures it disregards)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in W.slices(batches, limit=SLICE_BYTES):
            sets, at = S.doc_sets(s.column("text"), shingle)
            n = np.diff(at)
            bits = [S.bitmap(sets[a:b]) if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            drop = S.disregarded(sets, at, percent)
            ids = [pa.array(x.view(np.int64)) for x in S.set_ids(sets, at)]
            kind = pa.array(S.classes(n, percent).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [s.column("doc_id"), pa.array(n), *ids, kind, pa.array(bits, pa.binary()), pa.array(drop[:, 0]), pa.array(drop[:, 1])],
                ["doc_id", "n", "set_id", "alt_id", "class", "bits", "drop0", "drop1"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, set_id long, alt_id long, class int, bits binary, drop0 int, drop1 int")


def list_spare(heavy: int, percent: int) -> int:
    """How many entries of the inverted lists each set disregards, if they begin with class ``heavy``."""
    n = int(S.class_bounds(percent)[max(heavy - 1, 0)])
    return (n - -(-percent * n // 100)) // 4


def boundary(histogram: list[tuple[int, int]], percent: int) -> int:
    """The first heavy class, given (class, sets) for all classes.

    A light set costs the rows of its signatures, of two schemes.  A heavy one costs the rows of its list entries and,
    at worst, a comparison (n / 1000 rows' worth) with every set of its class and the next."""
    bounds, (parts, _) = S.class_bounds(percent), S.schemes(percent)
    sets = dict(histogram)
    costs = {}
    for first in range(max(sets, default=0) + 1, -1, -1):
        spare = list_spare(first, percent)
        light = sum(c * int(parts[k] + parts[k + 1]) for k, c in sets.items() if k < first)
        heavy = 0.0
        for k, c in sets.items():
            if k >= first:
                n = int(bounds[k])
                heavy += c * (n - -(-percent * n // 100) + 1 + spare) + c * (c + sets.get(k + 1, 0)) * n / 1000
        costs[first] = light + heavy
    return min(costs, key=lambda k: (costs[k], -k))


def signatures(shingle: int, percent: int, heavy: int, clashing: np.ndarray):
    """What a slice of documents emits: (signature, set id) of each distinct set."""
    spare = list_spare(heavy, percent)

    def emit(s: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        sets, at = S.doc_sets(s.column("text"), shingle)
        ids = identities(sets, at, clashing)
        _, one = np.unique(ids, return_index=True)
        one = one[np.diff(at)[one] > 0]
        size = np.diff(at)[one]
        sets = sets[np.repeat(at[one] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        at, ids = np.concatenate(([0], np.cumsum(size))), ids[one]
        kind = S.classes(size, percent)
        keys, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k in (kind, kind + 1):
            light = (kind < heavy) & (k < heavy)
            part = np.flatnonzero(light)
            found, owner = S.subset_signatures(sets[np.repeat(light, size)], np.concatenate(([0], np.cumsum(size[light]))), k[light], percent)
            keys.append(found)
            who.append(part[owner])
        for i in np.flatnonzero(kind >= heavy - 1).tolist():
            found = S.list_entries(sets[at[i] : at[i + 1]], percent, spare)
            keys.append(found)
            who.append(np.full(len(found), i))
        return np.concatenate(keys), ids[np.concatenate(who)]

    return emit


def identities(sets: np.ndarray, at: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    """The id of each set: the first of its two identities; the second where the first is one of two different sets."""
    one, two = S.set_ids(sets, at)
    return np.where(np.isin(one, clashing), two, one) if len(clashing) else one


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(rows of x, rows of y): the least number of elements in which two sets differ, by bitmaps of one width."""
    out = np.empty((len(x), len(y)), np.int64)
    for i in range(len(x)):
        out[i] = np.bitwise_count(x[i] ^ y).sum(1)
    return out


def _may_link(percent: int, n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m that differ in so many elements at least may link."""
    common = np.minimum((n + m - differ) // 2, np.minimum(n, m))
    return 100 * common >= percent * (n + m - common)


def _stacked(bits: list[bytes], rows: list[int]) -> np.ndarray:
    """The bitmaps of some rows, as narrow as the narrowest."""
    width = min(len(bits[i]) for i in rows) // 8
    wide: dict[int, list[int]] = {}
    for j, i in enumerate(rows):
        wide.setdefault(len(bits[i]), []).append(j)
    out = np.empty((len(rows), width), np.uint64)
    for places in wide.values():
        out[places] = S.folded(np.stack([np.frombuffer(bits[rows[j]], np.uint64) for j in places]), width)
    return out


def _edges(*columns: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal rows of sorted columns."""
    n = len(columns[0])
    if not n:
        return []
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new).tolist()
    return list(zip(at, [*at[1:], n]))


def _across(percent: int, nearest: int | None):
    """Of rows (key, side, value, component, n, bits): the pairs of a key in different components that may link.

    In a block of one side (0) all pairs count, else those of side 1 with side 2.  Of each set's pairs with one other
    component the ``nearest`` are given; more tells that there are others."""

    def run(group: pa.Table) -> pa.Table:
        key, value, part, n, side = (group.column(c).to_numpy() for c in ("key", "value", "component", "n", "side"))
        bits = group.column("bits").to_pylist()
        order = np.lexsort((value, key))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        found: list[np.ndarray] = []
        for a, b in _edges(key[order]):
            rows = order[a:b]
            left, right = rows[side[rows] != 2], rows[side[rows] != 1]
            if not len(left) or not len(right):
                continue
            wide = _stacked(bits, rows.tolist())
            other = wide[place[right] - a]
            for c in range(0, len(left), 64):
                u = left[c : c + 64]
                ok = part[u][:, None] != part[right]
                ok &= (side[u][:, None] != 0) | (value[u][:, None] < value[right])
                ok &= 100 * np.minimum(n[u][:, None], n[right]) >= percent * np.maximum(n[u][:, None], n[right])
                i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
                if not len(i):
                    continue
                differ = np.zeros(ok.shape, np.int64)
                differ[np.ix_(i, j)] = _differ(wide[place[u[i]] - a], other[j])
                ok &= _may_link(percent, n[u][:, None], n[right], differ)
                p, q = np.nonzero(ok)
                if not len(p):
                    continue
                more = np.zeros(len(p), np.int64)
                if nearest:
                    z = np.lexsort((differ[p, q] / (n[u][p] + n[right][q]), part[right][q], p))
                    p, q = p[z], q[z]
                    runs = _edges(p, part[right][q])
                    rank = np.concatenate([np.arange(y - x) for x, y in runs])
                    size = np.concatenate([np.full(y - x, y - x) for x, y in runs])
                    more = (size > nearest).astype(np.int64)
                    p, q, more = p[rank < nearest], q[rank < nearest], more[rank < nearest]
                x, y = value[u][p], value[right][q]
                found.append(np.stack((np.minimum(x, y), np.maximum(x, y), more), 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "more": pairs[:, 2] > 0})

    return run


def _with_pivots(check):
    """Of rows (a, s, b, n, x), where b is null in the row of a itself: the pairs (a, b) that ``check(a's n, a's x, others' n, others' x)`` accepts."""

    def run(group: pa.Table) -> pa.Table:
        a, s, n = (group.column(c).to_numpy() for c in ("a", "s", "n"))
        b, x = group.column("b").combine_chunks(), group.column("x").combine_chunks()
        own = np.asarray(b.is_null())
        b = np.asarray(b.fill_null(0))
        order = np.lexsort((~own, s, a))
        found: list[np.ndarray] = []
        for i, j in _edges(a[order], s[order]):
            rows = order[i:j]
            if not own[rows[0]] or len(rows) < 2:
                continue
            rest = rows[1:]
            ok = check(n[rows[0]], x[int(rows[0])].as_buffer(), n[rest], [x[int(r)].as_buffer() for r in rest])
            found.append(np.stack((a[rest], b[rest]), 1)[ok])
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _by_bitmaps(percent: int):
    def check(n, x, m, others) -> np.ndarray:
        bits = _stacked([x, *others], list(range(len(others) + 1)))
        return _may_link(percent, n, m, _differ(bits[:1], bits[1:])[0])

    return check


def _by_sets(percent: int):
    def check(n, x, m, others) -> np.ndarray:
        x = np.frombuffer(x, np.uint64)
        y = np.concatenate([np.frombuffer(o, np.uint64) for o in others])
        hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(m) - m)
        return 100 * common >= percent * (n + m - common)

    return check


class Join:
    """One run of the join over a table of documents (doc_id, text); its tables live in a scope."""

    def __init__(self, docs: DataFrame, shingle: int, percent: int, scope: Scope):
        self.shingle, self.percent, self.scope = shingle, percent, scope
        docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        self.named = docs.where(F.col("doc_id").isNotNull())
        summary = scope.keep(summaries(docs, shingle, percent), "sets")
        both = summary.where("n > 0").groupBy("set_id").agg(F.min("alt_id").alias("low"), F.max("alt_id").alias("high"))
        # different sets of one 64-bit hash: none in corpora of less than billions of documents, a few beyond
        clashing = [r["set_id"] for r in both.where("low <> high").select("set_id").collect()]
        self.clashing = np.array(clashing, np.int64).view(np.uint64)
        if clashing:
            summary = summary.withColumn("set_id", F.when(F.col("set_id").isin(clashing), F.col("alt_id")).otherwise(F.col("set_id")))
        self.summary = summary.drop("alt_id")
        nodes = self.summary.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        first = [F.first(c).alias(c) for c in ("n", "class", "bits", "drop0", "drop1")]
        self.nodes = scope.keep(nodes.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), *first), "nodes")

    def groups(self) -> DataFrame:
        """(key, value, pop): the sets that share a signature with another, less those that each set disregards; pop
        is how many sets share one with it, counted for each signature."""
        scope, percent = self.scope, self.percent
        parts, _ = S.schemes(percent)
        # one row for each size class
        histogram = [(r["class"], r["c"]) for r in self.nodes.groupBy("class").agg(F.count(F.lit(1)).alias("c")).collect()]
        heavy = boundary(histogram, percent)
        rows = sum(c * int(parts[k] + parts[k + 1]) for k, c in histogram)
        all_keys = scope.keep(shared_keys(self.named, signatures(self.shingle, percent, heavy, self.clashing), max(1, rows // BUCKET_ROWS)), "keys")
        often = all_keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        code = F.col("key").bitwiseAND(3)
        drop = F.when(code == 2, F.lit(list_spare(heavy, percent))).when(code == 0, F.col("drop0")).otherwise(F.col("drop1"))
        ranked = all_keys.join(often, "key").join(self.nodes.select(F.col("set_id").alias("value"), "drop0", "drop1"), "value")
        nth = F.row_number().over(Window.partitionBy("value", code).orderBy(F.desc("c"), "key"))
        kept = scope.keep(ranked.withColumn("nth", nth).where(F.col("nth") > drop).select("key", "value"), "kept")
        scope.drop(all_keys)
        shared = kept.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        kept_c = scope.keep(kept.join(shared, "key"), "shared")
        scope.drop(kept)
        pop = kept_c.groupBy("value").agg(F.sum("c").alias("pop"))
        out = scope.keep(kept_c.select("key", "value").join(pop, "value").select("key", "value", "pop"), "groups")
        scope.drop(kept_c)
        return out

    def fetched(self, groups: DataFrame) -> DataFrame:
        """The packed sets of the groups' members: set_id, x."""
        shingle, clashing = self.shingle, self.clashing

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in W.slices(batches, limit=SLICE_BYTES):
                sets, at = S.doc_sets(s.column("text"), shingle)
                ids = identities(sets, at, clashing).view(np.int64)
                blobs = [sets[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(blobs, pa.binary())], ["set_id", "x"])

        wanted = self.nodes.join(groups.select(F.col("value").alias("set_id")).distinct(), "set_id", "left_semi")
        sets = self.named.join(wanted.select("doc_id"), "doc_id", "left_semi").mapInArrow(run, "set_id long, x binary")
        return self.scope.keep(sets.dropDuplicates(["set_id"]), "fetched")

    def accepted(self, pairs: DataFrame, data: DataFrame, check, tag: str) -> DataFrame:
        """The pairs (a, b) that check accepts; data: set_id, n, x, size (bytes).  The sets b of one a are dealt over tasks by their bytes, and each task gets a's once."""
        rows = pairs.join(data.toDF("b", "n", "x", "size"), "b")
        weight = pairs.join(data.select(F.col("set_id").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("bytes"))
        weight = self.scope.keep(weight, f"{tag}-weights")
        total = weight.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        buckets = max(1, 2 * total // TASK_BYTES)
        blocks = weight.select("a", F.ceil(F.col("bytes") / TASK_BYTES).cast("long").alias("blocks"))
        rows = rows.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").alias("s"), "b", "n", "x")
        pivots = blocks.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        pivots = pivots.join(data.toDF("a", "n", "x", "size"), "a").select("a", "s", F.lit(None).cast("long").alias("b"), "n", "x")
        both = rows.unionByName(pivots).withColumn("bucket", F.pmod(F.xxhash64("a", "s"), F.lit(buckets)))
        out = self.scope.keep(both.groupBy("bucket").applyInArrow(_with_pivots(check), "a long, b long"), tag)
        self.scope.drop(weight)
        return out

    def linked(self, pairs: DataFrame, sets: DataFrame, tag: str) -> DataFrame:
        data = sets.select("set_id", (F.octet_length("x") / 8).cast("long").alias("n"), "x", F.octet_length("x").alias("size"))
        return self.accepted(pairs, data, _by_sets(self.percent), tag)

    def across(self, groups: DataFrame, found: DataFrame, nearest: int | None) -> DataFrame:
        """The pairs (a, b, more), of sets of one group and different components, that may link."""
        scope = self.scope
        own = groups.join(found, F.col("value") == F.col("node"), "left").select("key", "value", F.coalesce("component", "value").alias("component"))
        own = scope.keep(own, "own")
        parts = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
        keys = parts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("c")).where(F.col("main.c") < F.col("c"))
        blocks = lambda c: F.ceil(c / BLOCK).cast("long")
        keys = keys.select("key", F.col("main.component").alias("main"), blocks(F.col("main.c")).alias("bm"), blocks(F.col("c") - F.col("main.c")).alias("bo"))
        mixed = own.join(keys, "key").join(self.nodes.select(F.col("set_id").alias("value"), "n", "bits"), "value")
        mixed = scope.keep(mixed, "mixed")
        scope.drop(own)
        buckets = max(1, mixed.count() // TASK_ROWS)
        is_main = F.col("component") == F.col("main")
        upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
        mine = F.pmod(F.xxhash64("value"), F.when(is_main, F.col("bm")).otherwise(F.col("bo")))
        mixed_m = mixed.withColumn("mine", mine)
        # each block of the main component with each block of the others, which are side 1
        data = ["key", "value", "component", "n", "bits"]
        meet = mixed_m.withColumn("it", F.explode(F.when(is_main, upto("bo")).otherwise(upto("bm"))))
        meet = meet.select(*data, F.lit(0).alias("kind"), F.when(is_main, F.col("mine")).otherwise(F.col("it")).alias("i"), F.when(is_main, F.col("it")).otherwise(F.col("mine")).alias("j"), F.when(is_main, 2).otherwise(1).alias("side"))
        # and the others with each other; within one block every pair counts
        rest = mixed_m.where(~is_main).withColumn("it", F.explode(upto("bo")))
        side = F.when(F.col("mine") == F.col("it"), 0).when(F.col("mine") < F.col("it"), 1).otherwise(2)
        rest = rest.select(*data, F.lit(1).alias("kind"), F.least("mine", "it").alias("i"), F.greatest("mine", "it").alias("j"), side.alias("side"))
        rows = meet.unionByName(rest).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        pairs = rows.groupBy("bucket", "kind", "i", "j").applyInArrow(_across(self.percent, nearest), "a long, b long, more boolean")
        out = scope.keep(pairs.groupBy("a", "b").agg(F.max("more").alias("more")), "pairs")
        scope.drop(mixed)
        return out

    def components(self) -> DataFrame:
        """(set_id, component_id) of the sets that link with another set: the smallest doc_id."""
        scope = self.scope
        groups = self.groups()
        sets = self.fetched(groups)
        pivots = groups.groupBy("key").agg(F.max(F.struct("pop", "value")).alias("pivot"))
        stars = groups.join(pivots, "key").where(F.col("value") != F.col("pivot.value")).groupBy("value").agg(F.max("pivot").alias("pivot"))
        stars = scope.keep(stars.select(F.col("pivot.value").alias("a"), F.col("value").alias("b")), "stars")
        bits = self.nodes.select("set_id", "n", F.col("bits").alias("x"), F.octet_length("bits").alias("size"))
        near = self.accepted(stars, bits, _by_bitmaps(self.percent), "near")
        # the texts of one document are linked
        lone = self.summary.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "set_id")
        several = lone.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).where("a <> z").drop("z")
        same = lone.join(several, "doc_id").select("a", F.col("set_id").alias("b")).where("a <> b")
        links = scope.keep(self.linked(near, sets, "star-links").union(same), "links")
        found = scope.keep(components(links, scope), "components")
        more = self.across(groups, found, NEAREST)
        if not more.isEmpty():
            links = scope.keep(links.union(self.linked(more.select("a", "b"), sets, "near-links")), "links")
            found = scope.keep(components(links, scope), "components")
            of = lambda c: found.toDF(c, f"of_{c}")
            open_ = more.where("more").join(of("a"), "a", "left").join(of("b"), "b", "left")
            open_ = open_.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
            if not open_.isEmpty():
                rest = self.across(groups, found, None).select("a", "b").join(more.select("a", "b"), ["a", "b"], "left_anti")
                links = scope.keep(links.union(self.linked(scope.keep(rest, "rest"), sets, "rest-links")), "links")
                found = scope.keep(components(links, scope), "components")
        named = self.nodes.select(F.col("set_id").alias("node"), "doc_id").join(found, "node")
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        return named.join(least, "component").select(F.col("node").alias("set_id"), "component_id")

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, set_id and component_id of every row."""
        lone = self.nodes.select("set_id", F.col("doc_id").alias("least"))
        df = self.summary.select("doc_id", "n", "set_id").join(lone.join(self.components(), "set_id", "left").select("set_id", F.coalesce("component_id", "least").alias("component_id")), "set_id", "left")
        own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        return df.select("doc_id", F.col("n").alias("n_shingles"), "set_id", own.alias("component_id"))


def similar(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, set_id (equal for equal sets) and component_id (smallest doc_id reachable by links) of every row."""
    with Scope(docs.sparkSession) as scope:
        return scope.leave(scope.keep(Join(docs, shingle, percent, scope).documents(), "documents"))
