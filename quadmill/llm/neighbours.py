"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample (SAMPLE vectors, by a hash of vec_id); every vector is indexed:
its list is that of its nearest centroid, its code the nearest codewords of its residual's parts.  A query probes
its nearest lists.  In each, *asymmetric* distance tables (query residual to codewords) rank all members by table
look-ups.  The best SHORT are reranked by exact distance on the original vectors, and then every other member whose
asymmetric distance, less the error of its own code, may still reach the k-th of these: by the triangle inequality no
member of a probed list that belongs to the k nearest is left out, however many share one code.

Lists and the queries that probe them meet in blocks of bounded size: a list with very many members is dealt over row
blocks, its queries over query blocks, so a frequent vector fills many tasks, not one.

Odd cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components take no
part, nor does a null vec_id; equal distances are ordered by vec_id; a vec_id given twice is never its own neighbour;
fewer candidates than k give fewer rows; an empty table gives none.  Only the two columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadmill.llm.shared import keep

#: The most vectors to fit centroids and codebooks on.
SAMPLE = 20_000
#: The most lists; otherwise half the square root of the number of vectors.
LISTS = 4096
#: How many lists a query probes is set so that this share of the sample's true neighbours lies in them.
WANTED = 0.97
#: Queries for that, and the neighbours of each.
TUNING, TUNING_K = 400, 10
#: Parts of a residual, and codewords of each.
PARTS, WORDS = 16, 256
#: Members reranked first in each list and block, which bound the rest, and the fewest candidates that a query's lists hold.
SHORT, LEAST_CANDIDATES = 96, 512
ROWS, QUERIES = 8192, 1024


@dataclass
class Index:
    centroids: np.ndarray  # (lists, dim)
    codebooks: np.ndarray  # (parts, words, dim of a part)

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def split(self, x: np.ndarray) -> np.ndarray:
        """(rows, dim) as (rows, parts, dim of a part), with zeros at the end."""
        parts, _, width = self.codebooks.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code of each row."""
        at = nearest(x, self.centroids)
        rest = self.split(x - self.centroids[at])
        return at, np.stack([nearest(rest[:, m], self.codebooks[m]) for m in range(len(self.codebooks))], 1).astype(np.uint8)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = squared(x[a : a + 4096], centroids).argmin(1)
    return out


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        at = nearest(x, centroids)
        n = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, x[:, j], k) for j in range(x.shape[1])], 1)
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    return centroids


def train(x: np.ndarray, lists: int, parts: int = PARTS, words: int = WORDS, seed: int = 11) -> Index:
    rng = np.random.default_rng(seed)
    centroids = k_means(x, lists, rng)
    parts = min(parts, x.shape[1])
    width = -(-x.shape[1] // parts)
    index = Index(centroids, np.zeros((parts, 1, width)))
    rest = index.split(x - centroids[nearest(x, centroids)])
    books = [k_means(rest[:, m], words, rng) for m in range(parts)]
    size = max(map(len, books))
    index.codebooks = np.stack([np.concatenate((b, np.repeat(b[:1], size - len(b), 0))) for b in books])
    return index


def best(distance: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least, in no order; of equal ones at the edge, those that come first."""
    if len(distance) <= k:
        return np.arange(len(distance))
    edge = np.partition(distance, k - 1)[k - 1]
    less = np.flatnonzero(distance < edge)
    return np.concatenate((less, np.flatnonzero(distance == edge)[: k - len(less)]))


def probes_needed(index: Index, x: np.ndarray) -> int:
    """The lists to probe for WANTED of the true neighbours, measured by brute force on the sample x."""
    lists = len(index.centroids)
    q = x[:: max(1, len(x) // TUNING)][:TUNING]
    k = min(TUNING_K + 1, len(x))
    place = np.argsort(np.argsort(squared(q, index.centroids), 1, kind="stable"), 1)
    at = nearest(x, index.centroids)
    ranks = [place[i][at[best(row, k)]] for i, row in enumerate(squared(q, x))]
    return min(lists, int(np.quantile(np.concatenate(ranks), WANTED)) + 2) if ranks else lists


def search(index: Index, at: int, codes: np.ndarray, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, its k nearest members' ids, distances) in one block of list ``at``, exactly; ids must ascend."""
    rest = index.split(queries - index.centroids[at])
    parts = np.arange(len(index.codebooks))
    # how far each member is from what its code stands for
    error = np.sqrt(((index.split(vectors - index.centroids[at]) - index.codebooks[parts, codes]) ** 2).sum((1, 2)))
    size = np.sqrt((vectors * vectors).sum(1))
    for q in range(len(queries)):
        tables = ((rest[q][:, None, :] - index.codebooks) ** 2).sum(2)
        near = tables[parts, codes].sum(1)
        near[ids == query_ids[q]] = np.inf
        short = best(near, max(SHORT, k))
        short = short[np.isfinite(near[short])]
        exact = np.sqrt(((vectors[short] - queries[q]) ** 2).sum(1))
        if len(short) >= k and len(short) < len(ids):
            bound = np.partition(exact, k - 1)[k - 1]
            # more than floating-point sums can be off
            slack = 1e-9 * (size + np.sqrt((queries[q] ** 2).sum()))
            may = np.isfinite(near) & (np.sqrt(near) - error - slack <= bound)
            may[short] = False
            more = np.flatnonzero(may)
            short = np.concatenate((short, more))
            exact = np.concatenate((exact, np.sqrt(((vectors[more] - queries[q]) ** 2).sum(1))))
        top = np.lexsort((ids[short], exact))[:k]
        yield q, ids[short[top]], exact[top]


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # not true of NaN, which is over infinity
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def k_nearest(rows: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (the Euclidean distance) of the k nearest rows found for each query row."""
    spark = rows.sparkSession
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), is_query.alias("is_query")).where(F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where("dim > 0").orderBy(F.desc("n"), "dim").first()
    kind = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], kind)
    dim, n = sizes["dim"], sizes["n"]
    rows = rows.where(usable(F.col("v"), dim))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], kind)
    points = _matrix(sample, dim)
    index = train(points, max(1, min(LISTS, int(n**0.5 / 2), len(sample) // 8)))
    few = probes_needed(index, points)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dim)
            at, codes = shared.value.encode(x)
            blobs = [[y.tobytes() for y in z] for z in (codes, x)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column("vec_id"), *(pa.array(z, pa.binary()) for z in blobs), b.column("is_query")], ["list", "vec_id", "code", "x", "is_query"])

    members = keep(rows.mapInArrow(assign, "list int, vec_id long, code binary, x binary, is_query boolean"), "members")
    lists = len(index.centroids)
    # one row for each list
    held = np.zeros(lists, np.int64)
    for r in members.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        held[r["list"]] = r["n"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = shared.value
        for b in batches:
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float64).reshape(-1, dim)
            order = np.argsort(squared(x, i.centroids), 1, kind="stable") if len(x) else np.zeros((0, lists), np.int64)
            total = np.cumsum(held[order], 1)
            take = np.minimum(np.maximum(few, (total < LEAST_CANDIDATES).sum(1) + 1), lists)
            at = np.repeat(np.arange(len(x)), take)
            to = np.concatenate([o[:t] for o, t in zip(order, take)]) if len(x) else np.zeros(0, np.int64)
            use = held[to] > 0
            where = pa.array(at[use])
            yield pa.RecordBatch.from_arrays([pa.array(to[use].astype(np.int32)), b.column("vec_id").take(where), b.column("x").take(where)], ["list", "query_id", "q"])

    probes = members.where("is_query").select("vec_id", "x").mapInArrow(probe, "list int, query_id long, q binary")
    asked = np.zeros(lists, np.int64)
    for r in probes.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        asked[r["list"]] = r["n"]
    plan = spark.createDataFrame([(i, int(-(-held[i] // ROWS)) or 1, int(-(-asked[i] // QUERIES)) or 1) for i in range(lists)], "list int, row_blocks int, query_blocks int")
    plan = F.broadcast(plan)  # at most LISTS rows
    left = members.select("list", "vec_id", "code", "x").join(plan, "list")
    left = left.select("list", "vec_id", "code", "x", F.pmod(F.xxhash64("vec_id"), "row_blocks").alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks").cast("long") - 1)).alias("qb"))
    right = probes.join(plan, "list")
    right = right.select("list", "query_id", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_blocks").cast("long") - 1)).alias("rb"), F.pmod(F.xxhash64("query_id"), "query_blocks").alias("qb"))

    def meet(m: pa.Table, q: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if m.num_rows and q.num_rows:
            i = shared.value
            m = m.sort_by("vec_id")
            ids, query_ids = m.column("vec_id").to_numpy(), q.column("query_id").to_numpy()
            codes = np.frombuffer(b"".join(m.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            x = np.frombuffer(b"".join(m.column("x").to_pylist()), np.float64).reshape(len(ids), dim)
            y = np.frombuffer(b"".join(q.column("q").to_pylist()), np.float64).reshape(len(query_ids), dim)
            for j, near, score in search(i, m.column("list")[0].as_py(), codes, x, ids, y, query_ids, k):
                out[0].append(np.full(len(near), query_ids[j]))
                out[1].append(near)
                out[2].append(score)
        cat = lambda z, t: pa.array(np.concatenate(z) if z else [], t)
        return pa.table({"query_id": cat(out[0], pa.int64()), "vec_id": cat(out[1], pa.int64()), "score": cat(out[2], pa.float64())})

    by = ["list", "rb", "qb"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
