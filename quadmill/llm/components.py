"""Connected components of a table of links, by rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadmill.llm.shared import Scope


def components(links: DataFrame, scope: Scope) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node reachable.

    Alternates two steps until nothing changes: *large star* hangs each node's larger neighbours on its smallest
    neighbour, *small star* its smaller ones and itself.  The rounds grow with the logarithm of the longest chain; each
    is written to the shared folder, and the one before deleted.  A node with very many neighbours costs a join that Spark may split, never a list."""
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scope.keep(links.select("a", "b").where("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        near = both(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = near.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        down = star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        last, edges = edges, scope.keep(small.select("m", "b").union(small.select("m", "a")).toDF("a", "b").where("a <> b").distinct(), "edges")
        scope.drop(last)
        # a star forest is what both steps leave unchanged; its sums tell, as every change lowers one of them or the count
        now = edges.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(20,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return roots.union(edges.select(F.col("b").alias("node"), F.col("a").alias("component")))
