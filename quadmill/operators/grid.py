"""Tile algebra as column expressions.  Coordinates are promoted to long before they are multiplied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadmill.functions.kernels import EXTENTS, reach_of


def half(c: Column, levels: int = 1) -> Column:
    """A coordinate some levels out."""
    return F.shiftright(c, levels)


def parent_key(z: Column, x: Column, y: Column) -> Column:
    """The row-major number of the parent tile in its level."""
    return half(y).cast("long") * _span(z - 1) + half(x)


def own_key(z: Column, x: Column, y: Column) -> Column:
    return y.cast("long") * _span(z) + x


def _span(z: Column) -> Column:
    """2^z."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int"))


def children(tiles: DataFrame, shift: int = 1) -> DataFrame:
    """tiles (z, x, y, ...) with a row for each tile ``shift`` levels in: child_z, child_x, child_y."""
    n = 1 << shift
    df = tiles.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    return df.select(
        *tiles.columns,
        (F.col("z") + shift).cast("int").alias("child_z"),
        (F.col("x") * n + F.col("nth") % n).cast("int").alias("child_x"),
        (F.col("y") * n + F.expr(f"nth div {n}")).cast("int").alias("child_y"),
    )


def quadrant(c: Column, size: int) -> Column:
    """Where a tile's half lies in its parent, in pixels, on one axis."""
    return (c % 2 * (size // 2)).cast("int")


def roi(c: Column, shift: int, size: int) -> Column:
    """Where the part of the parent that fills a child begins, in pixels, on one axis; it is size >> shift long."""
    c = c.cast("long")
    return (F.shiftright(c * size, shift) - F.shiftright(c, shift) * size).cast("int")


def padding(methods=tuple(EXTENTS)) -> list[tuple[str, int, int]]:
    """(method, side of its neighbourhood, pixels that it reaches right and down)."""
    return [(m, EXTENTS[m], reach_of(m)) for m in methods]


def clusters(tiles: DataFrame) -> DataFrame:
    """Tiles (z, x, y) by parent: z, x, y of the parent, its key, the members' number and their own keys in order."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    by = tiles.groupBy((z - 1).cast("int").alias("pz"), half(x).alias("px"), half(y).alias("py"), parent_key(z, x, y).alias("parent_key"))
    members = F.sort_array(F.collect_set(own_key(z, x, y)))  # four at most: equal tiles are one
    return by.agg(members.alias("keys")).select("pz", "px", "py", "parent_key", F.size("keys").cast("long").alias("members"), F.array_join(F.col("keys").cast("array<string>"), ",").alias("member_keys"))


def counts(tiles: DataFrame) -> DataFrame:
    """One row: the tiles, and the tiles one level out."""
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    return tiles.agg(F.count(F.lit(1)).alias("tiles"), F.countDistinct(z - 1, half(x), half(y)).alias("parents"))


def latest(tiles: DataFrame) -> DataFrame:
    """One row for each (z, x, y): the last by path."""
    return tiles.groupBy("z", "x", "y").agg(F.max("path").alias("path"))
