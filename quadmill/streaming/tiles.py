"""Tiles that arrive over time: new files are decoded as they come, and only the tiles above them are made again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmill.operators import paths, tiles


def arriving(spark: SparkSession, root: str, template: str = "OSM") -> DataFrame:
    """A stream of the decoded tiles of files that appear below root."""
    tiles.configure(spark)
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(root)
    at = {c: paths.coordinate(F.col("path"), template, c).alias(c) for c in "xyz"}
    return tiles.decode(files.select(at["z"], at["x"], at["y"], "content").where("z >= 0 AND x IS NOT NULL AND y IS NOT NULL"))


def touched(changed: DataFrame, levels: int) -> DataFrame:
    """The tiles up to ``levels`` levels out that tiles (z, x, y) are part of."""
    df = changed.select("z", "x", "y", F.explode(F.sequence(F.lit(1), F.least(F.lit(levels), F.col("z")))).alias("n"))
    up = lambda c: F.call_function("shiftright", F.col(c), F.col("n"))
    return df.select((F.col("z") - F.col("n")).cast("int").alias("z"), up("x").alias("x"), up("y").alias("y")).distinct()


def renewed(level: DataFrame, changed: DataFrame, method: str = "lanczos3") -> DataFrame:
    """The parents of changed tiles (z, x, y), made again from the tiles of their level; for use in foreachBatch."""
    up = lambda c: F.shiftright(c, 1)
    parents = changed.select(F.col("z").alias("pz"), up("x").alias("px"), up("y").alias("py")).distinct()
    members = level.join(parents, (F.col("z") == F.col("pz")) & (up("x") == F.col("px")) & (up("y") == F.col("py")), "left_semi")
    return tiles.downsample(members.select(*level.columns), method)
