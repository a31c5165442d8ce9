"""Queries on the tile form, given as pixels so that they compare with the pixel form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from quadmill.operators import tiles as T
from quadmill.store import keep

SIZE = 16


def queries(pixels: Callable, few_colours: Callable) -> dict[str, Callable]:
    def tile_half_average(spark, sf_dir):
        return T.to_pixels(T.downsample(T.from_pixels(pixels(spark, sf_dir), SIZE), "average"))

    def enlarged(method, source=few_colours):
        def query(spark, sf_dir):
            return T.to_pixels(T.enlarge(T.from_pixels(source(spark, sf_dir), SIZE), 1, method))

        query.__name__ = f"tile_{method}"
        return query

    def tile_lanczos_half(spark, sf_dir):
        return T.to_pixels(T.downsample(T.from_pixels(pixels(spark, sf_dir), SIZE), "lanczos3"))

    def tile_statistics(spark, sf_dir):
        return T.statistics(T.from_pixels(pixels(spark, sf_dir), SIZE)).select("z", "x", "y", "data_px", "n_colors")

    def tile_png_round_trip(spark, sf_dir):
        return T.to_pixels(T.decode(T.encode(T.from_pixels(pixels(spark, sf_dir), SIZE)).withColumnRenamed("png", "content")))

    def tile_png_sizes(spark, sf_dir):
        return T.encode(T.from_pixels(few_colours(spark, sf_dir), SIZE)).select("z", "x", "y", F.octet_length("png").cast("long").alias("bytes"))

    def tile_recompress(spark, sf_dir):
        files = T.encode(T.from_pixels(few_colours(spark, sf_dir), SIZE), 0).withColumnRenamed("png", "content")
        return T.recompress(files).select("z", "x", "y", "bytes_before", "bytes_after")

    def tile_pyramid(spark, sf_dir):
        levels = T.pyramid(T.from_pixels(pixels(spark, sf_dir), SIZE), 4, 0, "average", keep)
        return T.to_pixels(levels).groupBy("z").agg(F.count(F.lit(1)).alias("px"), *[F.sum(c).alias(c) for c in "rgba"])

    one = [tile_half_average, tile_lanczos_half, tile_statistics, tile_png_round_trip, tile_png_sizes, tile_recompress, tile_pyramid]
    return {f.__name__: f for f in [*one, *map(enlarged, ("epx", "eagle", "xbr", "bilinear", "lanczos3", "lanczos5"))]}
