"""The named queries of the raster operators, each with its SQL where SQL can express it.

The relations are derived from the driver's tables: pixels of a 256 x 256 raster from lineitem (level 4, tiles of 16),
and tile paths from orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmill.operators import grid, paths
from quadmill.operators import pixels as P
from quadmill.plans import tiles as T
from quadmill.plans.sql import ORACLES as ORACLES
from quadmill.store import keep

SIZE, LEVEL, SIDE = 16, 4, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse raster: a pixel for each (l_orderkey, l_partkey) modulo 256."""
    t = table(spark, sf_dir, "lineitem")
    by = t.groupBy((F.col("l_orderkey") % SIDE).cast("int").alias("gx"), (F.col("l_partkey") % SIDE).cast("int").alias("gy"))
    px = by.agg(
        (F.sum(F.col("l_quantity").cast("long")) % 256).cast("int").alias("r"),
        (F.max("l_suppkey") % 256).cast("int").alias("g"),
        F.min("l_linenumber").cast("int").alias("b"),
        (1 + F.count(F.lit(1)) % 255).cast("int").alias("a"),
    )
    return px.select(F.lit(LEVEL).alias("z"), "gx", "gy", "r", "g", "b", "a")


def few_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same raster in six opaque colours, so that equal neighbours occur."""
    px = pixels(spark, sf_dir)
    return px.select("z", "gx", "gy", (F.col("r") % 3).alias("r"), (F.col("g") % 2).alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a"))


def paths_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile paths in the three templates; one order in ten has a malformed one."""
    t = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 64).cast("int").alias("x"), (F.col("o_orderkey") % 64).cast("int").alias("y"), (F.col("o_orderkey") % 30).cast("int").alias("k"), F.col("o_orderkey").alias("id"))
    z = F.when(F.col("k") == 20, 0).otherwise(6)
    dot = F.when(F.col("k") == 0, "png").otherwise(".png")
    middle = lambda sep: F.when(F.col("k") == 10, F.col("x").cast("string")).otherwise(F.concat_ws(sep, F.col("x"), F.col("y")))
    return t.select(
        "id",
        F.concat(F.lit("/tiles/"), z.cast("string"), F.lit("/"), middle("/"), dot).alias("osm"),
        F.concat(F.lit("/tiles/TileExport_"), z.cast("string"), F.lit("_"), middle("_"), dot).alias("zxy"),
        F.concat(F.lit("/tiles/griddata_"), middle("_"), F.lit("_"), z.cast("string"), dot).alias("xyz"),
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tiles of orders at level 6."""
    t = table(spark, sf_dir, "orders")
    return t.select(F.lit(6).alias("z"), (F.col("o_custkey") % 64).cast("int").alias("x"), (F.col("o_orderkey") % 64).cast("int").alias("y")).distinct()


def half_average_nodata(spark, sf_dir):
    return P.half_average(pixels(spark, sf_dir))


def pyramid_levels(spark, sf_dir):
    return P.pyramid(keep(pixels(spark, sf_dir), "pixels"), 4, keep).groupBy("z").agg(F.count(F.lit(1)).alias("px"), *[F.sum(c).alias(c) for c in P.CHANNELS])


def alpha_mask_half(spark, sf_dir):
    return P.half_any(pixels(spark, sf_dir))


def lanczos_mask_rule(spark, sf_dir):
    px = pixels(spark, sf_dir)
    resampled = P.pack(F.col("r"), F.col("g"), F.col("b"), F.col("a") % 4)
    return px.select("gx", "gy", P.lanczos_mask(F.col("r") % 3 != 0, resampled).alias("v"))


def data_count_tile(spark, sf_dir):
    return P.data_count(pixels(spark, sf_dir), SIZE)


def data_count_roi(spark, sf_dir):
    return P.data_count(pixels(spark, sf_dir), SIZE, (2, 3, 9, 12))


def all_tiles(spark: SparkSession, size: int) -> DataFrame:
    """Every tile of the raster, with data or not."""
    side = SIDE // size
    return spark.range(side * side).select(F.lit(LEVEL).alias("z"), (F.col("id") % side).cast("int").alias("x"), F.expr(f"CAST(id DIV {side} AS INT)").alias("y"))


def any_data_tile(spark, sf_dir):
    """Tiles of 2 x 2 pixels, of which some have no data."""
    return P.any_data(pixels(spark, sf_dir), all_tiles(spark, 2), 2)


def any_data_box(spark, sf_dir):
    """One row of three pixels in each tile."""
    return P.any_data(pixels(spark, sf_dir), all_tiles(spark, SIZE), SIZE, (4, 7, 6, 7))


def roi_nonempty(spark, sf_dir):
    return P.children_with_data(pixels(spark, sf_dir), SIZE)


def palette_size(spark, sf_dir):
    return P.statistics(pixels(spark, sf_dir), SIZE).select("z", "x", "y", "n_colors")


def palette_order(spark, sf_dir):
    return P.palette(few_colours(spark, sf_dir).withColumn("a", F.when(F.col("r") == 1, 100).otherwise(255)), SIZE).select("z", "x", "y", F.col("place").cast("int").alias("place"), "v", F.col("first_px").cast("int").alias("first_px"))


def png_color_type(spark, sf_dir):
    return P.statistics(few_colours(spark, sf_dir).unionByName(pixels(spark, sf_dir).withColumn("z", F.lit(5))), SIZE).select("z", "x", "y", "color_type", "bit_depth")


def opaque_gray_flags(spark, sf_dir):
    px = few_colours(spark, sf_dir)
    return P.statistics(px.withColumn("g", F.col("r")).withColumn("b", F.when(F.col("gx") < 128, F.col("r")).otherwise(0)), SIZE).select("z", "x", "y", "is_opaque", "is_gray")


def channel_pack_unpack(spark, sf_dir):
    px = P.packed(pixels(spark, sf_dir))
    return px.select("gx", "gy", "v", *[x.alias(c) for c, x in P.unpack(F.col("v")).items()])


def pixel_distance(spark, sf_dir):
    px = P.packed(pixels(spark, sf_dir))
    right = px.select((F.col("gx") - 1).alias("gx"), "gy", F.col("v").alias("w"))
    return px.join(right, ["gx", "gy"]).select("gx", "gy", P.distance(F.col("v"), F.col("w")).alias("distance"), P.similar(F.col("v"), F.col("w")).alias("similar"))


def blend_levels(spark, sf_dir):
    px = P.packed(pixels(spark, sf_dir))
    right = px.select((F.col("gx") - 1).alias("gx"), "gy", F.col("v").alias("w"))
    v, w = F.col("v"), F.col("w")
    return px.join(right, ["gx", "gy"]).select("gx", "gy", P.blend(v, w, 1, 3, 2).alias("b13"), P.blend(v, w, 3, 1, 2).alias("b31"), P.blend(v, w, 1, 1, 1).alias("b11"))


def nn_enlarge(spark, sf_dir):
    return P.nearest(pixels(spark, sf_dir), 2)


def nn_bitmask(spark, sf_dir):
    """An enlarged raster where the half-size raster, enlarged, has data."""
    px = pixels(spark, sf_dir)
    return P.masked(P.nearest(px, 1), P.nearest(px.where("r % 2 = 0"), 1)).groupBy("gy").agg(F.count(F.lit(1)).alias("px"), F.sum("gx").alias("sum_gx"), F.sum("r").alias("sum_r"))


def epx_enlarge(spark, sf_dir):
    return P.epx(few_colours(spark, sf_dir), 8)


def eagle_enlarge(spark, sf_dir):
    return P.eagle(few_colours(spark, sf_dir), 8)


def bilinear_enlarge(spark, sf_dir):
    return P.bilinear(pixels(spark, sf_dir), 8, 16)


def edge_extend(spark, sf_dir):
    return P.extend_edges(pixels(spark, sf_dir), SIZE, 12, 13)


def nodata_fill_mean(spark, sf_dir):
    return P.fill_mean(pixels(spark, sf_dir), SIZE, 5)


def nodata_fill_mean_even(spark, sf_dir):
    return P.fill_mean(pixels(spark, sf_dir), SIZE, 4)


def tile_catalog_parse(spark, sf_dir):
    return paths.parsed(paths_of(spark, sf_dir).select(F.col("osm").alias("path")), "OSM")


def tile_parse_legacy(spark, sf_dir):
    p = paths_of(spark, sf_dir)
    zxy = paths.parsed(p.select(F.col("zxy").alias("path")), "ZXY")
    return zxy.unionByName(paths.parsed(p.select(F.col("xyz").alias("path")), "XYZ"))


def tile_path_format_all(spark, sf_dir):
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    return tiles(spark, sf_dir).select("z", "x", "y", *[paths.target(F.lit("/out/"), z, x, y, t).alias(t.lower()) for t in paths.TEMPLATES])


def tile_parse_lenient(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit("@"), (F.col("o_orderkey") % 10).cast("string"), F.lit("x")).alias("text"))
    return t.distinct().select("text", paths.digits(F.col("text")).alias("number"))


def path_parts(spark, sf_dir):
    p = F.col("osm")
    df = paths_of(spark, sf_dir).select("id", "osm")
    return df.select("id", *[paths.slash(p, n).alias(f"slash{n}") for n in (0, 2, 9)], paths.folder(p).alias("folder"), paths.extension(p).alias("extension"), paths.joined(paths.folder(p), F.lit("/a.png")).alias("joined"))


def tile_latest(spark, sf_dir):
    """Of the files of one tile, the last by path."""
    p = paths_of(spark, sf_dir).select(F.regexp_replace("osm", r"\.png$", F.concat(F.lit("."), F.col("id").cast("string"))).alias("path"))
    return grid.latest(paths.parsed(p, "OSM"))


def tile_counts(spark, sf_dir):
    return grid.counts(tiles(spark, sf_dir))


def quad_clusters(spark, sf_dir):
    return grid.clusters(tiles(spark, sf_dir))


def children_expand(spark, sf_dir):
    return grid.children(tiles(spark, sf_dir), 2)


def roi_for_children(spark, sf_dir):
    df = grid.children(tiles(spark, sf_dir), 2)
    return df.select("child_z", "child_x", "child_y", grid.roi(F.col("child_x"), 2, 256).alias("roi_x"), grid.roi(F.col("child_y"), 2, 256).alias("roi_y"), F.lit(256 >> 2).alias("roi_size"))


def quadrant_offset(spark, sf_dir):
    return tiles(spark, sf_dir).select("z", "x", "y", grid.quadrant(F.col("x"), 256).alias("off_x"), grid.quadrant(F.col("y"), 256).alias("off_y"))


def kernel_padding(spark, sf_dir):
    """Padded region and destination of each kernel at 256 pixels and one level, and the region's clamp for each child column."""
    kernels = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(k).alias("extent"), F.lit(r).alias("reach")) for m, k, r in grid.padding()])
    at = tiles(spark, sf_dir).select((F.col("x") % 2 * 128).alias("roi_x")).distinct()
    df = at.select("roi_x", F.inline(kernels))
    return df.select("method", "extent", "reach", "roi_x", (128 + F.col("reach")).alias("roi_w"), (256 + 2 * F.col("reach")).alias("dest_w"), F.least(128 + F.col("reach"), 256 - F.col("roi_x")).cast("int").alias("copy_w"))


def dir_sort(spark, sf_dir):
    """Names of a folder, folders first, then by name."""
    p = paths_of(spark, sf_dir).select(F.regexp_extract("osm", "^/tiles/([^/]*)/(.*)$", 1).alias("folder"), F.regexp_extract("osm", "^/tiles/([^/]*)/(.*)$", 2).alias("rest"))
    names = p.select("folder", F.substring_index("rest", "/", 1).alias("name"), F.col("rest").contains("/").alias("is_dir")).distinct()
    return names.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct((~F.col("is_dir")).alias("is_file"), "name"))).alias("s")).select("folder", F.posexplode("s").alias("place", "x")).select("folder", F.col("place").cast("int").alias("place"), "x.name", (~F.col("x.is_file")).alias("is_dir"))


QUERIES = {
    f.__name__: f
    for f in (
        half_average_nodata, pyramid_levels, alpha_mask_half, lanczos_mask_rule, data_count_tile, data_count_roi, any_data_tile, roi_nonempty,
        palette_size, palette_order, png_color_type, opaque_gray_flags, channel_pack_unpack, pixel_distance, blend_levels, nn_enlarge, nn_bitmask,
        epx_enlarge, eagle_enlarge, bilinear_enlarge, edge_extend, nodata_fill_mean, tile_catalog_parse, tile_parse_legacy, tile_path_format_all,
        tile_parse_lenient, path_parts, tile_counts, quad_clusters, children_expand, roi_for_children, quadrant_offset, kernel_padding, dir_sort, tile_latest,
        nodata_fill_mean_even, any_data_box,
    )
}
QUERIES |= T.queries(pixels, few_colours)
