"""The relational raster: one row for each pixel that has data, z, gx, gy (global), r, g, b, a (1 to 255).

Absent rows are NODATA.  As blocks of 2 x 2 never straddle tiles of even size, halving is an aggregate on shifted
coordinates: partial aggregates run before the only shuffle, on keys that no place can crowd.  Neighbourhood kernels
gather one region of interest (a bounded array) and look neighbours up by index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadmill.functions.kernels import SIMILAR, box

CHANNELS = ("r", "g", "b", "a")


def pack(r: Column, g: Column, b: Column, a: Column) -> Column:
    """One long for a pixel, red lowest."""
    return a.cast("long") * (1 << 24) + b.cast("long") * (1 << 16) + g.cast("long") * (1 << 8) + r.cast("long")


def unpack(v: Column) -> dict[str, Column]:
    return {c: F.shiftright(v, 8 * i).bitwiseAND(255).cast("int") for i, c in enumerate(CHANNELS)}


def packed(px: DataFrame) -> DataFrame:
    """z, gx, gy, v."""
    return px.select("z", "gx", "gy", pack(*map(F.col, CHANNELS)).alias("v"))


def unpacked(px: DataFrame) -> DataFrame:
    """z, gx, gy, r, g, b, a of the pixels that have data."""
    return px.where(F.col("v") >= 1 << 24).select("z", "gx", "gy", *[x.alias(c) for c, x in unpack(F.col("v")).items()])


def _pair(u: Column, v: Column) -> Column:
    """Each channel's floored mean of two packed pixels; of one that is null or NODATA, the other."""
    # halves of each channel without their low bits, and the carry of two low bits: a mean within the long
    mask, low = 0x7F7F7F7F, 0x01010101
    mean = F.shiftright(u, 1).bitwiseAND(mask) + F.shiftright(v, 1).bitwiseAND(mask) + u.bitwiseAND(v).bitwiseAND(low)
    return F.when(u.isNotNull() & v.isNotNull(), mean).otherwise(F.coalesce(u, v))


def half_average(px: DataFrame) -> DataFrame:
    """One level out: pairs in a row first, then the two rows, floored each time; NODATA never mixes in."""
    v, odd_x, odd_y = F.col("v"), F.col("gx").bitwiseAND(1), F.col("gy").bitwiseAND(1)
    by = packed(px).groupBy((F.col("z") - 1).cast("int").alias("z"), F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy"))
    corner = lambda x, y: F.max(F.when((odd_x == x) & (odd_y == y), v))
    quad = by.agg(*[corner(x, y).alias(f"c{x}{y}") for y in (0, 1) for x in (0, 1)])
    rows = quad.select("z", "gx", "gy", _pair(F.col("c00"), F.col("c10")).alias("top"), _pair(F.col("c01"), F.col("c11")).alias("low"))
    return unpacked(rows.select("z", "gx", "gy", _pair(F.col("top"), F.col("low")).alias("v")))


def pyramid(px: DataFrame, levels: int, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """px and ``levels`` levels out, each made from the one before.  keep(df, tag), if given, writes a level so that the
    next does not compute it again."""
    out, last = px, px
    for i in range(levels):
        last = half_average(last)
        if keep:
            last = keep(last, f"level{i + 1}")
        out = out.unionByName(last)
    return out


def half_any(px: DataFrame) -> DataFrame:
    """The blocks of 2 x 2 that hold any data."""
    return px.where("a > 0").select((F.col("z") - 1).cast("int").alias("z"), F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy")).distinct()


def lanczos_mask(any_data: Column, v: Column) -> Column:
    """A resampled pixel under its mask: 0 where there was no data; alpha 1 and no colour where alpha came out 0."""
    return F.when(~any_data, F.lit(0)).when(F.shiftright(v, 24) == 0, F.lit(1 << 24)).otherwise(v).cast("long")


def tile_of(size: int) -> list[Column]:
    return [F.col("z"), F.expr(f"gx div {size}").cast("int").alias("x"), F.expr(f"gy div {size}").cast("int").alias("y")]


def statistics(px: DataFrame, size: int) -> DataFrame:
    """By tile: pixels with data, distinct colours, whether all are opaque, gray, and the PNG form that suits."""
    n = size * size
    v = pack(*map(F.col, CHANNELS))
    by = px.where("a > 0").groupBy(*tile_of(size)).agg(
        F.count(F.lit(1)).alias("data_px"),
        F.countDistinct(v).alias("shown"),
        F.min("a").alias("least_a"),
        F.min(F.when((F.col("r") == F.col("g")) & (F.col("r") == F.col("b")), 1).otherwise(0)).alias("gray"),
    )
    full = F.col("data_px") == n
    by = by.withColumn("n_colors", (F.col("shown") + F.when(full, 0).otherwise(1)).cast("long"))
    by = by.withColumn("is_opaque", full & (F.col("least_a") == 255)).withColumn("is_gray", F.col("gray") == 1)
    return by.select("z", "x", "y", "data_px", "n_colors", "is_opaque", "is_gray", *png_form(F.col("n_colors"), F.col("is_opaque"), F.col("is_gray"), size))


def png_form(colors: Column, opaque: Column, gray: Column, width: int) -> list[Column]:
    """color_type (0 gray, 2 RGB, 3 palette, 6 RGBA) and bit_depth of the smallest lossless PNG."""
    depth = F.lit(8)
    if width % 2 == 0:
        for bits, least in ((4, 1), (2, 4), (1, 8)):
            if width > least:
                depth = F.when(colors <= 1 << bits, bits).otherwise(depth)
    kind = F.when(colors > 256, F.when(opaque, 2).otherwise(6)).when((depth == 8) & opaque & gray, 0).otherwise(3)
    return [kind.cast("int").alias("color_type"), F.when(colors > 256, 8).otherwise(depth).cast("int").alias("bit_depth")]


def palette(px: DataFrame, size: int) -> DataFrame:
    """The colours of each tile with data, in palette order: those that are not opaque first, each part as first seen."""
    place = (F.col("gy") % size) * size + F.col("gx") % size
    by = px.where("a > 0").groupBy(*tile_of(size), pack(*map(F.col, CHANNELS)).alias("v")).agg(F.min(place).alias("first_px"))
    colours = F.sort_array(F.collect_list(F.struct((F.shiftright("v", 24) == 255).alias("opaque"), "first_px", "v")))
    listed = by.groupBy("z", "x", "y").agg(colours.alias("all"))  # a tile has size * size colours at most
    return listed.select("z", "x", "y", F.posexplode("all").alias("place", "c")).select("z", "x", "y", "place", "c.v", "c.first_px")


def data_count(px: DataFrame, size: int, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels with data by tile, of the whole tile or of the box x0, y0, x1, y1 (inclusive) in each."""
    px = px.where("a > 0")
    if box:
        x, y = F.col("gx") % size, F.col("gy") % size
        px = px.where(x.between(box[0], box[2]) & y.between(box[1], box[3]))
    return px.groupBy(*tile_of(size)).agg(F.count(F.lit(1)).alias("data_px"))


def children_with_data(px: DataFrame, size: int, shift: int = 1) -> DataFrame:
    """The child tiles whose part of the parent has data."""
    part = size >> shift
    at = lambda c: F.expr(f"{c} div {part}").cast("int")
    return px.where("a > 0").select((F.col("z") + shift).cast("int").alias("z"), at("gx").alias("x"), at("gy").alias("y")).distinct()


def nearest(px: DataFrame, shift: int = 1) -> DataFrame:
    """Every pixel as a block of 2^shift x 2^shift; no shuffle."""
    n = 1 << shift
    df = px.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    return df.select((F.col("z") + shift).cast("int").alias("z"), (F.col("gx") * n + F.col("i") % n).cast("int").alias("gx"), (F.col("gy") * n + F.expr(f"i div {n}")).cast("int").alias("gy"), *CHANNELS)


def masked(px: DataFrame, mask: DataFrame) -> DataFrame:
    """px where the mask's relation has data."""
    return px.join(mask.select("z", "gx", "gy"), ["z", "gx", "gy"], "left_semi")


def regions(px: DataFrame, size: int) -> DataFrame:
    """Dense regions of interest: z, rx, ry and v, an array of size * size packed pixels, rows first; 0 is NODATA."""
    place = (F.col("gy") % size) * size + F.col("gx") % size
    by = packed(px).groupBy("z", F.expr(f"gx div {size}").alias("rx"), F.expr(f"gy div {size}").alias("ry"))
    # of rows for one place the greatest counts
    cells = by.agg(F.sort_array(F.collect_list(F.struct(place.alias("i"), "v"))).alias("p"))
    last = F.filter("p", lambda x, j: F.coalesce(F.get("p", j + 1)["i"] != x["i"], F.lit(True)))
    cells = cells.select("z", "rx", "ry", F.map_from_entries(last).alias("cells"))
    # the map is scattered once; looked up by place it would be searched for each pixel
    pairs = F.sort_array(F.map_entries("cells"))
    cells = cells.withColumn("p", pairs)
    gaps = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(size * size - 1)), F.map_keys("cells")), lambda i: F.struct(i.alias("key"), F.lit(0).cast("long").alias("value")))
    dense = F.transform(F.sort_array(F.concat(F.col("p").cast("array<struct<key:int,value:bigint>>"), gaps.cast("array<struct<key:int,value:bigint>>"))), lambda x: x["value"])
    return cells.select("z", "rx", "ry", dense.alias("v"))


def _each(rois: DataFrame, size: int) -> DataFrame:
    df = rois.select("z", "rx", "ry", "v", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("i"))
    return df.withColumn("px", F.col("i") % size).withColumn("py", F.expr(f"i div {size}").cast("int"))


def _near(size: int, dy: int, dx: int) -> Column:
    """A neighbour, clamped to the region."""
    clamp = lambda c, d: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.col(c) + d))
    return F.get("v", clamp("py", dy) * size + clamp("px", dx))


def _doubled(df: DataFrame, size: int, four: list[Column]) -> DataFrame:
    """The four pixels of each source pixel, at their places one level in; NODATA left out."""
    df = df.select("z", "rx", "ry", "px", "py", F.posexplode(F.array(*four)).alias("q", "v")).where(F.col("v") >= 1 << 24)
    at = lambda r, p, q: ((F.col(r) * size + F.col(p)) * 2 + q).cast("int")
    return unpacked(df.select((F.col("z") + 1).cast("int").alias("z"), at("rx", "px", F.col("q") % 2).alias("gx"), at("ry", "py", F.expr("q div 2")).alias("gy"), "v"))


def epx(px: DataFrame, size: int) -> DataFrame:
    """EPX of each region: a corner takes a neighbour that two sides share, where opposite sides differ."""
    df = _each(regions(px, size), size)
    df = df.select("z", "rx", "ry", "px", "py", F.get("v", "i").alias("p"), _near(size, -1, 0).alias("up"), _near(size, 0, -1).alias("left"), _near(size, 0, 1).alias("right"), _near(size, 1, 0).alias("down"))
    use = (F.col("up") != F.col("down")) & (F.col("left") != F.col("right"))
    pick = lambda x, y: F.when(use & (F.col(x) == F.col(y)), F.col(x)).otherwise(F.col("p"))
    return _doubled(df, size, [pick("left", "up"), pick("right", "up"), pick("left", "down"), pick("right", "down")])


def eagle(px: DataFrame, size: int) -> DataFrame:
    """Eagle of each region: a corner takes its diagonal neighbour if the two sides beside it are the same."""
    df = _each(regions(px, size), size)
    near = {(dy, dx): _near(size, dy, dx).alias(f"n{dy + 1}{dx + 1}") for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    df = df.select("z", "rx", "ry", "px", "py", *near.values())
    n = lambda dy, dx: F.col(f"n{dy + 1}{dx + 1}")
    four = [F.when((n(0, dx) == n(dy, dx)) & (n(dy, dx) == n(dy, 0)), n(dy, dx)).otherwise(n(0, 0)) for dy in (-1, 1) for dx in (-1, 1)]
    return _doubled(df, size, four)


def bilinear(px: DataFrame, size: int, wide: int) -> DataFrame:
    """Integer bilinear of each region from size to ``wide`` pixels a side: z, rx, ry, px, py, r, g, b, a of every pixel."""
    step = ((size - 1) << 16) // (wide - 1)
    df = regions(px, size).select("z", "rx", "ry", "v", F.explode(F.sequence(F.lit(0), F.lit(wide * wide - 1))).alias("i"))
    df = df.withColumn("px", F.col("i") % wide).withColumn("py", F.expr(f"i div {wide}").cast("int"))
    low = {c: F.shiftright(F.col(c) * step, 16) for c in ("px", "py")}
    high = {c: F.least(low[c] + 1, F.lit(size - 1)) for c in low}
    weight = {c: F.shiftright(F.col(c) * step, 9).bitwiseAND(127) for c in low}
    at = lambda y, x: F.get("v", y * size + x)
    df = df.select("z", "rx", "ry", "px", "py", weight["px"].alias("wx"), weight["py"].alias("wy"), at(low["py"], low["px"]).alias("v00"), at(low["py"], high["px"]).alias("v10"), at(high["py"], low["px"]).alias("v01"), at(high["py"], high["px"]).alias("v11"))
    wx, wy = F.col("wx"), F.col("wy")

    def mix(c: str) -> Column:
        v = {k: unpack(F.col(k))[c] for k in ("v00", "v10", "v01", "v11")}
        return F.shiftright((v["v00"] * (128 - wx) + v["v10"] * wx) * (128 - wy) + (v["v01"] * (128 - wx) + v["v11"] * wx) * wy, 14).cast("int").alias(c)

    return df.select("z", F.col("rx").cast("int").alias("rx"), F.col("ry").cast("int").alias("ry"), F.col("px").cast("int").alias("px"), "py", *[mix(c) for c in CHANNELS])


def distance(v: Column, w: Column) -> Column:
    """The sum of all channels' differences of two packed pixels."""
    a, b = unpack(v), unpack(w)
    return sum((F.abs(a[c] - b[c]) for c in CHANNELS[1:]), F.abs(a["r"] - b["r"])).cast("int")


def similar(v: Column, w: Column) -> Column:
    a, b = unpack(v), unpack(w)
    out = F.abs(a["r"] - b["r"]) <= SIMILAR
    for c in CHANNELS[1:]:
        out = out & (F.abs(a[c] - b[c]) <= SIMILAR)
    return out


def blend(v: Column, w: Column, mv: int, mw: int, shift: int) -> Column:
    a, b = unpack(v), unpack(w)
    return pack(*[F.shiftright(a[c] * mv + b[c] * mw, shift) for c in CHANNELS])


def extend_edges(px: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """In tiles of ``size``: NODATA right of the first ``width`` columns and below the first ``height`` rows takes the
    last data column's pixel, then the last row's.  Pixels outside those bounds that have data stay."""
    n = lambda c: F.col(c) % size
    spread = lambda df, axis, edge: df.where(n(axis) == edge - 1).withColumn(axis, F.explode(F.sequence(F.col(axis) + 1, F.col(axis) + (size - edge))))
    columns = ["z", "gx", "gy", *CHANNELS]
    new = spread(px, "gx", width).select(*columns).join(px.select("z", "gx", "gy"), ["z", "gx", "gy"], "left_anti")
    wide = px.select(*columns).unionByName(new.select(*columns))
    new = spread(wide, "gy", height).select(*columns).join(wide.select("z", "gx", "gy"), ["z", "gx", "gy"], "left_anti")
    return wide.unionByName(new.select(*columns))


def fill_mean(px: DataFrame, size: int, cell: int) -> DataFrame:
    """NODATA within reach of data takes the rounded mean of the data in the box of the last data pixel, in reading
    order, that reaches it; boxes have ``cell`` pixels a side (see ``kernels.box``) and stay in their tile."""
    back, ahead = box(min(cell, size))
    px = px.where("a > 0").withColumn("tx", F.expr(f"gx div {size}")).withColumn("ty", F.expr(f"gy div {size}"))

    def scattered(low: int, high: int) -> DataFrame:
        """Every data pixel at each place (x, y) from ``low`` before it to ``high`` behind it."""
        steps = F.sequence(F.lit(-low), F.lit(high))
        near = px.select("*", F.explode(steps).alias("dx")).select("*", F.explode(steps).alias("dy"))
        near = near.select("z", "tx", "ty", (F.col("gx") + F.col("dx")).alias("x"), (F.col("gy") + F.col("dy")).alias("y"), "gx", "gy", *CHANNELS)
        return near.where((F.expr(f"x div {size}") == F.col("tx")) & (F.expr(f"y div {size}") == F.col("ty")) & (F.col("x") >= 0) & (F.col("y") >= 0))

    # a data pixel counts in the boxes of the places behind which it lies by no more than they reach ahead
    sums = scattered(ahead, back).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in CHANNELS])
    means = sums.select("z", F.col("x").alias("mx"), F.col("y").alias("my"), *[F.floor((2 * F.col(c) + F.col("n")) / (2 * F.col("n"))).cast("int").alias(c) for c in CHANNELS])
    reached = scattered(back, ahead).groupBy("z", "x", "y").agg(F.max_by(F.struct("gx", "gy"), F.struct("gy", "gx")).alias("last"))
    holes = reached.select("z", F.col("x").alias("gx"), F.col("y").alias("gy"), "last").join(px.select("z", "gx", "gy"), ["z", "gx", "gy"], "left_anti")
    filled = holes.select("z", "gx", "gy", F.col("last.gx").alias("mx"), F.col("last.gy").alias("my")).join(means, ["z", "mx", "my"])
    return px.select("z", "gx", "gy", *CHANNELS).unionByName(filled.select("z", F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), *CHANNELS))


def any_data(px: DataFrame, tiles: DataFrame, size: int, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """z, x, y and any_data of every tile (z, x, y) given: whether it, or the box x0, y0, x1, y1 (inclusive) in it, holds a pixel with data."""
    found = data_count(px, size, box).select("z", "x", "y", F.lit(True).alias("any_data"))
    return tiles.select("z", "x", "y").join(found, ["z", "x", "y"], "left").withColumn("any_data", F.coalesce("any_data", F.lit(False)))
