"""The raster as tiles: one row for each tile, z, x, y, width, height, rgba (binary, rows first, R G B A).

Kernels run on Arrow batches, never on single rows through the JVM.  Halving happens before the shuffle, so only a
quarter of the bytes move, keyed by the parent tile; enlarging does not shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadmill.functions import kernels as K
from quadmill.functions import png
from quadmill.operators import pixels as P
from quadmill.ship import ship

TILE = "z int, x int, y int, width int, height int, rgba binary"
_NAMES = ["z", "x", "y", "width", "height", "rgba"]


def configure(spark: SparkSession, rows_per_batch: int = 64) -> None:
    """Small Arrow batches: a tile of 256 x 256 has a quarter of a megabyte."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))
    ship(spark)


def _array(rgba: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4)


def _map(df: DataFrame, each: Callable[..., list[tuple]], schema: str, columns: list[str]) -> DataFrame:
    """Rows of df through ``each``, which makes any number of rows of one."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for values in zip(*(b.column(c).to_pylist() for c in columns)) for r in each(*values)]
            data = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, types)], names)

    ship(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def decode(files: DataFrame) -> DataFrame:
    """Tiles of files (z, x, y, content: bytes of a PNG); those that are not PNG are left out."""

    def each(z, x, y, content):
        try:
            px = png.decode(content or b"")
        except png.NotPNG:
            return []
        return [(z, x, y, px.shape[1], px.shape[0], px.tobytes())]

    return _map(files, each, TILE, ["z", "x", "y", "content"])


def encode(tiles: DataFrame, level: int = 9) -> DataFrame:
    """z, x, y and the smallest lossless PNG of each tile."""
    return _map(tiles, lambda z, x, y, w, h, rgba: [(z, x, y, png.encode(_array(rgba, w, h), level))], "z int, x int, y int, png binary", _NAMES)


def from_pixels(px: DataFrame, size: int) -> DataFrame:
    """Tiles of a pixel relation; those without data have no row."""

    def each(z, x, y, v):
        return [(z, x, y, size, size, np.array(v, "<u4").tobytes())]

    rois = P.regions(px, size).select("z", F.col("rx").cast("int").alias("x"), F.col("ry").cast("int").alias("y"), "v")
    return _map(rois, each, TILE, ["z", "x", "y", "v"])


def to_pixels(tiles: DataFrame) -> DataFrame:
    """The pixels with data of all tiles, at global places."""
    schema = "z int, gx int, gy int, r int, g int, b int, a int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z, x, y, w, h, rgba in zip(*(b.column(c).to_pylist() for c in _NAMES)):
                px = _array(rgba, w, h)
                py, at = np.nonzero(px[..., 3])
                own = px[py, at].astype(np.int32)
                columns = [np.full(len(at), z), at + x * w, py + y * h, *own.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int32)) for c in columns], [c.split()[0] for c in schema.split(", ")])

    ship(tiles.sparkSession)
    return tiles.select(*_NAMES).mapInArrow(run, schema)


def downsample(tiles: DataFrame, method: str = "lanczos3") -> DataFrame:
    """One level out.  A parent has the tiles it has; the others' quadrants stay NODATA.  Of rows for one tile, one is
    taken (the greatest by content), whatever their order."""
    if method not in K.HALF_METHODS:
        raise ValueError(f"{method} cannot halve; use one of {K.HALF_METHODS}")

    def each(z, x, y, w, h, rgba):
        return [(z - 1, x >> 1, y >> 1, w, h, 2 * (y & 1) + (x & 1), K.half(_array(rgba, w, h), method).tobytes())]

    quarters = _map(tiles, each, "z int, x int, y int, width int, height int, q int, rgba binary", _NAMES)
    by = quarters.groupBy("z", "x", "y").agg(
        F.max("width").alias("width"), F.max("height").alias("height"), F.min("width").alias("w"), F.min("height").alias("h"),
        *[F.max(F.when(F.col("q") == q, F.col("rgba"))).alias(f"q{q}") for q in range(4)],
    )

    def compose(z, x, y, width, height, w, h, *quads):
        if (w, h) != (width, height):
            raise ValueError(f"tiles of several sizes meet in {z}/{x}/{y}")
        out = np.zeros((height, width, 4), np.uint8)
        for q, data in enumerate(quads):
            if data is not None:
                out[(q >> 1) * (h // 2) :, (q & 1) * (w // 2) :][: h // 2, : w // 2] = _array(data, w // 2, h // 2)
        return [(z, x, y, width, height, out.tobytes())]

    return _map(by, compose, TILE, ["z", "x", "y", "width", "height", "w", "h", "q0", "q1", "q2", "q3"])


def enlarge(tiles: DataFrame, shift: int = 1, method: str = "epx", compat: bool = False) -> DataFrame:
    """``shift`` levels in; children without data have no row.  epx, eagle and xbr are repeated for more than one level."""
    if method not in K.ENLARGE_METHODS:
        raise ValueError(f"{method} cannot enlarge; use one of {K.ENLARGE_METHODS}")
    if method in ("epx", "eagle", "xbr") and shift > 1:
        return enlarge(enlarge(tiles, 1, method, compat), shift - 1, method, compat)

    def each(z, x, y, w, h, rgba):
        px, n, out = _array(rgba, w, h), 1 << shift, []
        for cy in range(y * n, y * n + n):
            for cx in range(x * n, x * n + n):
                child = K.enlarge_child(px, cx, cy, shift, method, compat)
                if child is not None:
                    out.append((z + shift, cx, cy, w, h, child.tobytes()))
        return out

    return _map(tiles, each, TILE, _NAMES)


def pyramid(tiles: DataFrame, top: int, least_z: int = 0, method: str = "lanczos3", keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Levels top - 1 to least_z, each from the one before; keep(df, tag) writes a level before the next reads it."""
    last, out = tiles, None
    for z in range(top - 1, least_z - 1, -1):
        last = downsample(last, method)
        if keep:
            last = keep(last, f"level{z}")
        out = last if out is None else out.unionByName(last)
    return tiles.limit(0) if out is None else out


def statistics(tiles: DataFrame) -> DataFrame:
    """By tile: pixels with data, distinct colours (257: more than 256), and the PNG form that suits."""

    def each(z, x, y, w, h, rgba):
        px = _array(rgba, w, h)
        found = png.palette_of(px)
        colours = 257 if found is None else len(found[0])
        gray = found is not None and bool((found[0][:, :1] == found[0][:, 1:3]).all())
        opaque = bool((px[..., 3] == 255).all())
        kind, depth = png.colour_type(colours, opaque, gray, w)
        return [(z, x, y, int(np.count_nonzero(px[..., 3])), colours, opaque, gray, kind, depth)]

    return _map(tiles, each, "z int, x int, y int, data_px long, n_colors long, is_opaque boolean, is_gray boolean, color_type int, bit_depth int", _NAMES)


def filled(tiles: DataFrame, cell: int) -> DataFrame:
    """Tiles whose NODATA near data takes the mean of its neighbourhood (see ``kernels.fill_mean``)."""
    return _map(tiles, lambda z, x, y, w, h, rgba: [(z, x, y, w, h, K.fill_mean(_array(rgba, w, h), cell).tobytes())], TILE, _NAMES)


def filled_padding(tiles: DataFrame, width: int, height: int, edges: bool = True, means: bool = True) -> DataFrame:
    """Padded tiles with their edges extended and their NODATA filled (see ``kernels.fill_nodata``)."""
    return _map(tiles, lambda z, x, y, w, h, rgba: [(z, x, y, w, h, K.fill_nodata(_array(rgba, w, h), width, height, edges, means).tobytes())], TILE, _NAMES)


def any_data(tiles: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """z, x, y and whether the tile, or the box x0, y0, x1, y1 (inclusive) in it, holds a pixel with data."""
    x0, y0, x1, y1 = box or (0, 0, 1 << 30, 1 << 30)
    return _map(tiles, lambda z, x, y, w, h, rgba: [(z, x, y, bool(_array(rgba, w, h)[y0 : y1 + 1, x0 : x1 + 1, 3].any()))], "z int, x int, y int, any_data boolean", _NAMES)


def recompress(files: DataFrame, level: int = 9) -> DataFrame:
    """z, x, y, png, bytes_before and bytes_after of files (z, x, y, content): each PNG encoded anew, or as it was where
    that is no smaller; what is no PNG is left out."""

    def each(z, x, y, content):
        try:
            new = png.encode(png.decode(content or b""), level)
        except png.NotPNG:
            return []
        new = new if len(new) < len(content) else bytes(content)
        return [(z, x, y, new, len(content), len(new))]

    return _map(files, each, "z int, x int, y int, png binary, bytes_before long, bytes_after long", ["z", "x", "y", "content"])
