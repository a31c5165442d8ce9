"""Tile form, sources, sinks and the command line, end to end on trees of PNG files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadmill import cli
from quadmill.functions import kernels as K
from quadmill.functions import png
from quadmill.operators import paths
from quadmill.operators import pixels as P
from quadmill.operators import tiles as T
from quadmill.sources import png_tree

SIZE = 8


def tree(root, template="OSM", z=5, seed=3):
    """A few tiles, one of them empty, one file that is no PNG, one with a bad path; the tiles by place."""
    rng = np.random.default_rng(seed)
    made = {}
    name = {"OSM": "{z}/{x}/{y}.png", "ZXY": "{z}/TileExport_{z}_{x}_{y}.png", "XYZ": "{z}/griddata_{x}_{y}_{z}.png"}[template]
    for x, y in [(4, 6), (5, 6), (4, 7), (5, 7), (8, 8), (11, 9)]:
        px = rng.integers(0, 4, (SIZE, SIZE, 4), np.uint8) * 60
        px[..., 3] = np.where(rng.random((SIZE, SIZE)) < 0.3, 0, 255)
        px[px[..., 3] == 0] = 0
        if (x, y) == (11, 9):
            px[:] = 0
        made[z, x, y] = px
        put(root, name.format(x=x, y=y, z=z), png.encode(px))
    put(root, name.format(x=20, y=20, z=z), b"no png")
    put(root, "readme.png", b"x")
    return made


def put(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def arrays(df):
    return {(r.z, r.x, r.y): np.frombuffer(r.rgba, np.uint8).reshape(r.height, r.width, 4) for r in df.collect()}


@pytest.mark.parametrize("template", paths.TEMPLATES)
def test_reads_and_writes_every_template(spark, tmp_path, template):
    made = tree(tmp_path / "in", template)
    assert png_tree.catalog(spark, str(tmp_path / "in"), template).count() == len(made) + 1
    got = png_tree.read_tiles(spark, str(tmp_path / "in"), template)
    for other in paths.TEMPLATES:
        png_tree.write_tiles(got, str(tmp_path / other), other)
        again = arrays(png_tree.read_tiles(spark, str(tmp_path / other), other))
        assert again.keys() == made.keys() and all((again[k] == made[k]).all() for k in made)


def test_downsample(spark, tmp_path):
    made = tree(tmp_path)
    source = png_tree.read_tiles(spark, str(tmp_path))
    for method in K.HALF_METHODS:
        got = arrays(T.downsample(source, method))
        assert got.keys() == {(4, x >> 1, y >> 1) for _, x, y in made}
        for (z, x, y), px in made.items():
            h = SIZE // 2
            assert (got[4, x >> 1, y >> 1][(y & 1) * h :][:h, (x & 1) * h :][:, :h] == K.half(px, method)).all()
    flat = sorted(map(tuple, P.half_average(T.to_pixels(source)).collect()))
    assert flat == sorted(map(tuple, T.to_pixels(T.downsample(source, "average")).collect()))
    with pytest.raises(ValueError):
        T.downsample(source, "epx")


@pytest.mark.parametrize("method", K.ENLARGE_METHODS)
def test_enlarge(spark, tmp_path, method):
    made = tree(tmp_path)
    source = png_tree.read_tiles(spark, str(tmp_path))
    got = arrays(T.enlarge(source, 1, method))
    want = {}
    for (z, x, y), px in made.items():
        for cx in (2 * x, 2 * x + 1):
            for cy in (2 * y, 2 * y + 1):
                if (child := K.enlarge_child(px, cx, cy, 1, method)) is not None:
                    want[z + 1, cx, cy] = child
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
    assert T.enlarge(source, 2, method).count() > 0


def test_pyramid_and_statistics(spark, tmp_path):
    made = tree(tmp_path)
    source = png_tree.read_tiles(spark, str(tmp_path))
    levels = T.pyramid(source, 5, 2, "average")
    assert {r.z for r in levels.select("z").distinct().collect()} == {4, 3, 2}
    for r in T.statistics(source).collect():
        px = made[r.z, r.x, r.y]
        assert r.data_px == (px[..., 3] > 0).sum() and r.n_colors == len(np.unique(K.packed(px)))
        assert (r.color_type, r.bit_depth) == (png.encode(px)[25], png.encode(px)[24])


def test_command_line(spark, tmp_path):
    made = tree(tmp_path / "in")
    o = cli.options([str(tmp_path / "in"), str(tmp_path / "out"), "-reprocess", "-outX", "-interpAV", "-zOut"])
    assert (o.write, o.method, o.inward, o.reprocess) == ("XYZ", "average", False, True)
    cli.execute(spark, o)
    out = arrays(png_tree.read_tiles(spark, str(tmp_path / "out"), "XYZ"))
    assert {k for k in out if k[0] == 5} == set(made) and len([k for k in out if k[0] == 4]) == 3
    assert os.path.exists(tmp_path / "in" / "5" / "4" / "6.png")
    cli.execute(spark, cli.options([str(tmp_path / "in"), str(tmp_path / "deeper"), "-zIn", "-interpEA"]))
    assert {k[0] for k in arrays(png_tree.read_tiles(spark, str(tmp_path / "deeper")))} == {6}
    assert cli.main([]) == 2 and cli.main(["-help"]) == 0
    for bad in (["a", "b", "-interpZZ"], ["a", "b", "-inQ"], ["a", "b", "-what"]):
        with pytest.raises(ValueError):
            cli.options(bad)
    with pytest.raises(ValueError):
        os.makedirs(tmp_path / "none" / "x")
        put(tmp_path, "none/x/a.txt", b"")
        cli.execute(spark, cli.options([str(tmp_path / "none"), str(tmp_path / "o")]))


def test_delete_only_after_writing(spark, tmp_path):
    made = tree(tmp_path / "in", "ZXY")
    cli.execute(spark, cli.options([str(tmp_path / "in"), str(tmp_path / "out"), "-inZXY", "-reprocess", "-delete", "-interpAV"]))
    left = {f for _, _, names in os.walk(tmp_path / "in") for f in names if not f.endswith(".crc")}
    assert left == {"TileExport_5_20_20.png", "readme.png"}
    assert len([k for k in arrays(png_tree.read_tiles(spark, str(tmp_path / "out"))) if k[0] == 5]) == len(made)


@pytest.mark.parametrize(
    ("template", "path", "want"),
    [
        ("OSM", "/tiles/13/6919/3522.png", (13, 6919, 3522)), ("OSM", "tiles/13/6/7.png", (13, 6, 7)), ("OSM", "/13/6/7.png", (13, 6, 7)), ("OSM", "/t/13/6919/3522@2x.png", None),
        ("OSM", "/t/13/6919/3522", None), ("OSM", "/t/0/0/0.png", None), ("ZXY", "TileExport_13_6919_3522.png", (13, 6919, 3522)), ("XYZ", "griddata_6919_3522_13.png", (13, 6919, 3522)),
        ("XYZ", "griddata_6919_3522.png", None), ("OSM", "/t/13/99999999999/1.png", None), ("OSM", None, None),
    ],
)
def test_paths(spark, template, path, want):
    rows = paths.parsed(spark.createDataFrame([(path,)], "path string"), template).collect()
    assert [(r.z, r.x, r.y) for r in rows] == ([want] if want else [])


def test_path_functions(spark):
    rows = spark.createDataFrame([("1a2",), ("7@2x",), ("",), ("3522",)], "t string").select(paths.digits(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [102, 7020, 0, 3522]
    with pytest.raises(ValueError):
        paths.coordinate(F.lit("x"), "TMS", "x")


def test_streaming(spark, tmp_path):
    from quadmill.streaming import tiles as S

    made = tree(tmp_path / "in")
    q = S.arriving(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    arrived = spark.table("arrived")
    assert arrays(arrived).keys() == made.keys()
    assert {(r.z, r.x, r.y) for r in S.touched(arrived, 2).collect()} == {(5 - n, x >> n, y >> n) for _, x, y in made for n in (1, 2)}
    one = arrived.where("x = 4 AND y = 6").select("z", "x", "y")
    got, whole = arrays(S.renewed(arrived, one, "average")), arrays(T.downsample(arrived, "average"))
    assert got.keys() == {(4, 2, 3)} and (got[4, 2, 3] == whole[4, 2, 3]).all()


def test_a_pixel_given_twice_counts_as_its_greatest(spark):
    rows = [(3, 1, 1, 5, 0, 0, 255), (3, 1, 1, 9, 0, 0, 255), (3, 0, 1, 7, 0, 0, 255), (3, 9, 9, 1, 1, 1, 255)]
    px = spark.createDataFrame(rows, "z int, gx int, gy int, r int, g int, b int, a int")
    back = T.to_pixels(T.from_pixels(px, 8))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows[1:]))
    once = spark.createDataFrame(rows[1:], px.schema)
    for f in (lambda x: P.eagle(x, 8), lambda x: P.epx(x, 8), lambda x: P.bilinear(x, 8, 16)):
        assert sorted(map(tuple, f(px).collect())) == sorted(map(tuple, f(once).collect()))


def test_any_data_and_recompress(spark):
    px = spark.createDataFrame([(3, 1, 1, 5, 0, 0, 255), (3, 12, 3, 7, 0, 0, 255)], "z int, gx int, gy int, r int, g int, b int, a int")
    own = T.from_pixels(px, 8)
    assert sorted(map(tuple, T.any_data(own, (0, 0, 3, 2)).collect())) == [(3, 0, 0, True), (3, 1, 0, False)]
    catalog = spark.createDataFrame([(3, 0, 0), (3, 1, 0), (3, 1, 1)], "z int, x int, y int")
    assert sorted(map(tuple, P.any_data(px, catalog, 8).collect())) == [(3, 0, 0, True), (3, 1, 0, True), (3, 1, 1, False)]
    files = T.encode(own, 0).withColumnRenamed("png", "content")
    again = T.recompress(files.unionByName(spark.createDataFrame([(1, 0, 0, b"no png")], "z int, x int, y int, content binary"))).collect()
    assert len(again) == 2 and all(r.bytes_after == len(r.png) <= r.bytes_before for r in again) and any(r.bytes_after < r.bytes_before for r in again)
    assert sorted(map(tuple, T.decode(spark.createDataFrame([(r.z, r.x, r.y, r.png) for r in again], "z int, x int, y int, content binary")).collect())) == sorted(map(tuple, own.collect()))
