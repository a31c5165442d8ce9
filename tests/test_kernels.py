"""Kernels and the codec against hand-computed vectors, slow versions and properties."""

import random
import struct
import zlib

import numpy as np
import pytest

from quadmill.functions import kernels as K
from quadmill.functions import png


def gray(values, alpha=None):
    v = np.array(values, np.uint8)
    a = np.full(v.shape, 255, np.uint8) if alpha is None else np.array(alpha, np.uint8)
    return np.stack((v, v, v, a), -1)


def raster(seed, h=8, w=8, colours=4, holes=0.2):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (colours, 4), np.uint8)
    base[:, 3] = np.maximum(base[:, 3], 1)
    px = base[rng.integers(0, colours, (h, w))]
    px[rng.random((h, w)) < holes] = 0
    return px


N = None


@pytest.mark.parametrize(
    ("quad", "want"),
    [((255,) * 4, 255), ((0, 1, 0, 3), 0), ((1, 2, 2, 2), 1), ((100, N, 0, 0), 50), ((10, N, N, 21), 15), ((10, 20, N, 40), 27), ((N, N, N, 77), 77), ((N,) * 4, N)],
)
def test_half_average(quad, want):
    v = np.array([x or 0 for x in quad]).reshape(2, 2)
    a = np.array([0 if x is None else 255 for x in quad]).reshape(2, 2)
    out = K.half_average(gray(v, a))[0, 0]
    assert (out[3] == 0) if want is None else (out[0] == want and out[3] == 255)


def test_half_average_keeps_the_footprint():
    for seed in range(20):
        px = raster(seed, 16, 16, holes=0.6)
        assert ((K.half_average(px)[..., 3] > 0) == K.half_any(px)).all()
        assert ((K.half_lanczos(px, 3)[..., 3] > 0) == K.half_any(px)).all()


def test_mask_rule():
    any_data = np.array([[False, True, True]])
    px = np.array([[[1, 2, 3, 4], [9, 9, 9, 0], [9, 8, 7, 6]]], np.uint8)
    assert K.masked(px, any_data).tolist() == [[[0, 0, 0, 0], [0, 0, 0, 1], [9, 8, 7, 6]]]


@pytest.mark.parametrize(("a", "c", "b", "d", "want"), [(1, 1, 2, 3, [1, 9, 9, 9]), (1, 1, 2, 1, [9] * 4), (1, 2, 1, 3, [9, 1, 9, 9]), (1, 2, 3, 2, [9, 9, 2, 9]), (1, 2, 3, 3, [9, 9, 9, 3])])
def test_epx(a, c, b, d, want):
    out = K.epx(gray([[7, a, 8], [c, 9, b], [6, d, 5]]))
    assert out[2:4, 2:4, 0].ravel().tolist() == want


@pytest.mark.parametrize(("grid", "want"), [("115196784", [1, 9, 9, 9]), ("522692784", [9, 2, 9, 9]), ("561392334", [9, 9, 3, 9]), ("561794244", [9, 9, 9, 4])])
def test_eagle(grid, want):
    out = K.eagle(gray(np.array(list(map(int, grid))).reshape(3, 3)))
    assert out[2:4, 2:4, 0].ravel().tolist() == want


@pytest.mark.parametrize(("row", "wide", "want"), [([0, 255], 4, [0, 83, 169, 253]), ([10, 20, 30], 6, [10, 13, 17, 21, 25, 29]), ([0, 100, 200], 5, [0, 50, 100, 150, 200])])
def test_bilinear(row, wide, want):
    out = K.bilinear(gray([row] * len(row)), wide, wide)
    assert out[0, :, 0].tolist() == want and (out == out[0]).all()


def test_blend():
    x, y = gray([[100]]), gray([[200]])
    assert [int(K.blend(x, y, *m)[0, 0, 0]) for m in ((1, 3, 2), (3, 1, 2), (1, 1, 1))] == [175, 125, 150]


def test_padding():
    assert {m: K.reach_of(m) for m in ("bilinear", "lanczos3", "lanczos5")} == {"bilinear": 1, "lanczos3": 2, "lanczos5": 3}


def pixel(px, y, x):
    """A pixel as whole numbers, clamped to the edge."""
    h, w = px.shape[:2]
    return px[min(max(y, 0), h - 1), min(max(x, 0), w - 1)].astype(int)


def apart(p, q):
    return int(np.abs(p - q).sum())


def alike(p, q):
    return bool((np.abs(p - q) <= K.SIMILAR).all())


def turned(place, quarters):
    """A place (row, column) about the centre, turned by so many quarters to the left."""
    row, column = place
    for _ in range(quarters):
        row, column = -column, row
    return row, column


def edge_of(at):
    """What the rule says of the lower right corner: no edge, a weak one, or a strong one that is steep, flat or even; and the colour.

    at(row, column) is the neighbour there; the edge would run from the neighbour below to the one on the right."""
    centre, right, below, corner = at(0, 0), at(0, 1), at(1, 0), at(1, 1)
    if (centre == below).all() and (centre == right).all():
        return "none", centre
    along = sum(apart(centre, at(*p)) for p in ((-1, 1), (1, -1))) + sum(apart(corner, at(*p)) for p in ((0, 2), (2, 0))) + 4 * apart(below, right)
    across = sum(apart(below, at(*p)) for p in ((0, -1), (2, 1))) + sum(apart(right, at(*p)) for p in ((1, 2), (-1, 0))) + 4 * apart(centre, corner)
    colour = right if apart(centre, right) <= apart(centre, below) else below
    signs = [
        not alike(right, at(-1, 0)) and not alike(below, at(0, -1)),
        alike(centre, corner) and not alike(right, at(1, 2)) and not alike(below, at(2, 1)),
        alike(centre, at(1, -1)),
        alike(centre, at(-1, 1)),
    ]
    if along < across and any(signs):
        low, high = apart(right, at(1, -1)), apart(below, at(-1, 1))
        if high >= 2 * low and not alike(centre, at(1, -1)) and not alike(at(0, -1), at(1, -1)):
            return "steep", colour
        if low >= 2 * high and not alike(right, at(1, -1)) and not alike(at(-1, 0), at(-1, 1)):
            return "flat", colour
        return "even", colour
    return ("weak" if along <= across else "none"), colour


def slow_xbr(px):
    """One pixel at a time: each corner's edge, in four views that turn to the left, and its blend of quarters."""
    h, w = px.shape[:2]
    out = K.nearest(px, 2).astype(int)
    # quarters of the new colour in the corner itself, above it and left of it, as seen in the first view
    share = {"none": {}, "weak": {(1, 1): 1}, "even": {(1, 1): 2}, "steep": {(1, 1): 3, (1, -1): 1}, "flat": {(1, 1): 3, (-1, 1): 1}}
    for y in range(h):
        for x in range(w):
            for quarters in range(4):

                def at(row, column):
                    dy, dx = turned((row, column), quarters)
                    return pixel(px, y + dy, x + dx)

                kind, colour = edge_of(at)
                for place, new in share[kind].items():
                    row, column = turned(place, quarters)
                    target = 2 * y + (row > 0), 2 * x + (column > 0)
                    out[target] = (out[target] * (4 - new) + colour * new) // 4
    return out.astype(np.uint8)


def test_xbr():
    y, x = np.mgrid[0:8, 0:8]
    shapes = [gray(np.full((8, 8), 50)), gray((x > 3) * 200), gray((x + y > 7) * 200), gray((2 * x + y > 10) * 200), gray((x == 4) & (y == 4)) * np.uint8(1), raster(3), raster(4, holes=0.5), raster(5, colours=12)]
    for px in shapes:
        assert (K.xbr(px) == slow_xbr(px)).all()


def test_enlarging_gives_only_colours_that_were_there():
    for seed in range(5):
        px = raster(seed)
        seen = set(K.packed(px).ravel().tolist())
        assert set(K.packed(K.epx(px)).ravel().tolist()) <= seen and set(K.packed(K.eagle(px)).ravel().tolist()) <= seen
        assert (K.half_average(K.nearest(px, 2)) == px).all()


def test_children_cover_the_parent():
    px = raster(9, 16, 16, holes=0)
    whole = np.zeros((32, 32, 4), np.uint8)
    for cy in (6, 7):
        for cx in (4, 5):
            whole[(cy - 6) * 16 :][:16, (cx - 4) * 16 :][:, :16] = K.enlarge_child(px, cx, cy, 1, "nearest")
    assert (whole == K.nearest(px, 2)).all()
    px[:8, :8] = 0
    assert K.enlarge_child(px, 4, 6, 1, "bilinear") is None
    px[0, 0] = 1
    for method in K.ENLARGE_METHODS:
        assert K.enlarge_child(px, 4, 6, 1, method).shape == px.shape
    px[0, 0, 3], px[0, 1] = 0, 1
    with pytest.raises(ValueError):
        K.enlarge_child(px, 4, 6, 1, "average")
    with pytest.raises(ValueError):
        K.half(px, "nearest")


def slow_fill(px, cell):
    h, w = px.shape[:2]
    out = px.copy()
    if cell > h and cell > w:
        cell = max(h, w)
    before, after = ((cell - 1) // 2, (cell - 1) // 2) if cell % 2 else (cell // 2 - 1, cell // 2)
    for y in range(h):
        for x in range(w):
            if px[y, x, 3]:
                box = [(j, i) for j in range(max(y - before, 0), min(y + after + 1, h)) for i in range(max(x - before, 0), min(x + after + 1, w))]
                data = [px[p] for p in box if px[p][3]]
                mean = [int(sum(int(d[c]) for d in data) / len(data) + 0.5) for c in range(4)]
                for p in box:
                    if not px[p][3]:
                        out[p] = mean
    return out


def test_fill_mean_and_edges():
    px = raster(11, 12, 12, holes=0.7)
    for cell in (1, 2, 3, 4, 5, 8, 12, 13, 40):
        assert (K.fill_mean(px, cell) == slow_fill(px, cell)).all()
    padded = px.copy()
    padded[:, 9:], padded[10:] = 0, 0
    assert (K.fill_nodata(padded, 9, 10) == slow_fill(K.extend_edges(padded, 9, 10), 8)).all()
    assert (K.fill_nodata(padded, 9, 10, edges=False) == slow_fill(padded, 8)).all()
    assert (K.fill_nodata(padded, 9, 10, means=False) == K.extend_edges(padded, 9, 10)).all()
    wide = np.zeros((4, 4, 4), np.uint8)
    wide[:2, :2] = [[[1, 1, 1, 1], [2, 2, 2, 2]], [[3, 3, 3, 3], [4, 4, 4, 4]]]
    assert K.extend_edges(wide, 2, 2)[..., 0].tolist() == [[1, 2, 2, 2], [3, 4, 4, 4], [3, 4, 4, 4], [3, 4, 4, 4]]


# ---------------------------------------------------------------------------------------------- PNG


@pytest.mark.parametrize(("colours", "opaque", "is_gray", "want"), [(2, 0, 0, (3, 1)), (4, 1, 1, (3, 2)), (16, 1, 0, (3, 4)), (17, 1, 1, (0, 8)), (256, 1, 0, (3, 8)), (256, 0, 1, (3, 8)), (257, 1, 0, (2, 8)), (257, 0, 0, (6, 8))])
def test_colour_type(colours, opaque, is_gray, want):
    assert png.colour_type(colours, bool(opaque), bool(is_gray), 256) == want


def test_round_trip():
    rng = np.random.default_rng(1)
    for n, w in ((1, 16), (2, 16), (2, 8), (4, 16), (4, 4), (9, 6), (16, 10), (40, 12), (200, 20), (9, 7)):
        px = raster(n, 24, w, colours=n)
        assert (png.decode(png.encode(px)) == px).all()
    for px in (rng.integers(0, 256, (40, 30, 4), np.uint8), gray(np.arange(64).reshape(8, 8)), gray(np.arange(64).reshape(8, 8), np.full((8, 8), 7))):
        assert (png.decode(png.encode(px)) == px).all()
    opaque = rng.integers(0, 256, (40, 30, 4), np.uint8)
    opaque[..., 3] = 255
    assert png.encode(opaque)[25] == png.RGB and (png.decode(png.encode(opaque)) == opaque).all()


def filtered(line, above, step, kind):
    out = []
    for i, v in enumerate(line):
        a = line[i - step] if i >= step else 0
        b = above[i]
        c = above[i - step] if i >= step else 0
        p = a + b - c
        paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out.append((v - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
    return out


def build(kind, depth, rows, width, extra=b"", interlaced=False):
    """A PNG of sample rows, every row with another filter; interlaced with the seven passes."""
    step = max(1, png._CHANNELS[kind] * depth // 8)
    lines = []
    for x0, y0, dx, dy in png._PASSES if interlaced else [(0, 0, 1, 1)]:
        above = None
        for n, row in enumerate(rows[y0::dy]):
            row = row[x0::dx]
            if not row:
                continue
            bits = "".join(format(v, f"0{depth}b") for px in row for v in px)
            bits += "0" * (-len(bits) % 8)
            line = [int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)]
            above = above or [0] * len(line)
            lines.append(bytes([n % 5, *filtered(line, above, step, n % 5)]))
            above = line
    head = struct.pack(">IIBBBBB", width, len(rows), depth, kind, 0, 0, int(interlaced))
    return png.SIGNATURE + png._chunk(b"IHDR", head) + extra + png._chunk(b"IDAT", zlib.compress(b"".join(lines))) + png._chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("kind", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_decodes_every_kind(kind, depth, interlaced):
    rng = random.Random(kind * 100 + depth)
    width, height, channels = 11, 13, png._CHANNELS[kind]
    rows = [[tuple(rng.randrange(1 << depth) for _ in range(channels)) for _ in range(width)] for _ in range(height)]
    colours = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(1 << min(depth, 8))]
    extra = b""
    if kind == 3:
        extra = png._chunk(b"PLTE", bytes(v for c in colours for v in c)) + png._chunk(b"tRNS", bytes([7]))
    elif kind in (0, 2):
        extra = png._chunk(b"tRNS", struct.pack(f">{channels}H", *rows[2][3]))
    got = png.decode(build(kind, depth, rows, width, extra, interlaced))
    byte = lambda v: v >> 8 if depth == 16 else v * 255 // ((1 << depth) - 1) if depth < 8 else v
    for y in range(height):
        for x in range(width):
            s = rows[y][x]
            if kind == 3:
                want = (*colours[s[0]], 7 if s[0] == 0 else 255)
            else:
                v = [byte(c) for c in s]
                alpha = v[-1] if kind in (4, 6) else 0 if s == rows[2][3] else 255
                want = (*(v[:3] if kind in (2, 6) else v[:1] * 3), alpha)
            assert tuple(got[y, x].tolist()) == want


@pytest.mark.parametrize("data", [b"", b"\xff\xd8\xff\xe0 a jpeg", png.SIGNATURE, png.encode(gray([[1, 2], [3, 4]]))[:-20], png.encode(gray([[1, 2], [3, 4]]))[:40]])
def test_what_is_no_png(data):
    with pytest.raises(png.NotPNG):
        png.decode(data)
