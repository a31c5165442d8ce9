"""Raster kernels on arrays of shape (height, width, 4), uint8, straight alpha; alpha 0 is NODATA."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The side of each kernel's neighbourhood.
EXTENTS = {"lanczos3": 3, "lanczos5": 5, "bilinear": 2, "nearest": 1, "epx": 3, "eagle": 3, "average": 2, "xbr": 5}
HALF_METHODS = ("average", "lanczos3", "lanczos5")
ENLARGE_METHODS = ("nearest", "epx", "eagle", "xbr", "bilinear", "lanczos3", "lanczos5")
#: Fixed value: the largest difference of a channel that counts as similar.
SIMILAR = 16


def packed(px: np.ndarray) -> np.ndarray:
    """One uint32 for each pixel, red lowest."""
    return np.ascontiguousarray(px).view("<u4")[..., 0]


# ---------------------------------------------------------------------------------------------- halving


def _average_pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    hu, hv = u[..., 3:] > 0, v[..., 3:] > 0
    mean = ((u.astype(np.uint16) + v) >> 1).astype(np.uint8)
    return np.where(hu & hv, mean, np.where(hu, u, np.where(hv, v, 0))).astype(np.uint8)


def half_average(px: np.ndarray) -> np.ndarray:
    """Half the size: pairs in a row first, then pairs of rows, each floored; NODATA never mixes in."""
    _even(px)
    rows = _average_pair(px[:, 0::2], px[:, 1::2])
    return _average_pair(rows[0::2], rows[1::2])


def half_any(px: np.ndarray) -> np.ndarray:
    """Whether each block of 2 x 2 holds any data."""
    _even(px)
    a = px[..., 3] > 0
    return a[0::2, 0::2] | a[0::2, 1::2] | a[1::2, 0::2] | a[1::2, 1::2]


def masked(px: np.ndarray, any_data: np.ndarray) -> np.ndarray:
    """Where there was no data: zero.  Where there was, but alpha came out 0: alpha 1, colours 0."""
    out = np.where(any_data[..., None], px, 0).astype(np.uint8)
    out[any_data & (px[..., 3] == 0)] = (0, 0, 0, 1)
    return out


def half_lanczos(px: np.ndarray, lobes: int) -> np.ndarray:
    h, w = px.shape[:2]
    return masked(resample(px, h // 2, w // 2, lobes), half_any(px))


def half(px: np.ndarray, method: str) -> np.ndarray:
    if method == "average":
        return half_average(px)
    if method in ("lanczos3", "lanczos5"):
        return half_lanczos(px, int(method[-1]))
    raise ValueError(f"{method} cannot halve; use one of {HALF_METHODS}")


def _even(px: np.ndarray) -> None:
    if px.shape[0] % 2 or px.shape[1] % 2:
        raise ValueError("width and height must be even")


# ---------------------------------------------------------------------------------------------- resampling


@lru_cache(maxsize=64)
def lanczos_matrix(n: int, m: int, lobes: int) -> np.ndarray:
    """(m, n) weights from n samples to m: windowed sinc, widened when shrinking, edges clamped, rows summing to 1."""
    scale = max(n / m, 1.0)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    reach = int(np.ceil(lobes * scale))
    taps = np.floor(centre)[:, None].astype(int) + np.arange(-reach, reach + 1)
    x = (taps - centre[:, None]) / scale
    weight = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    out = np.zeros((m, n))
    np.add.at(out, (np.repeat(np.arange(m), taps.shape[1]), np.clip(taps, 0, n - 1).ravel()), weight.ravel())
    return out / out.sum(1, keepdims=True)


def resample(px: np.ndarray, height: int, width: int, lobes: int) -> np.ndarray:
    """Separable Lanczos, rounded half up and clipped."""
    h, w = px.shape[:2]
    rows = np.tensordot(lanczos_matrix(h, height, lobes), px.astype(np.float64), (1, 0))
    out = np.einsum("xw,ywc->yxc", lanczos_matrix(w, width, lobes), rows, optimize=True)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def bilinear_steps(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower sample and the weight (of 128) of the upper one, in 16.16 fixed point."""
    at = np.arange(m, dtype=np.int64) * (((n - 1) << 16) // (m - 1) if m > 1 else 0)
    return at >> 16, (at >> 9) & 127


def bilinear(px: np.ndarray, height: int, width: int) -> np.ndarray:
    """Integer bilinear; the sample past the end, of weight 0, is clamped."""
    y, wy = bilinear_steps(px.shape[0], height)
    x, wx = bilinear_steps(px.shape[1], width)
    y1, x1 = np.minimum(y + 1, px.shape[0] - 1), np.minimum(x + 1, px.shape[1] - 1)
    p = px.astype(np.int64)
    wx = wx[None, :, None]
    wy = wy[:, None, None]
    top = p[y][:, x] * (128 - wx) + p[y][:, x1] * wx
    low = p[y1][:, x] * (128 - wx) + p[y1][:, x1] * wx
    return ((top * (128 - wy) + low * wy) >> 14).astype(np.uint8)


# ---------------------------------------------------------------------------------------------- neighbourhood enlarging


def nearest(px: np.ndarray, scale: int) -> np.ndarray:
    return px.repeat(scale, 0).repeat(scale, 1)


def data_mask(px: np.ndarray, scale: int) -> np.ndarray:
    """All bits set where the source pixel has data, enlarged."""
    return np.where(nearest(px, scale)[..., 3] > 0, 0xFFFFFFFF, 0).astype(np.uint32)


def _window(px: np.ndarray, reach: int):
    """near(dy, dx): every pixel's neighbour, clamped to the edge."""
    h, w = px.shape[:2]
    wide = np.pad(px, ((reach, reach), (reach, reach), (0, 0)), mode="edge")
    return lambda dy, dx: wide[reach + dy : reach + dy + h, reach + dx : reach + dx + w]


def _woven(d: list[np.ndarray]) -> np.ndarray:
    """Four images (upper left, upper right, lower left, lower right) as one of twice the size."""
    h, w = d[0].shape[:2]
    out = np.empty((2 * h, 2 * w, 4), np.uint8)
    out[0::2, 0::2], out[0::2, 1::2], out[1::2, 0::2], out[1::2, 1::2] = d
    return out


def _same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return packed(x) == packed(y)


def epx(px: np.ndarray) -> np.ndarray:
    near = _window(px, 1)
    up, left, right, down = near(-1, 0), near(0, -1), near(0, 1), near(1, 0)
    use = ~_same(up, down) & ~_same(right, left)
    pick = lambda x, y: np.where((use & _same(x, y))[..., None], x, px)
    return _woven([pick(left, up), pick(right, up), pick(left, down), pick(right, down)])


def eagle(px: np.ndarray) -> np.ndarray:
    near = _window(px, 1)
    out = []
    for dy in (-1, 1):
        for dx in (-1, 1):
            corner, side, end = near(dy, dx), near(0, dx), near(dy, 0)
            out.append(np.where((_same(side, corner) & _same(corner, end))[..., None], corner, px))
    return _woven(out)


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of all channels' differences."""
    return np.abs(x.astype(np.int32) - y).sum(-1)


def similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (np.abs(x.astype(np.int16) - y) <= SIMILAR).all(-1)


def blend(x: np.ndarray, y: np.ndarray, mx: int, my: int, shift: int) -> np.ndarray:
    return ((x.astype(np.uint16) * mx + y.astype(np.uint16) * my) >> shift).astype(np.uint8)


#: The neighbours of the centre, as (row, column), for an edge that runs across its lower right corner.
_XBR_VIEW = {
    "B": (-1, 0), "C": (-1, 1), "D": (0, -1), "F": (0, 1), "F4": (0, 2), "G": (1, -1), "H": (1, 0), "I": (1, 1), "I4": (1, 2), "H5": (2, 0), "I5": (2, 1),
}


def xbr(px: np.ndarray) -> np.ndarray:
    """Edges are blended corner by corner: each pass turns the view a quarter and sees what the passes before it drew."""
    near = _window(px, 2)
    out = {(1, 1): px.copy(), (-1, 1): px.copy(), (-1, -1): px.copy(), (1, -1): px.copy()}
    turn = lambda p: (-p[1], p[0])  # noqa: E731  a quarter turn to the left
    view, corner, sides = dict(_XBR_VIEW), (1, 1), [(-1, 1), (1, -1)]
    for _ in range(4):
        n = {k: near(*p) for k, p in view.items()}
        _xbr_corner(px, n, out, sides[0], sides[1], corner)
        view = {k: turn(p) for k, p in view.items()}
        corner, sides = turn(corner), [turn(s) for s in sides]
    return _woven([out[-1, -1], out[-1, 1], out[1, -1], out[1, 1]])


def _xbr_corner(e: np.ndarray, n: dict[str, np.ndarray], out: dict, one, two, three) -> None:
    f, h = n["F"], n["H"]
    active = ~(_same(e, h) & _same(e, f))
    red = distance(e, n["C"]) + distance(e, n["G"]) + distance(n["I"], n["F4"]) + distance(n["I"], n["H5"]) + 4 * distance(h, f)
    blue = distance(h, n["D"]) + distance(h, n["I5"]) + distance(f, n["I4"]) + distance(f, n["B"]) + 4 * distance(e, n["I"])
    new = np.where((distance(e, f) <= distance(e, h))[..., None], f, h)
    edge = (~similar(f, n["B"]) & ~similar(h, n["D"])) | (similar(e, n["I"]) & ~similar(f, n["I4"]) & ~similar(h, n["I5"])) | similar(e, n["G"]) | similar(e, n["C"])
    strong = active & (red < blue) & edge
    weak = active & ~strong & (red <= blue)
    ke, ki = distance(f, n["G"]), distance(h, n["C"])
    steep = strong & (ki >= 2 * ke) & ~similar(e, n["G"]) & ~similar(n["D"], n["G"])
    flat = strong & ~steep & (ke >= 2 * ki) & ~similar(f, n["G"]) & ~similar(n["B"], n["C"])
    first, second, third = out[one], out[two], out[three]
    out[one] = np.where(flat[..., None], blend(first, new, 3, 1, 2), first)
    out[two] = np.where(steep[..., None], blend(second, new, 3, 1, 2), second)
    third = np.where((steep | flat)[..., None], blend(third, new, 1, 3, 2), third)
    third = np.where((strong & ~steep & ~flat)[..., None], blend(third, new, 1, 1, 1), third)
    out[three] = np.where(weak[..., None], blend(third, new, 3, 1, 2), third)


# ---------------------------------------------------------------------------------------------- filling


def extend_edges(px: np.ndarray, width: int, height: int) -> np.ndarray:
    """Zero pixels right of the first ``width`` columns and below the first ``height`` rows take the last data's."""
    out = px.copy()
    right = out[:, width:]
    np.copyto(right, out[:, width - 1 : width], where=(packed(right) == 0)[..., None])
    below = out[height:]
    np.copyto(below, out[height - 1 : height], where=(packed(below) == 0)[..., None])
    return out


def box(cell: int) -> tuple[int, int]:
    """How far a box of side ``cell`` reaches before and behind its pixel; an even one reaches one less before it."""
    return (cell - 1) // 2, cell // 2


def fill_mean(px: np.ndarray, cell: int) -> np.ndarray:
    """Every NODATA pixel takes the mean, rounded, of the data in the box of side ``cell`` (at most the image's larger
    side) about a data pixel that reaches it; of several, the last in reading order."""
    h, w = px.shape[:2]
    data = px[..., 3] > 0
    back, ahead = box(max(h, w) if cell > w and cell > h else cell)
    sums = np.zeros((h + 1, w + 1, 5))
    sums[1:, 1:] = np.concatenate((px * data[..., None], data[..., None]), 2).astype(float).cumsum(0).cumsum(1)
    y, x = np.nonzero(data)
    y0, y1, x0, x1 = np.maximum(y - back, 0), np.minimum(y + ahead + 1, h), np.maximum(x - back, 0), np.minimum(x + ahead + 1, w)
    total = sums[y1, x1] - sums[y0, x1] - sums[y1, x0] + sums[y0, x0]
    mean = np.floor(total[:, :4] / total[:, 4:] + 0.5).astype(np.uint8)
    out = px.copy()
    for i in range(len(y)):
        area = (slice(y0[i], y1[i]), slice(x0[i], x1[i]))
        out[area][~data[area]] = mean[i]
    return out


def fill_nodata(px: np.ndarray, width: int, height: int, edges: bool = True, means: bool = True) -> np.ndarray:
    """A padded image whose data fill the first ``width`` columns and ``height`` rows: edges extended, then what is left
    filled by means of boxes twice as wide as the padding (at least 3, at most the image)."""
    out = extend_edges(px, width, height) if edges else px
    if means:
        pad = max(px.shape[1] - width, px.shape[0] - height)
        out = fill_mean(out, max(min(2 * pad + 2, px.shape[1]), 3))
    return out


# ---------------------------------------------------------------------------------------------- tiles


def roi(child_x: int, child_y: int, shift: int, width: int, height: int) -> tuple[int, int, int, int]:
    """The part of the parent that fills a child ``shift`` levels in: x, y, width, height."""
    return (
        ((child_x * width) >> shift) - (child_x >> shift) * width,
        ((child_y * height) >> shift) - (child_y >> shift) * height,
        width >> shift,
        height >> shift,
    )


def reach_of(method: str) -> int:
    k = EXTENTS[method]
    return (k >> 1) + 1 if k % 2 else k >> 1


def enlarge_child(px: np.ndarray, child_x: int, child_y: int, shift: int, method: str, compat: bool = False) -> np.ndarray | None:
    """The child tile, of the parent's size; None if its part of the parent has no data.

    compat: a parent with data in its first pixel counts as data everywhere."""
    h, w = px.shape[:2]
    x, y, rw, rh = roi(child_x, child_y, shift, w, h)
    part = px[y : y + rh, x : x + rw]
    if not part[..., 3].any() and not (compat and px[0, 0, 3]):
        return None
    if method in ("epx", "eagle", "xbr"):
        if shift != 1:
            raise ValueError(f"{method} enlarges by one level at a time")
        return {"epx": epx, "eagle": eagle, "xbr": xbr}[method](part)
    if method == "nearest":
        return nearest(part, 1 << shift)
    if method not in ("bilinear", "lanczos3", "lanczos5"):
        raise ValueError(f"{method} cannot enlarge; use one of {ENLARGE_METHODS}")
    reach = reach_of(method)
    wide = np.zeros((rh + reach, rw + reach, 4), np.uint8)
    copy = px[y : y + rh + reach, x : x + rw + reach]
    wide[: copy.shape[0], : copy.shape[1]] = copy
    wide = extend_edges(wide, copy.shape[1], copy.shape[0])
    size = (h + reach * (h // rh), w + reach * (w // rw))
    big = bilinear(wide, *size) if method == "bilinear" else resample(wide, *size, int(method[-1]))
    return np.ascontiguousarray(big[:h, :w])
