"""A PNG codec on numpy and zlib: any PNG to RGBA, and RGBA to the smallest lossless colour type."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed value: the eight bytes that begin a PNG.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRAY, RGB, PALETTE, GRAY_ALPHA, RGBA = 0, 2, 3, 4, 6
_CHANNELS = {GRAY: 1, RGB: 3, PALETTE: 1, GRAY_ALPHA: 2, RGBA: 4}
#: First column, first row, column step and row step of the seven interlace passes.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class NotPNG(ValueError):
    """The bytes are not a PNG that can be decoded."""


def _chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + size > len(data):
            raise NotPNG("truncated chunk")
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfilter(data: bytes, at: int, rows: int, stride: int, step: int) -> tuple[np.ndarray, int]:
    if at + rows * (stride + 1) > len(data):
        raise NotPNG("truncated pixels")
    raw = np.frombuffer(data, np.uint8, rows * (stride + 1), at).reshape(rows, stride + 1)
    kinds, raw = raw[:, 0], raw[:, 1:]
    if not kinds.any():
        return raw, at + rows * (stride + 1)
    out = np.zeros((rows, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(rows):
        line = raw[y]
        if kinds[y] == 0:
            out[y] = line
        elif kinds[y] == 1:
            for c in range(step):
                out[y, c::step] = np.cumsum(line[c::step], dtype=np.uint64).astype(np.uint8)
        elif kinds[y] == 2:
            out[y] = line + above
        elif kinds[y] in (3, 4):
            out[y] = _average_or_paeth(line.tolist(), above.tolist(), step, kinds[y] == 4)
        else:
            raise NotPNG("unknown filter")
        above = out[y]
    return out, at + rows * (stride + 1)


def _average_or_paeth(line: list[int], above: list[int], step: int, paeth: bool) -> list[int]:
    out = [0] * step + line
    up = [0] * step + above
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if paeth:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        else:
            guess = (a + b) >> 1
        out[i] = (out[i] + guess) & 255
    return out[step:]


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(rows, width, channels) of bytes; for 16 bits, of the high bytes; for fewer than 8, unscaled."""
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2)[..., 0]
    if depth == 8:
        return rows.reshape(len(rows), width, channels)
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, :width, None]


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) of any PNG; NotPNG if it is none."""
    if data[:8] != SIGNATURE:
        raise NotPNG("no PNG signature")
    header, palette, clear, packed = None, None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    if header is None or not packed:
        raise NotPNG("no header or no pixels")
    width, height, depth, kind, _, _, interlaced = header
    if kind not in _CHANNELS or not width or not height:
        raise NotPNG("unknown colour type")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise NotPNG(str(e)) from e
    channels = _CHANNELS[kind]
    step = max(1, channels * depth // 8)
    out = np.zeros((height, width, channels), np.uint8)
    full = np.zeros((height, width, channels), np.uint16) if depth == 16 and clear and kind != PALETTE else None
    at = 0
    for x0, y0, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        rows, at = _unfilter(raw, at, h, (w * channels * depth + 7) // 8, step)
        out[y0::dy, x0::dx] = _samples(rows, w, channels, depth)
        if full is not None:
            full[y0::dy, x0::dx] = np.ascontiguousarray(rows).view(">u2").reshape(h, w, channels)
    px = np.full((height, width, 4), 255, np.uint8)
    if kind == PALETTE:
        if palette is None or out.max() >= len(palette):
            raise NotPNG("palette index out of range")
        px[..., :3] = palette[out[..., 0]]
        if clear:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            px[..., 3] = alpha[out[..., 0]]
        return px
    if clear:
        keys = np.frombuffer(clear, ">u2")[: 1 if kind == GRAY else 3]
        px[((full if full is not None else out) == keys).all(-1), 3] = 0
    if kind in (GRAY, GRAY_ALPHA):
        scale = 255 // ((1 << depth) - 1) if depth < 8 else 1
        px[..., :3] = out[..., :1] * scale
    else:
        px[..., :3] = out[..., :3]
    if kind in (GRAY_ALPHA, RGBA):
        px[..., 3] = out[..., -1]
    return px


def palette_of(px: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct colours (count, 4), those that are not opaque first and each part as first seen, and every pixel's
    place among them; None if there are over 256."""
    flat = np.ascontiguousarray(px).view("<u4").ravel()
    colours, first, which = np.unique(flat, return_index=True, return_inverse=True)
    if len(colours) > 256:
        return None
    order = np.lexsort((first, (colours >> 24) == 255))
    place = np.empty(len(order), np.uint8)
    place[order] = np.arange(len(order))
    return colours[order].view(np.uint8).reshape(-1, 4), place[which].reshape(px.shape[:2])


def indexed_depth(colours: int, width: int) -> int:
    """Bits of a palette index; an odd width stays at 8."""
    if width % 2 == 0:
        for depth, least in ((1, 8), (2, 4), (4, 1)):
            if colours <= 1 << depth and width > least:
                return depth
    return 8


def colour_type(colours: int, opaque: bool, gray: bool, width: int) -> tuple[int, int]:
    """(colour type, bits) of the smallest lossless form."""
    if colours > 256:
        return (RGB if opaque else RGBA), 8
    depth = indexed_depth(colours, width)
    return (GRAY if depth == 8 and opaque and gray else PALETTE), depth


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pack_bits(index: np.ndarray, depth: int) -> np.ndarray:
    """Rows of indices as bits, the first in the highest."""
    if depth == 8:
        return index
    bits = (index[..., None] >> np.arange(depth - 1, -1, -1)) & 1
    return np.packbits(bits.reshape(len(index), -1).astype(np.uint8), axis=1)


def encode(px: np.ndarray, level: int = 9) -> bytes:
    """The PNG of an RGBA array: palette, gray, RGB or RGBA, whichever is smallest without loss; no row filters."""
    height, width = px.shape[:2]
    found = palette_of(px)
    opaque = bool((px[..., 3] == 255).all())
    extra = b""
    if found is None:
        kind, depth = colour_type(257, opaque, False, width)
        rows = px[..., : 3 if kind == RGB else 4].reshape(height, -1)
    else:
        colours, index = found
        gray = bool((colours[:, :1] == colours[:, 1:3]).all())
        kind, depth = colour_type(len(colours), opaque, gray, width)
        if kind == GRAY:
            rows = px[..., 0]
        else:
            rows = pack_bits(index, depth)
            extra = _chunk(b"PLTE", colours[:, :3].tobytes())
            if clear := colours[colours[:, 3] < 255, 3].tobytes():
                extra += _chunk(b"tRNS", clear)
    lines = np.zeros((height, rows.shape[1] + 1), np.uint8)
    lines[:, 1:] = rows
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0))
    return SIGNATURE + head + extra + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")
