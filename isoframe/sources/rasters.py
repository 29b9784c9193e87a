"""Raster files without a codec library: PNG and BMP to RGBA samples."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .boxes import BadFile

MOST_PIXELS = 1 << 28


def kind_of(data: bytes) -> str | None:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    return "bmp" if data[:2] == b"BM" else "heif" if data[4:8] == b"ftyp" else None


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG with their filters undone; step is the bytes of a whole pixel."""
    if len(raw) < height * (stride + 1):
        raise BadFile("PNG rows are cut off")
    out = np.zeros((height, stride), dtype=np.uint8)
    above = np.zeros(stride, dtype=np.int64)
    for y in range(height):
        start = y * (stride + 1)
        kind, row = raw[start], np.frombuffer(raw, np.uint8, stride, start + 1).astype(np.int64)
        if kind == 2:
            row = row + above
        elif kind == 1:
            for k in range(step):
                row[k::step] = np.cumsum(row[k::step])
        elif kind in (3, 4):
            row = row.tolist()
            up = above.tolist()
            for x in range(stride):
                a = row[x - step] if x >= step else 0
                if kind == 3:
                    row[x] = (row[x] + (a + up[x]) // 2) & 255
                else:
                    c = up[x - step] if x >= step else 0
                    p = a + up[x] - c
                    near = min((abs(p - a), 0, a), (abs(p - up[x]), 1, up[x]), (abs(p - c), 2, c))[2]
                    row[x] = (row[x] + near) & 255
            row = np.array(row)
        elif kind:
            raise BadFile("PNG filter")
        above = row & 255
        out[y] = above
    return out


def read_png(data: bytes) -> tuple[np.ndarray, int, bool]:
    """(RGBA samples, bit depth, has alpha) of a PNG that isn't interlaced."""
    at, packed, head, palette, clear = 8, b"", None, None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed += body
        elif kind == b"IEND":
            break
    if not head or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise BadFile("PNG header")
    width, height, depth, colour = head[:4]
    if not width or not height or width * height > MOST_PIXELS:
        raise BadFile(f"image of {width} x {height}")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride = (width * channels * depth + 7) // 8
    try:
        raw = zlib.decompressobj().decompress(packed, height * (stride + 1))
    except zlib.error as e:
        raise BadFile("PNG data") from e
    rows = _unfiltered(raw, height, stride, max(1, channels * depth // 8))
    if depth == 16:
        v = rows.view(">u2").astype(np.int64)
    elif depth == 8:
        v = rows.astype(np.int64)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        v = (bits @ (1 << np.arange(depth - 1, -1, -1)))[:, : width * channels].astype(np.int64)
    v = v.reshape(height, width, channels)
    if colour == 3:
        if palette is None or v.max(initial=0) >= len(palette):
            raise BadFile("PNG palette")
        alpha = np.full(len(palette), 255)
        alpha[: len(clear or b"")] = np.frombuffer(clear or b"", np.uint8)[: len(palette)]
        return np.concatenate([palette[v[..., 0]], alpha[v]], -1).astype(np.uint16), 8, clear is not None
    if depth < 8:
        v, depth = v * 255 // ((1 << depth) - 1), 8
    most = np.full((height, width, 1), (1 << depth) - 1)
    colours, alpha = v[..., : 1 if channels < 3 else 3], v[..., -1:] if channels in (2, 4) else most
    return np.concatenate([np.broadcast_to(colours, (height, width, 3)), alpha], -1).astype(np.uint16), depth, channels in (2, 4)


def read_bmp(data: bytes) -> tuple[np.ndarray, int, bool]:
    """Uncompressed bitmaps of 24 or 32 bits."""
    if len(data) < 54:
        raise BadFile("BMP header")
    start, _, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (24, 32) or packing or width <= 0 or not height or width * abs(height) > MOST_PIXELS:
        raise BadFile("BMP form")
    step = bits // 8
    stride = (step * width + 3) // 4 * 4
    if start + stride * abs(height) > len(data):
        raise BadFile("BMP is cut off")
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : step * width].reshape(abs(height), width, step)
    rows = rows[::-1] if height > 0 else rows
    out = np.full((abs(height), width, 4), 255, np.uint16)
    out[..., :3] = rows[..., 2::-1]
    return out, 8, False


def read_any(data: bytes):
    """A picture of any of the formats here, or of a HEIF file with uncompressed items."""
    from ..operators.images import Decoder, Image

    kind = kind_of(data)
    if kind is None:
        raise BadFile("unknown format")
    if kind == "heif":
        return Decoder(data).decode()
    return Image(*(read_png if kind == "png" else read_bmp)(data))
