import struct
import zlib

import numpy as np
import pytest

from isoframe.functions import measures
from isoframe.plans import samples
from isoframe.sources import boxes, rasters, sinks


def filtered(data, kind):
    """A PNG whose rows all use one filter."""
    h, w, n = data.shape
    rows, above, body = data.reshape(h, -1).astype(int), np.zeros(w * n, int), b""
    for row in rows:
        left = np.concatenate([np.zeros(n, int), row[:-n]])
        corner = np.concatenate([np.zeros(n, int), above[:-n]])
        if kind == 4:
            p = left + above - corner
            d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
            guess = np.choose(d.argmin(0), [left, above, corner])
        else:
            guess = [0, left, above, (left + above) // 2][kind]
        body += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    return b"\x89PNG\r\n\x1a\n" + sinks._head(data, 8) + sinks._chunk(b"IDAT", zlib.compress(body)) + sinks._chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    x = samples.rgb(7, 5, kind)
    data, depth, alpha = rasters.read_png(filtered(x, kind))
    assert (data[..., :3] == x).all() and depth == 8 and not alpha


def test_png_forms():
    x = np.random.default_rng(0).integers(0, 65536, (3, 4, 4))
    data, depth, alpha = rasters.read_png(sinks.png(x, 16))
    assert depth == 16 and alpha and (data == x).all()
    head = sinks._chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 1, 2, 3, 0, 0, 0))
    body = sinks._chunk(b"PLTE", bytes(range(9))) + sinks._chunk(b"tRNS", b"\x07") + sinks._chunk(b"IDAT", zlib.compress(bytes([0, 0b00011000])))
    data, _, alpha = rasters.read_png(b"\x89PNG\r\n\x1a\n" + head + body)
    assert alpha and data[0].tolist() == [[0, 1, 2, 7], [3, 4, 5, 255], [6, 7, 8, 255]]
    with pytest.raises(boxes.BadFile):
        rasters.read_png(sinks.png(x, 16)[:60])


def test_any_format():
    x = samples.rgb(5, 4)
    for data in (sinks.png(x), sinks.bmp(x), sinks.heif(np.concatenate([x, np.full((4, 5, 1), 255)], -1), 8, False)):
        assert (rasters.read_any(data).data[..., :3] == x).all()
    with pytest.raises(boxes.BadFile):
        rasters.read_any(b"GIF89a")


def test_bd_rate(spark):
    sizes, quality = [100.0, 200.0, 400.0, 800.0], [30.0, 33.0, 36.0, 39.0]
    assert abs(measures.bd_rate((sizes, quality), ([s * 0.9 for s in sizes], quality)) + 10) < 1e-6
    rows = [("p", c, s * f, q) for c, f in (("a", 1.0), ("b", 1.2)) for s, q in zip(sizes, quality, strict=True)]
    got = measures.bd_rates(spark.createDataFrame(rows, "picture string, coder string, bytes double, psnr double"), "picture", "coder", "a").collect()
    assert [(r.coder, round(r.bd_rate, 6)) for r in got] == [("b", 20.0)]
