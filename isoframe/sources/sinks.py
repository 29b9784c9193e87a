"""Sinks: pictures as PNG, APNG, BMP or HEIF with uncompressed payload, written by the executors.

A file is written under another name and moved into place when it is whole, so a failed or repeated task leaves no
cut-off file under a final name.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import writer as w

FORMATS = ("png", "bmp", "heif")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _packed(data: np.ndarray, depth: int) -> bytes:
    """Rows without filter, compressed; over 8 bits as 16."""
    if depth > 8:
        most = (1 << depth) - 1
        data = ((data.astype(np.int64) * 65535 + most // 2) // most).astype(">u2")
    rows = data.astype(data.dtype if depth > 8 else np.uint8)
    return zlib.compress(b"".join(b"\0" + r.tobytes() for r in rows), 6)


def _head(data: np.ndarray, depth: int) -> bytes:
    channels = data.shape[2] if data.ndim == 3 else 1
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    return _chunk(b"IHDR", struct.pack(">IIBBBBB", data.shape[1], data.shape[0], 16 if depth > 8 else 8, kind, 0, 0, 0))


def png(data: np.ndarray, depth: int = 8, icc: bytes | None = None) -> bytes:
    """Gray, gray with alpha, RGB or RGBA by the number of channels."""
    profile = _chunk(b"iCCP", b"icc\0\0" + zlib.compress(icc)) if icc else b""
    return b"\x89PNG\r\n\x1a\n" + _head(data, depth) + profile + _chunk(b"IDAT", _packed(data, depth)) + _chunk(b"IEND", b"")


def delay(seconds: float) -> int:
    """Milliseconds, rounded and at most 65535."""
    return min(65535, int(seconds * 1000 + 0.5))


def apng(frames: list[np.ndarray], seconds: list[float], depth: int = 8) -> bytes:
    out, n = [b"\x89PNG\r\n\x1a\n", _head(frames[0], depth), _chunk(b"acTL", struct.pack(">II", len(frames), 0))], 0
    for k, (frame, s) in enumerate(zip(frames, seconds, strict=True)):
        out.append(_chunk(b"fcTL", struct.pack(">IIIIIHHBB", n, frame.shape[1], frame.shape[0], 0, 0, delay(s), 1000, 0, 0)))
        n += 1
        if k:
            out.append(_chunk(b"fdAT", struct.pack(">I", n) + _packed(frame, depth)))
            n += 1
        else:
            out.append(_chunk(b"IDAT", _packed(frame, depth)))
    return b"".join([*out, _chunk(b"IEND", b"")])


def bmp(rgb: np.ndarray) -> bytes:
    h, width = rgb.shape[:2]
    rows = np.zeros((h, (3 * width + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * width] = rgb[::-1, :, 2::-1].reshape(h, -1) if rgb.shape[2] == 3 else rgb[::-1, :, 2::-1].reshape(h, -1)
    body = rows.tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def heif(rgba: np.ndarray, depth: int, has_alpha: bool) -> bytes:
    """One uncompressed image, components by pixel."""
    n = 4 if has_alpha else 3
    f = w.Writer("mif1")
    wide = depth > 8
    config = w.uncompressed([(depth, 2 if wide else 0)] * n, interleave=1)
    f.add_image("unci", rgba[..., :n].astype(">u2" if wide else np.uint8).tobytes(), rgba.shape[1], rgba.shape[0], w.component_types(*(4, 5, 6, 7)[:n]), config, w.pixi(*[depth] * n))
    return f.finish()


def encoded(row: dict, kind: str) -> bytes:
    data = np.frombuffer(row["data"], "<u2").reshape(row["height"], row["width"], 4)
    if kind == "heif":
        return heif(data, row["bit_depth"], row["has_alpha"])
    if kind == "png":
        return png(data if row["has_alpha"] else data[..., :3], row["bit_depth"])
    most = (1 << row["bit_depth"]) - 1
    return bmp(((data[..., :3].astype(np.int64) * 255 + most // 2) // most).astype(np.uint8))


def write_images(images: DataFrame, folder: str, kind: str, name: Column) -> DataFrame:
    """Write images(width, height, bit_depth, has_alpha, data) to folder/name.kind; returns (file, bytes)."""
    if kind not in FORMATS:
        raise ValueError(f"format {kind!r}: use {', '.join(FORMATS)}")

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            files, sizes = [], []
            for row in batch.to_pylist():
                content, final = encoded(row, kind), f"{root}/{row['name']}.{kind}"
                draft = f"{root}/.{uuid.uuid4().hex}.partial"
                with store.open_output_stream(draft) as out:
                    out.write(content)
                store.move(draft, final)
                files.append(final)
                sizes.append(len(content))
            yield pa.RecordBatch.from_pydict({"file": pa.array(files, pa.string()), "bytes": pa.array(sizes, pa.int64())})

    columns = ["width", "height", "bit_depth", "has_alpha", "data"]
    return images.where("data is not null").select(name.alias("name"), *columns).mapInArrow(run, "file string, bytes bigint")


def fit_to_size(most_bytes: int, encode, qualities) -> tuple[bytes, int] | None:
    """The best of ascending qualities whose encoding fits, by bisection; None if none does. encode(quality) gives bytes."""
    levels, best = list(qualities), None
    low, high = 0, len(levels) - 1
    while low <= high:
        k = (low + high) // 2
        data = encode(levels[k])
        if len(data) <= most_bytes:
            best, low = (data, levels[k]), k + 1
        else:
            high = k - 1
    return best


def auxiliary_names(rows: DataFrame, key: list[str], kind: str, item: str) -> DataFrame:
    """rows with a name: the first of a kind plain, later ones with their item id."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*key, kind).orderBy(item))
    return rows.withColumn("name", F.when(n == 1, F.col(kind)).otherwise(F.concat_ws("-", kind, F.col(item).cast("string"))))
