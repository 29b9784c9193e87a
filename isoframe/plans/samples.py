"""Small synthetic image files, and queries over them that SQL has no tables for."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata
from ..operators import images
from ..operators import sequences as seq
from ..sources import heif
from ..sources import writer as w
from . import container as ct

FILES = "path string, length bigint, content binary"


def rgb(width: int, height: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)


UNCOMPRESSED = (w.component_types(4, 5, 6), w.uncompressed([(8, 0)] * 3, interleave=0), w.pixi(8, 8, 8))


def planar(pixels: np.ndarray) -> bytes:
    return pixels.transpose(2, 0, 1).tobytes()


def single() -> bytes:
    f = w.Writer("mif1")
    n = f.add_image("unci", planar(rgb(12, 8)), 12, 8, *UNCOMPRESSED, w.nclx(1, 13, 6, True))
    f.add_thumbnail(n, "unci", planar(rgb(6, 4)), 6, 4, *UNCOMPRESSED)
    f.add_thumbnail(n, "unci", planar(rgb(3, 2)), 3, 2, *UNCOMPRESSED)
    f.add_exif(n, tiff({0x010F: b"Apple\0", 0x0112: 6}))
    f.add_xmp(n, b"<x/>")
    return f.finish()


def tiff(tags: dict) -> bytes:
    """A little-endian block of ASCII and SHORT entries."""
    entries, tail, at = b"", b"", 8 + 2 + 12 * len(tags) + 4
    for tag, v in sorted(tags.items()):
        if isinstance(v, int):
            entries += struct.pack("<HHIHH", tag, 3, 1, v, 0)
        elif len(v) <= 4:
            entries += struct.pack("<HHI", tag, 2, len(v)) + v.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, 2, len(v), at + len(tail))
            tail += v
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + bytes(4) + tail


def grid() -> bytes:
    f = w.Writer("mif1")
    tiles = [f.add_image("unci", planar(rgb(8, 6, k)), 8, 6, *UNCOMPRESSED, hidden=True) for k in range(4)]
    n = f.add_grid(2, 2, 14, 11, tiles)
    f.add_xmp(tiles[0], b"<of-the-first-tile/>")
    f.add_icc(tiles[0], b"profile")
    f.add_alpha(n, "unci", bytes(range(154)), 14, 11, w.component_types(0), w.uncompressed([(8, 0)]), w.pixi(8))
    return f.finish()


def overlay() -> bytes:
    f = w.Writer("mif1")
    parts = [f.add_image("unci", planar(rgb(5, 5, k)), 5, 5, *UNCOMPRESSED, hidden=True) for k in (7, 8)]
    f.add_overlay(9, 8, (65535, 0, 0, 65535), parts, [(1, 1), (-2, 5)])
    turned = f.add_identity(parts[0], 5, 5, w.rotation(1), w.mirror(True), w.clap(3, 1, 4, 1, 0, 1, 0, 1))
    f.set_primary(turned)
    return f.finish()


def regions_file() -> bytes:
    f = w.Writer("mif1")
    n = f.add_image("unci", planar(rgb(4, 4)), 4, 4, *UNCOMPRESSED)
    f.add_regions(n, metadata.write_regions(4032, 3024, [{"kind": "point", "x": 10, "y": -5, "width": None, "height": None, "points": None, "bits": None}]), [])
    return f.finish()


def sequence(per_chunk: int | None = 2) -> bytes:
    f = w.Writer("mif1")
    f.add_image("unci", planar(rgb(4, 4)), 4, 4, *UNCOMPRESSED)
    t = w.Track(4, 4, timescale=25, per_chunk=per_chunk)
    for k, off in enumerate([1, 3, 0, 0, 0, 1]):
        t.add_sample(bytes([k]) * (k + 1), 1, k in (0, 4), off)
    f.set_sequence(t)
    return f.finish()


ALL = {"single.heif": single, "grid.heif": grid, "overlay.heif": overlay, "regions.heif": regions_file, "sequence.heif": sequence, "broken.heif": lambda: single()[:200], "empty.heif": lambda: b""}


def files(spark: SparkSession, names=tuple(ALL)) -> DataFrame:
    return spark.createDataFrame([(n, len(c), bytearray(c)) for n in names if (c := ALL[n]()) is not None], FILES)


def containers(spark: SparkSession) -> heif.Containers:
    """Parsed once: a view may read several of its tables."""
    return heif.Containers(heif.parse(files(spark))).stored()


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of fixed rows; columns is "name type, ..."."""
    text = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    pairs = [c.split() for c in columns.split(", ")]
    casts = ", ".join(f"cast({n} as {t}) as {n}" for n, t in pairs)
    return f"select {casts} from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) as t({', '.join(n for n, _ in pairs)})"


def planned_items() -> list[tuple]:
    """What the writers above were asked for: items get ids in the order in which they were added."""
    kinds = {
        "single.heif": ["unci", "unci", "unci", "Exif", "mime"],
        "grid.heif": ["unci*", "unci*", "unci*", "unci*", "grid", "mime", "unci*"],
        "overlay.heif": ["unci*", "unci*", "iovl", "iden"],
        "regions.heif": ["unci", "rgan"],
        "sequence.heif": ["unci"],
    }
    return [(path, k, k + 1, kind.rstrip("*"), "", kind.endswith("*") or kind in ("Exif", "mime", "rgan"), "application/rdf+xml" if kind == "mime" else None) for path, own in kinds.items() for k, kind in enumerate(own)]


ALPHA = "urn:mpeg:mpegB:cicp:systems:auxiliary:alpha"

#: Expected rows, as they follow from what the writers above were asked for.
ORACLE_SQL = {
    "heif_items": values("path varchar, ordinal integer, item_id bigint, item_type varchar, name varchar, hidden boolean, content_type varchar", planned_items()),
    "heif_top_level": values(
        "path varchar, item_id bigint, line varchar",
        [
            ("grid.heif", 5, "item 5: grid 14x11, 8 bits, 1 auxiliary images"),
            ("overlay.heif", 3, "item 3: iovl 9x8, 8 bits, 0 auxiliary images"),
            ("overlay.heif", 4, "item 4: iden 5x5, 8 bits, 0 auxiliary images"),
            ("regions.heif", 1, "item 1: unci 4x4, 8 bits, 0 auxiliary images"),
            ("sequence.heif", 1, "item 1: unci 4x4, 8 bits, 0 auxiliary images"),
            ("single.heif", 1, "item 1: unci 12x8, 8 bits, 0 auxiliary images"),
        ],
    ),
    "heif_auxiliary": values("path varchar, item_id bigint, aux_id bigint, item_type varchar, urn varchar, width bigint, height bigint, bit_depth integer", [("grid.heif", 5, 7, "unci", ALPHA, 14, 11, 8)]),
    "heif_thumbnails": values("path varchar, item_id bigint, thumb_id bigint", [("single.heif", 1, 3)]),
    # The note of the grid's first tile is also the grid's.
    "heif_descriptions": values("path varchar, item_id bigint, source_id bigint, ordinal integer", [("grid.heif", 1, 6, 5), ("grid.heif", 5, 6, 5), ("single.heif", 1, 5, 4)]),
    # Shown at 1, 4, 2, 3, 4 and 6 of 25 ticks a second; samples 1 and 4 tie and keep their decoding order.
    "heif_frames": values(
        "path varchar, track_id bigint, frame_no integer, n integer, duration double, keyframe boolean",
        [("sequence.heif", 1, k, n, ticks / 25, n in (0, 4)) for k, (n, ticks) in enumerate([(0, 1), (2, 1), (3, 1), (1, 0), (4, 2), (5, 1)])],
    ),
}

QUERIES = {
    "heif_items": lambda spark, sf_dir: containers(spark).items,
    "heif_errors": lambda spark, sf_dir: containers(spark).errors,
    "heif_boxes": lambda spark, sf_dir: heif.box_rows(files(spark)).select("path", "depth", "offset", "box_type", "size"),
    "heif_top_level": lambda spark, sf_dir: ct.report(containers(spark)),
    "heif_auxiliary": lambda spark, sf_dir: ct.auxiliary_images(containers(spark)),
    "heif_thumbnails": lambda spark, sf_dir: ct.thumbnails(containers(spark)),
    "heif_descriptions": lambda spark, sf_dir: ct.xmp_items(containers(spark)),
    "heif_frames": lambda spark, sf_dir: seq.frames(seq_tracks(spark)),
    "heif_decoded": lambda spark, sf_dir: images.decoded(heif.parse(files(spark))).select("path", "width", "height", "has_alpha", F.md5("data").alias("md5"), "error"),
}


def seq_tracks(spark: SparkSession) -> DataFrame:
    return containers(spark).tracks
