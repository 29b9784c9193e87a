"""Boxes of the ISO base media file format, read from bytes into plain rows.

Everything here follows the published box syntax (ISO/IEC 14496-12, 23008-12, 23001-17). A malformed file raises
BadFile; the Spark side turns that into an error row, so that one file doesn't end a job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

MOST_EXTENTS, MOST_COMPONENTS = 1 << 20, 256


class BadFile(ValueError):
    """The bytes break the format."""


class Bytes:
    """A cursor over big-endian fields."""

    __slots__ = ("data", "at")

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        at, data = self.at, self.data
        if n < 0 or at + n > len(data):
            raise BadFile(f"{n} bytes wanted, {self.left()} left")
        self.at = at + n
        return data[at : at + n]

    def uint(self, size: int) -> int:
        at, data = self.at, self.data  # take(), written out: most fields are read here
        if size and at + size > len(data):
            raise BadFile(f"{size} bytes wanted, {self.left()} left")
        self.at = at + size
        return int.from_bytes(data[at : at + size], "big")

    def sint(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big", signed=True)

    def code(self) -> str:
        return self.take(4).decode("latin-1")

    def text(self) -> str:
        """A string up to its NUL, or up to the end."""
        end = self.data.find(b"\0", self.at)
        raw = self.take((end if end >= 0 else len(self.data)) - self.at)
        self.at += end >= 0
        return raw.decode("utf-8", "replace")

    def full(self) -> tuple[int, int]:
        """Version and flags of a FullBox."""
        x = self.uint(4)
        return x >> 24, x & 0xFFFFFF

    def rest(self) -> bytes:
        return self.take(self.left())


class Box(NamedTuple):
    kind: str
    offset: int
    header: int
    size: int
    to_end: bool
    uuid: bytes | None
    data: bytes


SHORT = struct.Struct(">I4s")  # the header of most boxes


def header(data: bytes, offset: int = 0) -> tuple[str, int, int, bool, bytes | None]:
    """(type, header size, whole size, whether it runs to the end, user type)."""
    r = Bytes(data, offset)
    size, kind, head = r.uint(4), r.code(), 8
    to_end = size == 0
    if size == 1:
        size, head = r.uint(8), 16
    user = None
    if kind == "uuid":
        user, head = r.take(16), head + 16
    if to_end:
        size = len(data) - offset
    if size < head:
        raise BadFile(f"box {kind!r} of {size} bytes")
    return kind, head, size, to_end, user


def children(data: bytes, top: bool = False, base: int = 0) -> Iterator[Box]:
    """The boxes in data one after another; at top level a tail of fewer than 8 bytes is no box."""
    at, n = 0, len(data)
    while at < n:
        if top and n - at < 8:
            return
        size, raw = SHORT.unpack_from(data, at) if n - at >= 8 else (0, b"")
        if size >= 8 and raw != b"uuid":
            kind, head, to_end, user = raw.decode("latin-1"), 8, False, None
        else:
            kind, head, size, to_end, user = header(data, at)
        if at + size > n:
            raise BadFile(f"box {kind!r} runs over the end")
        yield Box(kind, base + at, head, size, to_end, user, data[at + head : at + size])
        at += size


def tree(data: bytes, inside=("moov", "trak", "mdia", "minf", "stbl", "iprp", "ipco", "meta", "iref", "grpl", "dinf")) -> Iterator[tuple[int, int | None, Box]]:
    """(depth, parent offset, box) of every box, containers opened."""

    def walk(data, base, depth, parent):
        for b in children(data, top=depth == 0, base=base):
            yield depth, parent, b
            if b.kind in inside:
                skip = 4 if b.kind in ("meta", "iref") else 0
                yield from walk(b.data[skip:], b.offset + b.header + skip, depth + 1, b.offset)

    yield from walk(data, 0, 0, None)


def file_type(head: bytes) -> str:
    """Supported, Unsupported, No or MayBe, from the first 12 bytes."""
    if len(head) < 8:
        return "MayBe"
    if head[4:8] != b"ftyp":
        return "No"
    if len(head) < 12:
        return "MayBe"
    brand = head[8:12].decode("latin-1")
    return "Supported" if brand in HEVC_BRANDS else "MayBe" if brand in ANY_BRANDS else "Unsupported"


# Brands of images and sequences coded with HEVC, and of files of any coding.
HEVC_BRANDS = ("heic", "heix", "hevc", "hevx")
ANY_BRANDS = ("mif1", "mif2", "msf1")


def ftyp(data: bytes) -> dict:
    r = Bytes(data)
    out = {"major": r.code(), "minor": r.uint(4), "compatible": []}
    while r.left() >= 4:
        out["compatible"].append(r.code())
    return out


def handler(data: bytes) -> str:
    r = Bytes(data)
    r.take(8)
    return r.code()


def primary_item(data: bytes) -> int:
    r = Bytes(data)
    return r.uint(4 if r.full()[0] else 2)


def item_infos(data: bytes) -> list[dict]:
    r = Bytes(data)
    r.uint(4 if r.full()[0] else 2)
    out = []
    for b in children(r.rest()):
        if b.kind != "infe":
            continue
        e = Bytes(b.data)
        version, flags = e.full()
        if version < 2:
            raise BadFile("item info before version 2")
        item_id = e.uint(2 if version == 2 else 4)
        e.uint(2)
        kind, name = e.code(), e.text()
        mime = e.text() if kind == "mime" else None
        out.append({"ordinal": len(out), "item_id": item_id, "item_type": kind, "name": name, "hidden": bool(flags & 1), "content_type": mime})
    return out


METHODS = ("file", "idat", "item")


def item_locations(data: bytes) -> list[dict]:
    r = Bytes(data)
    version, _ = r.full()
    if version > 2:
        raise BadFile("item locations of an unknown version")
    a, b = r.uint(1), r.uint(1)
    offset_size, length_size, base_size, index_size = a >> 4, a & 15, b >> 4, (b & 15 if version else 0)
    if {offset_size, length_size, base_size, index_size} - {0, 4, 8}:
        raise BadFile("field of an odd width")
    out, total = [], 0
    for ordinal in range(r.uint(4 if version == 2 else 2)):
        item_id = r.uint(4 if version == 2 else 2)
        method = r.uint(2) & 15 if version else 0
        if method > 2:
            raise BadFile("unknown construction method")
        r.uint(2)
        base, count = r.uint(base_size), r.uint(2)
        total += count
        if total > MOST_EXTENTS or count * (offset_size + length_size + index_size) > r.left():
            raise BadFile("too many extents")
        for n in range(count):
            index, offset, length = r.uint(index_size), r.uint(offset_size), r.uint(length_size)
            out.append(
                {"location": ordinal, "item_id": item_id, "extent_no": n, "method": METHODS[method], "offset": base + offset, "length": length, "source_index": index}
            )
    return out


def item_references(data: bytes) -> list[dict]:
    r = Bytes(data)
    wide = 4 if r.full()[0] else 2
    out = []
    for ordinal, b in enumerate(children(r.rest())):
        e = Bytes(b.data)
        source = e.uint(wide)
        for pos in range(e.uint(2)):
            out.append({"ref_ordinal": ordinal, "ref_type": b.kind, "from_id": source, "to_pos": pos, "to_id": e.uint(wide)})
    return out


def property_links(data: bytes) -> list[dict]:
    r = Bytes(data)
    version, flags = r.full()
    out = []
    for entry in range(r.uint(4)):
        item_id = r.uint(4 if version else 2)
        for pos in range(r.uint(1)):
            x = r.uint(2 if flags & 1 else 1)
            top = 15 if flags & 1 else 7
            out.append({"entry": entry, "item_id": item_id, "assoc_pos": pos, "prop_index": x & ((1 << top) - 1), "essential": bool(x >> top)})
    return out


PROPERTY = dict.fromkeys(("width", "height", "depths", "colour_type", "primaries", "transfer", "matrix", "full_range", "icc", "angle", "mirror", "aperture", "urn", "subtypes", "config", "raw"))


def hevc_config(data: bytes) -> dict:
    r = Bytes(data)
    if r.uint(1) != 1:
        raise BadFile("configuration version")
    profile = r.uint(1)
    r.take(10)
    level = r.uint(1)
    r.take(3)
    chroma, luma_depth, chroma_depth = r.uint(1) & 3, (r.uint(1) & 7) + 8, (r.uint(1) & 7) + 8
    r.take(2)
    nal_size = (r.uint(1) & 3) + 1
    if nal_size == 3:
        raise BadFile("NAL lengths of 3 bytes")
    nals = []
    for _ in range(r.uint(1)):
        r.uint(1)
        for _ in range(r.uint(2)):
            nals.append(r.take(r.uint(2)))
    return {"profile": profile & 31, "level": level, "chroma": chroma, "luma_depth": luma_depth, "chroma_depth": chroma_depth, "nal_size": nal_size, "nals": nals}


def component_types(data: bytes) -> list[tuple[int, str | None]]:
    r = Bytes(data)
    n = r.uint(4)
    if n > MOST_COMPONENTS:
        raise BadFile("too many components")
    return [(t := r.uint(2), r.text() if t >= 0x8000 else None) for _ in range(n)]


def uncompressed_config(data: bytes) -> dict:
    r = Bytes(data)
    version, _ = r.full()
    out = {"version": version, "profile": r.code(), "components": []}
    if version == 1:
        return out
    n = r.uint(4)
    if n > MOST_COMPONENTS:
        raise BadFile("too many components")
    for _ in range(n):
        out["components"].append({"index": r.uint(2), "depth": r.uint(1) + 1, "format": r.uint(1), "align": r.uint(1)})
    for name in ("sampling", "interleave", "block_size"):
        out[name] = r.uint(1)
    flags = r.uint(1)
    out |= {"little_endian": bool(flags & 128), "pad_lsb": bool(flags & 64), "block_little_endian": bool(flags & 32), "block_reversed": bool(flags & 16), "pad_unknown": bool(flags & 8)}
    out |= {"pixel_size": r.uint(4), "row_align": r.uint(4), "tile_align": r.uint(4), "columns": r.uint(4) + 1, "rows": r.uint(4) + 1}
    return out


def read_property(kind: str, data: bytes) -> dict:
    """One row of the property table; kinds that aren't known keep their bytes. Files share most of their small properties."""
    return dict(_small_property(kind, data) if len(data) <= SMALL else _property(kind, data))


def _property(kind: str, data: bytes) -> dict:
    r, out = Bytes(data), PROPERTY | {"kind": kind, "raw": data}
    if kind == "ispe":
        r.full()
        out |= {"width": r.uint(4), "height": r.uint(4)}
    elif kind == "pixi":
        r.full()
        out["depths"] = [r.uint(1) for _ in range(r.uint(1))]
    elif kind == "colr":
        out["colour_type"] = form = r.code()
        if form == "nclx":
            out |= {"primaries": r.uint(2), "transfer": r.uint(2), "matrix": r.uint(2), "full_range": bool(r.uint(1) >> 7)}
        elif form in ("prof", "rICC"):
            out["icc"] = r.rest()
    elif kind == "irot":
        out["angle"] = r.uint(1) & 3
    elif kind == "imir":
        out["mirror"] = "left-right" if r.uint(1) & 1 else "top-bottom"
    elif kind == "clap":
        out["aperture"] = [r.sint(4) if k in (4, 6) else r.uint(4) for k in range(8)]
    elif kind == "auxC":
        r.full()
        out |= {"urn": r.text(), "subtypes": r.rest()}
    elif kind == "hvcC":
        c = hevc_config(data)
        out["config"] = {k: c[k] for k in ("profile", "level", "chroma", "luma_depth", "chroma_depth", "nal_size")}
    elif kind == "uncC":
        uncompressed_config(data)
    return out


SMALL = 256  # bytes of a property that is kept
_small_property = lru_cache(maxsize=4096)(_property)


def read_grid(data: bytes) -> dict:
    r = Bytes(data)
    r.uint(1)
    wide = 4 if r.uint(1) & 1 else 2
    return {"rows": r.uint(1) + 1, "columns": r.uint(1) + 1, "width": r.uint(wide), "height": r.uint(wide)}


def read_overlay(data: bytes, inputs: int) -> dict:
    r = Bytes(data)
    r.uint(1)
    wide = 4 if r.uint(1) & 1 else 2
    fill = [r.uint(2) for _ in range(4)]
    return {"fill": fill, "width": r.uint(wide), "height": r.uint(wide), "offsets": [(r.sint(wide), r.sint(wide)) for _ in range(inputs)]}


def read_file(data: bytes) -> dict:
    """All container tables of one still-image file."""
    out: dict = {"brands": None, "primary_id": None, "items": [], "extents": [], "refs": [], "properties": [], "links": [], "idat": b""}
    kinds = {}
    for b in children(data, top=True):
        kinds.setdefault(b.kind, b)
    if "ftyp" not in kinds or "meta" not in kinds:
        raise BadFile("no ftyp or no meta box")
    out["brands"] = ftyp(kinds["ftyp"].data)
    for b in children(kinds["meta"].data[4:]):
        if b.kind == "hdlr" and handler(b.data) != "pict":
            raise BadFile("the handler isn't pict")
        if b.kind == "pitm":
            out["primary_id"] = primary_item(b.data)
        elif b.kind == "iinf":
            out["items"] = item_infos(b.data)
        elif b.kind == "iloc":
            out["extents"] = item_locations(b.data)
        elif b.kind == "iref":
            out["refs"] = item_references(b.data)
        elif b.kind == "idat":
            out["idat"] = b.data
        elif b.kind == "iprp":
            for c in children(b.data):
                if c.kind == "ipco":
                    out["properties"] = [{"prop_index": k} | read_property(p.kind, p.data) for k, p in enumerate(children(c.data), 1)]
                elif c.kind == "ipma":
                    out["links"] += property_links(c.data)
    if out["primary_id"] is not None and all(i["item_id"] != out["primary_id"] for i in out["items"]):
        raise BadFile("the primary item is missing")
    if any(x["prop_index"] > len(out["properties"]) for x in out["links"]):
        raise BadFile("property index out of range")
    return out


def read_tracks(data: bytes) -> list[dict]:
    """Tracks with the raw runs of their sample tables; the runs are expanded by DataFrame operations."""
    out = []
    for moov in (b for b in children(data, top=True) if b.kind == "moov"):
        for trak in (b for b in children(moov.data) if b.kind == "trak"):
            boxes: dict[str, bytes] = {}
            refs: list[str] = []
            for _, _, b in tree(trak.data):
                boxes.setdefault(b.kind, b.data)
            for b in children(boxes.get("tref", b"")):
                refs.append(b.kind)
            t = Bytes(boxes.get("tkhd", b""))
            version, _ = t.full()
            t.take(16 if version else 8)
            row: dict = {"track_id": t.uint(4), "handler": handler(boxes["hdlr"]) if "hdlr" in boxes else None, "refs": refs}
            row["timescale"] = Bytes(boxes["mdhd"], 20 if boxes["mdhd"][0] else 12).uint(4) if "mdhd" in boxes else 0

            def table(kind, *fields, boxes=boxes):
                if kind not in boxes:
                    return []
                r = Bytes(boxes[kind])
                r.full()
                n = r.uint(4)
                width = sum(abs(f) for f in fields)
                if n * width > r.left():
                    raise BadFile(f"{kind} is cut off")
                return [[r.sint(-f) if f < 0 else r.uint(f) for f in fields] for _ in range(n)]

            sizes = []
            if "stsz" in boxes:
                r = Bytes(boxes["stsz"])
                r.full()
                same, n = r.uint(4), r.uint(4)
                if n > (1 << 24) or (not same and 4 * n > r.left()):
                    raise BadFile("stsz is cut off")
                sizes = [same] * n if same else list(struct.unpack(f">{n}I", r.take(4 * n)))
            row |= {
                "sizes": sizes, "chunks": [x for x, in table("stco", 4)] or [x for x, in table("co64", 8)], "stsc": table("stsc", 4, 4, 4),
                "stts": table("stts", 4, 4), "ctts": table("ctts", 4, -4), "stss": [x for x, in table("stss", 4)] if "stss" in boxes else None,
            }
            out.append(row)
    return out
