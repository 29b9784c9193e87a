"""EXIF, IPTC, regions and depth: readers for the bytes of metadata items."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Tag numbers of TIFF/EXIF and dataset numbers of IPTC.
TAGS = {"make": 0x010F, "model": 0x0110, "orientation": 0x0112, "software": 0x0131, "changed": 0x0132, "exif_ifd": 0x8769, "gps_ifd": 0x8825, "iptc": 0x83BB, "taken": 0x9003, "maker_note": 0x927C}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
IPTC_FIELDS = {"caption": (2, 120), "by_line": (2, 80), "copyright": (2, 116), "city": (2, 90), "country": (2, 101), "date_created": (2, 55), "time_created": (2, 60)}
KEYWORDS = (2, 25)
MOST_ENTRIES = 1024


def tiff_of(item: bytes) -> bytes | None:
    """The TIFF block of an Exif item: behind a 4-byte offset, and maybe an Exif mark."""
    if len(item) < 4:
        return None
    block = item[4 + int.from_bytes(item[:4], "big") :]
    block = block.removeprefix(b"Exif\0\0")
    return block if block[:4] in (b"II*\0", b"MM\0*") else None


class Tiff:
    """Entries of the image file directories of a TIFF block."""

    def __init__(self, data: bytes, at: int | None = None, order: str | None = None):
        self.data = data
        self.order = order or ("<" if data[:2] == b"II" else ">")
        self.first = at if at is not None else (struct.unpack_from(self.order + "I", data, 4)[0] if len(data) >= 8 else len(data))

    def entries(self, at: int | None = None) -> Iterator[tuple[int, int, int, bytes]]:
        """(tag, type, count, value bytes) of one directory; values out of range are empty."""
        at = self.first if at is None else at
        if at < 0 or at + 2 > len(self.data):
            return
        n = struct.unpack_from(self.order + "H", self.data, at)[0]
        for k in range(min(n, MOST_ENTRIES)):
            p = at + 2 + 12 * k
            if p + 12 > len(self.data):
                return
            tag, kind, count = struct.unpack_from(self.order + "HHI", self.data, p)
            size = SIZES.get(kind, 1) * count
            q = p + 8 if size <= 4 else struct.unpack_from(self.order + "I", self.data, p + 8)[0]
            yield tag, kind, count, self.data[q : q + size] if q + size <= len(self.data) else b""

    def find(self, tag: int, at: int | None = None) -> tuple[int, int, bytes] | None:
        return next(((k, n, v) for t, k, n, v in self.entries(at) if t == tag), None)

    def integer(self, tag: int, at: int | None = None) -> int | None:
        found = self.find(tag, at)
        if not found or not found[1] or not found[2]:
            return None
        form = {3: "H", 4: "I", 13: "I"}.get(found[0])
        return struct.unpack_from(self.order + form, found[2])[0] if form else None

    def real(self, tag: int, at: int | None = None) -> float | None:
        found = self.find(tag, at)
        if not found or not found[2]:
            return None
        kind, _, v = found
        if kind in (5, 10):
            a, b = struct.unpack_from(self.order + ("II" if kind == 5 else "ii"), v)
            return a / b if b else None
        return struct.unpack_from(self.order + "f", v)[0] if kind == 11 else None

    def text(self, tag: int, at: int | None = None) -> str | None:
        found = self.find(tag, at)
        if not found or found[0] != 2:
            return None
        try:
            return found[2].split(b"\0")[0].decode().strip() or None
        except UnicodeDecodeError:
            return None

    def maker_note(self) -> Tiff | None:
        """The directory of an Apple maker note."""
        sub = self.integer(TAGS["exif_ifd"])
        found = self.find(TAGS["maker_note"], sub) if sub is not None else None
        if not found or not found[2].startswith(b"Apple iOS\0"):
            return None
        return Tiff(found[2], 14, ">" if found[2][12:14] == b"MM" else "<")


def exif(item: bytes) -> dict:
    """The typed view of an Exif item; all null if it holds no TIFF block."""
    out = dict.fromkeys(("make", "model", "software", "date_time", "orientation"), None) | {"has_gps": False}
    block = tiff_of(item)
    if block is None:
        return out
    t = Tiff(block)
    sub = t.integer(TAGS["exif_ifd"])
    turn = t.integer(TAGS["orientation"])
    taken = t.text(TAGS["taken"], sub) if sub is not None else None
    return {
        "make": t.text(TAGS["make"]), "model": t.text(TAGS["model"]), "software": t.text(TAGS["software"]), "date_time": taken or t.text(TAGS["changed"]),
        "orientation": turn if turn and 1 <= turn <= 8 else None, "has_gps": t.integer(TAGS["gps_ifd"]) is not None,
    }


def upright(tiff: bytes) -> bytes:
    """The block with orientation 1."""
    t = Tiff(tiff)
    n = struct.unpack_from(t.order + "H", tiff, t.first)[0] if t.first + 2 <= len(tiff) else 0
    for k in range(min(n, MOST_ENTRIES)):
        p = t.first + 2 + 12 * k
        if p + 12 <= len(tiff) and struct.unpack_from(t.order + "H", tiff, p)[0] == TAGS["orientation"]:
            return tiff[: p + 8] + struct.pack(t.order + "H", 1) + tiff[p + 10 :]
    return tiff


def photoshop_iptc(data: bytes) -> bytes | None:
    """The IPTC resource of a Photoshop block."""
    at = 0
    while data[at : at + 4] == b"8BIM" and at + 7 <= len(data):
        kind, name = int.from_bytes(data[at + 4 : at + 6], "big"), data[at + 6]
        at += 6 + (name + 2) // 2 * 2
        size = int.from_bytes(data[at : at + 4], "big")
        if kind == 0x0404:
            return data[at + 4 : at + 4 + size]
        at += 4 + (size + 1) // 2 * 2
    return None


def iptc(data: bytes) -> list[tuple[int, int, bytes]]:
    """(record, number, value) in order; stops at the first byte that starts no dataset."""
    data = photoshop_iptc(data) or data
    out, at = [], 0
    while at + 5 <= len(data) and data[at] == 0x1C:
        record, number, size = data[at + 1], data[at + 2], int.from_bytes(data[at + 3 : at + 5], "big")
        at += 5
        if size & 0x8000:
            wide = size & 0x7FFF
            if wide > 4 or at + wide > len(data):
                raise ValueError("dataset length")
            size, at = int.from_bytes(data[at : at + wide], "big"), at + wide
        if at + size > len(data):
            raise ValueError("dataset runs over the end")
        out.append((record, number, data[at : at + size]))
        at += size
    return out


def iptc_text(value: bytes, utf8: bool) -> str:
    try:
        text = value.decode()
    except UnicodeDecodeError:
        text = value.decode("utf-8", "replace") if utf8 else value.decode("latin-1")
    return text.rstrip("\0 ")


def iptc_view(data: bytes) -> dict:
    rows = iptc(data)
    utf8 = any((r, n) == (1, 90) and v == b"\x1b%G" for r, n, v in rows)
    texts = lambda key: [t for r, n, v in rows if (r, n) == key and (t := iptc_text(v, utf8))]
    return {name: next(iter(texts(key)), None) for name, key in IPTC_FIELDS.items()} | {"keywords": texts(KEYWORDS)}


REGIONS = ("point", "rectangle", "ellipse", "polygon", "mask", "inline_mask", "polyline")


def regions(data: bytes, masks: list[int]) -> dict:
    """Reference size and the regions of a region item; a region that refers to a mask takes the next of masks."""
    wide = data[1] & 1
    form, step = (">I", 4) if wide else (">H", 2)
    signed = form.lower()
    at, out, left = 2, [], list(masks)

    def number(f):
        nonlocal at
        v = struct.unpack_from(f, data, at)[0]
        at += step
        return v

    size = number(form), number(form)
    n, at = data[at], at + 1
    for k in range(n):
        kind, at = REGIONS[data[at]], at + 1
        row = {"n": k, "kind": kind, "x": None, "y": None, "width": None, "height": None, "points": None, "mask_item": None, "bits": None}
        if kind in ("polygon", "polyline"):
            count = number(form)
            if count * 2 * step > len(data) - at:
                raise ValueError("points run over the end")
            row["points"] = [(number(signed), number(signed)) for _ in range(count)]
        else:
            row["x"], row["y"] = number(signed), number(signed)
            if kind != "point":
                row["width"], row["height"] = number(form), number(form)
        if kind == "mask":
            row["mask_item"] = left.pop(0) if left else None
        elif kind == "inline_mask":
            coding, at = data[at], at + 1
            if coding:
                raise ValueError("coded inline mask")
            size_of = (row["width"] * row["height"] + 7) // 8
            row["bits"], at = data[at : at + size_of], at + size_of
        out.append(row)
    return {"width": size[0], "height": size[1], "regions": out}


def write_regions(width: int, height: int, rows: list[dict]) -> bytes:
    """The inverse; 32-bit fields if any value needs them."""
    flat = [v for r in rows for v in (r["x"], r["y"], *(q for p in r["points"] or () for q in p)) if v is not None]
    sizes = [width, height, *(v for r in rows for v in (r["width"], r["height"], len(r["points"] or ())) if v is not None)]
    wide = any(not -(1 << 15) <= v < 1 << 15 for v in flat) or any(v >= 1 << 16 for v in sizes)
    u, s = (">I", ">i") if wide else (">H", ">h")
    out = [bytes([0, wide]), struct.pack(u, width), struct.pack(u, height), bytes([len(rows)])]
    for r in rows:
        out.append(bytes([REGIONS.index(r["kind"])]))
        if r["points"] is not None:
            out.append(struct.pack(u, len(r["points"])))
            out += [struct.pack(s, q) for p in r["points"] for q in p]
        else:
            out += [struct.pack(s, r["x"]), struct.pack(s, r["y"])]
            if r["width"] is not None:
                out += [struct.pack(u, r["width"]), struct.pack(u, r["height"])]
        if r["kind"] == "inline_mask":
            out += [b"\0", r["bits"]]
    return b"".join(out)


def mask_bit(bits: bytes, width: int, height: int, column: int, row: int) -> bool | None:
    """A bit of an inline mask, most significant first, rows without padding."""
    if not (0 <= column < width and 0 <= row < height):
        return None
    k = row * width + column
    return bool(bits[k >> 3] >> (7 - (k & 7)) & 1) if k >> 3 < len(bits) else None


def user_description(data: bytes) -> dict:
    parts = data[4:].split(b"\0") + [b""] * 4
    return dict(zip(("lang", "name", "description", "tags"), (p.decode("utf-8", "replace") for p in parts), strict=False))


def apple_headroom(m33: float, m48: float) -> float:
    """The headroom of an Apple gain map from its two maker-note numbers."""
    if m33 < 1:
        stops = 1.8 - 20 * m48 if m48 <= 0.01 else 1.601 - 0.101 * m48
    else:
        stops = 3.0 - 70 * m48 if m48 <= 0.01 else 2.303 - 0.303 * m48
    return 2 ** max(0.0, stops)
