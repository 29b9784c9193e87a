"""Writes HEIF containers: items, properties, references, derived images, groups and sample tables."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind.encode("latin-1"), len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind.encode("latin-1")) + body


def full(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def ispe(width: int, height: int) -> bytes:
    return full("ispe", 0, 0, struct.pack(">II", width, height))


def pixi(*depths: int) -> bytes:
    return full("pixi", 0, 0, bytes([len(depths), *depths]))


def nclx(primaries: int, transfer: int, matrix: int, full_range: bool) -> bytes:
    return box("colr", b"nclx", struct.pack(">HHHB", primaries, transfer, matrix, full_range << 7))


def icc(profile: bytes) -> bytes:
    return box("colr", b"prof", profile)


def aux_type(urn: str, subtypes: bytes = b"") -> bytes:
    return full("auxC", 0, 0, urn.encode() + b"\0", subtypes)


def rotation(quarters: int) -> bytes:
    return box("irot", bytes([quarters & 3]))


def mirror(left_right: bool) -> bytes:
    return box("imir", bytes([left_right]))


def clap(*numbers: int) -> bytes:
    return box("clap", struct.pack(">IIIIiIiI", *numbers))


def component_types(*kinds: int) -> bytes:
    return box("cmpd", struct.pack(">I", len(kinds)), *(struct.pack(">H", k) for k in kinds))


def uncompressed(components, interleave=0, sampling=0, block_size=0, flags=0, pixel_size=0, row_align=0, tile_align=0, columns=1, rows=1) -> bytes:
    parts = [struct.pack(">HBBB", k, depth - 1, 0, align) for k, (depth, align) in enumerate(components)]
    tail = struct.pack(">BBBBIIIII", sampling, interleave, block_size, flags, pixel_size, row_align, tile_align, columns - 1, rows - 1)
    return full("uncC", 0, 0, b"\0\0\0\0", struct.pack(">I", len(components)), *parts, tail)


@dataclass
class Item:
    item_id: int
    kind: str
    data: bytes
    hidden: bool
    name: str = ""
    content_type: str | None = None
    links: list[tuple[int, bool]] = field(default_factory=list)
    method: int = 0


class Writer:
    """Collects items and writes one file; the first visible image is primary unless set_primary says otherwise."""

    def __init__(self, major: str = "heic", compatible: tuple[str, ...] = ("mif1", "heic")):
        self.major, self.compatible = major, list(compatible)
        self.items: list[Item] = []
        self.properties: list[bytes] = []
        self.refs: list[tuple[str, int, list[int]]] = []
        self.groups: list[list[int]] = []
        self.primary: int | None = None
        self.track: Track | None = None

    def property(self, data: bytes) -> int:
        """The 1-based index of a property; equal bytes share one."""
        if data not in self.properties:
            self.properties.append(data)
        return self.properties.index(data) + 1

    def add(self, kind: str, data: bytes, properties: tuple[bytes, ...] = (), hidden: bool = False, name: str = "", content_type: str | None = None, method: int = 0) -> int:
        item = Item(len(self.items) + 1, kind, data, hidden, name, content_type, method=method)
        item.links = [(self.property(p), p[4:8] in (b"hvcC", b"irot", b"imir", b"clap", b"uncC", b"cmpd")) for p in properties]
        self.items.append(item)
        return item.item_id

    def add_image(self, kind: str, data: bytes, width: int, height: int, *properties: bytes, hidden: bool = False) -> int:
        n = self.add(kind, data, (ispe(width, height), *properties), hidden)
        if not hidden and self.primary is None:
            self.primary = n
        return n

    def add_grid(self, rows: int, columns: int, width: int, height: int, tiles: list[int], *properties: bytes, hidden: bool = False) -> int:
        wide = max(width, height) > 0xFFFF
        data = bytes([0, wide, rows - 1, columns - 1]) + struct.pack(">II" if wide else ">HH", width, height)
        n = self.add("grid", data, (ispe(width, height), *properties), hidden)
        self.reference("dimg", n, tiles)
        for t in tiles:
            self.items[t - 1].hidden = True
        if not hidden:
            self.primary = n
        return n

    def add_overlay(self, width: int, height: int, fill: tuple[int, ...], images: list[int], offsets: list[tuple[int, int]]) -> int:
        data = bytes([0, 1]) + struct.pack(">4H", *fill) + struct.pack(">II", width, height) + b"".join(struct.pack(">ii", *o) for o in offsets)
        n = self.add("iovl", data, (ispe(width, height),))
        self.reference("dimg", n, images)
        self.primary = n
        return n

    def add_identity(self, image: int, width: int, height: int, *properties: bytes) -> int:
        n = self.add("iden", b"", (ispe(width, height), *properties))
        self.reference("dimg", n, [image])
        return n

    def add_tone_map(self, base: int, gain: int, width: int, height: int, payload: bytes, *properties: bytes) -> int:
        n = self.add("tmap", payload, (ispe(width, height), *properties))
        self.reference("dimg", n, [base, gain])
        self.alternatives([n, base])
        if "tmap" not in self.compatible:
            self.compatible.append("tmap")
        return n

    def add_auxiliary(self, image: int, kind: str, data: bytes, width: int, height: int, urn: str, *properties: bytes) -> int:
        n = self.add(kind, data, (ispe(width, height), *properties, aux_type(urn)), hidden=True)
        self.reference("auxl", n, [image])
        return n

    def add_alpha(self, image: int, kind: str, data: bytes, width: int, height: int, *properties: bytes) -> int:
        return self.add_auxiliary(image, kind, data, width, height, "urn:mpeg:mpegB:cicp:systems:auxiliary:alpha", *properties)

    def add_thumbnail(self, image: int, kind: str, data: bytes, width: int, height: int, *properties: bytes) -> int:
        n = self.add(kind, data, (ispe(width, height), *properties))
        self.reference("thmb", n, [image])
        return n

    def add_exif(self, image: int, tiff: bytes) -> int:
        return self.describe(image, "Exif", b"\0\0\0\0" + tiff)

    def add_xmp(self, image: int, xmp: bytes) -> int:
        return self.describe(image, "mime", xmp, "application/rdf+xml")

    def add_regions(self, image: int, data: bytes, masks: list[int], *properties: bytes) -> int:
        n = self.describe(image, "rgan", data, None, properties)
        if masks:
            self.reference("mask", n, masks)
        return n

    def describe(self, image: int, kind: str, data: bytes, content_type: str | None = None, properties: tuple[bytes, ...] = ()) -> int:
        n = self.add(kind, data, properties, hidden=True, content_type=content_type)
        self.reference("cdsc", n, [image])
        return n

    def add_icc(self, item_id: int, profile: bytes) -> None:
        """Before any clean aperture of the item; an unknown item is left alone."""
        if 0 < item_id <= len(self.items):
            links = self.items[item_id - 1].links
            at = next((k for k, (p, _) in enumerate(links) if self.properties[p - 1][4:8] == b"clap"), len(links))
            links.insert(at, (self.property(icc(profile)), False))

    def reference(self, kind: str, source: int, targets: list[int]) -> None:
        self.refs.append((kind, source, list(targets)))

    def alternatives(self, items: list[int]) -> None:
        if items:
            self.groups.append(list(items))

    def set_primary(self, item_id: int) -> None:
        self.primary = item_id

    def set_sequence(self, track: Track) -> None:
        self.track = track
        self.compatible += [b for b in ("msf1", "hevc") if b not in self.compatible]

    def _fixed(self) -> tuple[bytes, bytes]:
        """What stands before and after the locations, whatever these are."""
        infos = []
        for i in self.items:
            body = struct.pack(">IH4s", i.item_id, 0, i.kind.encode("latin-1")) + i.name.encode() + b"\0"
            if i.content_type is not None:
                body += i.content_type.encode() + b"\0"
            infos.append(full("infe", 3, int(i.hidden), body))
        idat = b"".join(i.data for i in self.items if i.method == 1)
        links = [struct.pack(">IB", i.item_id, len(i.links)) + b"".join(struct.pack(">H", e << 15 | p) for p, e in i.links) for i in self.items if i.links]
        before = [
            full("hdlr", 0, 0, b"\0\0\0\0pict" + bytes(12) + b"\0"),
            full("pitm", 1, 0, struct.pack(">I", self.primary or 0)) if self.primary else b"",
            full("iinf", 1, 0, struct.pack(">I", len(infos)), *infos),
            full("iref", 1, 0, *(box(k, struct.pack(">IH", s, len(t)), struct.pack(f">{len(t)}I", *t)) for k, s, t in self.refs)) if self.refs else b"",
            box("iprp", box("ipco", *self.properties), full("ipma", 1, 1, struct.pack(">I", len(links)), *links)),
        ]
        after = [
            box("idat", idat) if idat else b"",
            box("grpl", *(full("altr", 0, 0, struct.pack(">II", 1000 + k, len(g)), struct.pack(f">{len(g)}I", *g)) for k, g in enumerate(self.groups))) if self.groups else b"",
        ]
        return b"".join(before), b"".join(after)

    def _locations(self, offsets: dict[int, int]) -> bytes:
        places, inner = [], 0
        for i in self.items:
            at = inner if i.method == 1 else offsets.get(i.item_id, 0)
            inner += len(i.data) if i.method == 1 else 0
            places.append(struct.pack(">IHHHQQ", i.item_id, i.method, 0, 1, at, len(i.data)))
        return full("iloc", 2, 0, bytes([0x88, 0]), struct.pack(">I", len(places)), *places)

    def finish(self) -> bytes:
        """Two passes: the first finds how long everything before the data is."""
        head = box("ftyp", self.major.encode(), b"\0\0\0\0", *(b.encode() for b in self.compatible))
        before, after = self._fixed()

        def front(start: int) -> tuple[bytes, int]:
            offsets, at = {}, start
            for i in self.items:
                if i.method == 0:
                    offsets[i.item_id] = at
                    at += len(i.data)
            return head + full("meta", 0, 0, before, self._locations(offsets), after) + (self.track.moov(at) if self.track else b""), at

        size = len(front(0)[0])
        body = b"".join(i.data for i in self.items if i.method == 0) + (b"".join(self.track.data) if self.track else b"")
        extra = 16 if len(body) + 8 >= 1 << 32 else 8
        return front(size + extra)[0] + box("mdat", body)


def runs(values) -> list[tuple[int, int]]:
    """(count, value) of equal neighbours."""
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [tuple(x) for x in out]


@dataclass
class Track:
    """Samples in decoding order, one chunk."""

    width: int
    height: int
    timescale: int = 1000
    handler: str = "pict"
    config: bytes = b""
    data: list[bytes] = field(default_factory=list)
    durations: list[int] = field(default_factory=list)
    sync: list[bool] = field(default_factory=list)
    composition: list[int] = field(default_factory=list)
    per_chunk: int | None = None

    def add_sample(self, data: bytes, duration: int, sync: bool, composition: int = 0) -> None:
        self.data.append(data)
        self.durations.append(duration)
        self.sync.append(sync)
        self.composition.append(composition)

    def stbl(self, offset: int) -> bytes:
        n, sizes = len(self.data), [len(d) for d in self.data]
        step = self.per_chunk or max(n, 1)
        chunks = [offset + sum(sizes[:k]) for k in range(0, n, step)]
        counts = runs([min(step, n - k) for k in range(0, n, step)])
        stsc, first = [], 1
        for k, per in counts:
            stsc.append(struct.pack(">III", first, per, 1))
            first += k
        large = any(c >= 1 << 32 for c in chunks)
        stts = runs(self.durations)
        parts = [
            full("stsd", 0, 0, struct.pack(">I", 1), box("hvc1", bytes(6) + b"\0\1" + bytes(16) + struct.pack(">HH", self.width, self.height) + bytes(50), self.config)),
            full("stts", 0, 0, struct.pack(">I", len(stts)), *(struct.pack(">II", *r) for r in stts)),
            full("stsc", 0, 0, struct.pack(">I", len(stsc)), *stsc),
            full("stsz", 0, 0, struct.pack(">II", sizes[0], n) if n and len(set(sizes)) == 1 else struct.pack(f">II{n}I", 0, n, *sizes)),
            full("co64" if large else "stco", 0, 0, struct.pack(f">I{len(chunks)}{'Q' if large else 'I'}", len(chunks), *chunks)),
        ]
        if any(self.composition):
            ctts = runs(self.composition)
            parts.append(full("ctts", 1, 0, struct.pack(">I", len(ctts)), *(struct.pack(">Ii", *r) for r in ctts)))
        if not all(self.sync):
            at = [k + 1 for k, s in enumerate(self.sync) if s]
            parts.append(full("stss", 0, 0, struct.pack(f">I{len(at)}I", len(at), *at)))
        return box("stbl", *parts)

    def moov(self, offset: int, track_id: int = 1) -> bytes:
        total = sum(self.durations)
        tkhd = full("tkhd", 0, 3, struct.pack(">IIIII", 0, 0, track_id, 0, total), bytes(52), struct.pack(">II", self.width << 16, self.height << 16))
        mdhd = full("mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, self.timescale, total, 0x55C4, 0))
        hdlr = full("hdlr", 0, 0, b"\0\0\0\0" + self.handler.encode() + bytes(12) + b"\0")
        minf = box("minf", full("vmhd", 0, 1, bytes(8)), self.stbl(offset))
        mvhd = full("mvhd", 0, 0, struct.pack(">IIII", 0, 0, self.timescale, total), bytes(80))
        return box("moov", mvhd, box("trak", tkhd, box("mdia", mdhd, hdlr, minf)))
