"""Pictures as arrays: uncompressed items, derived images, transforms, colour and gain maps.

A picture is `Image`: RGBA samples of height x width x 4 and a bit depth. Functions work on one picture; `decoded` runs
them over container rows, one Python task for a batch of items.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ..sources import boxes

MOST_PIXELS, MOST_DEPTH = 1 << 28, 4


@dataclass
class Image:
    data: np.ndarray  # height x width x 4
    depth: int = 8
    has_alpha: bool = False

    @property
    def width(self) -> int:
        return self.data.shape[1]

    @property
    def height(self) -> int:
        return self.data.shape[0]

    @property
    def most(self) -> int:
        return (1 << self.depth) - 1

    def with_data(self, data: np.ndarray) -> Image:
        return Image(data, self.depth, self.has_alpha)


def check_size(width: int, height: int, most: int = MOST_PIXELS) -> None:
    if width == 0 or height == 0 or width * height > most:
        raise boxes.BadFile(f"image of {width} x {height}")


def filled(width: int, height: int, depth: int, rgba) -> Image:
    return Image(np.broadcast_to(np.array(rgba, dtype=np.uint16), (height, width, 4)).copy(), depth)


def rescale(v: np.ndarray, source: int, target: int) -> np.ndarray:
    """Samples from one maximum to another, rounded."""
    if source == target:
        return v.astype(np.int64)
    return (v.astype(np.int64) * target + source // 2) // source


def to_rgba8(image: Image) -> np.ndarray:
    return rescale(image.data, image.most, 255).astype(np.uint8)


def to_rgb8(image: Image) -> np.ndarray:
    return to_rgba8(image)[..., :3]


def crop(image: Image, x: int, y: int, width: int, height: int) -> Image:
    return image.with_data(image.data[y : y + height, x : x + width])


def rotate(image: Image, quarters: int) -> Image:
    return image.with_data(np.rot90(image.data, quarters % 4))


def mirror(image: Image, top_bottom: bool) -> Image:
    return image.with_data(image.data[::-1] if top_bottom else image.data[:, ::-1])


def half_away(v: float) -> int:
    return math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)


def clean_aperture(image: Image, numbers) -> Image:
    """A centred rational rectangle, rounded half away from zero."""
    wn, wd, hn, hd, xn, xd, yn, yd = numbers
    if not (wd and hd and xd and yd):
        raise boxes.BadFile("clap with a zero denominator")
    w, h = wn / wd, hn / hd
    left = max(0, half_away(xn / xd + (image.width - 1) / 2 - (w - 1) / 2))
    top = max(0, half_away(yn / yd + (image.height - 1) / 2 - (h - 1) / 2))
    return crop(image, left, top, half_away(w), half_away(h))


def attach_alpha(image: Image, alpha: Image) -> Image:
    """The first channel of alpha, at the image's depth."""
    if alpha.width < image.width or alpha.height < image.height:
        raise boxes.BadFile("alpha smaller than its image")
    data = image.data.copy()
    data[..., 3] = rescale(alpha.data[: image.height, : image.width, 0], alpha.most, image.most)
    return Image(data, image.depth, True)


def draw(canvas: Image, source: Image, x: int, y: int) -> Image:
    """source over canvas at (x, y), clipped; integer arithmetic."""
    x0, y0 = max(0, x), max(0, y)
    x1, y1 = min(canvas.width, x + source.width), min(canvas.height, y + source.height)
    if x0 >= x1 or y0 >= y1:
        return canvas
    data = canvas.data.astype(np.int64)
    src = source.data[y0 - y : y1 - y, x0 - x : x1 - x].astype(np.int64)
    part, most = data[y0:y1, x0:x1], source.most
    a = src[..., 3:4]
    part[..., :3] = (rescale(src[..., :3], most, canvas.most) * a + part[..., :3] * (most - a) + most // 2) // most
    alpha = canvas.has_alpha
    if source.has_alpha:
        below = part[..., 3]
        part[..., 3] = rescale(np.minimum(a[..., 0] + below * (most - a[..., 0]) // most, most), most, canvas.most)
        alpha = True
    return Image(data.astype(np.uint16), canvas.depth, alpha)


def assemble_grid(tiles: list[Image], rows: int, columns: int, width: int, height: int) -> Image:
    if len(tiles) != rows * columns or not tiles:
        raise boxes.BadFile("grid with a wrong number of tiles")
    first = tiles[0]
    if any((t.width, t.height, t.depth) != (first.width, first.height, first.depth) for t in tiles):
        raise boxes.BadFile("tiles that differ")
    if first.width * columns < width or first.height * rows < height:
        raise boxes.BadFile("tiles that don't cover the grid")
    lines = [np.concatenate([t.data for t in tiles[r * columns : (r + 1) * columns]], 1) for r in range(rows)]
    return Image(np.concatenate(lines, 0)[:height, :width], first.depth, any(t.has_alpha for t in tiles))


def assemble_overlay(spec: dict, images: list[Image]) -> Image:
    """The canvas in its 16-bit fill colour, images drawn in order."""
    check_size(spec["width"], spec["height"])
    depth = images[0].depth if images else 8
    most = (1 << depth) - 1
    canvas = filled(spec["width"], spec["height"], depth, [int(rescale(np.array(v), 65535, most)) for v in spec["fill"]])
    canvas.has_alpha = spec["fill"][3] != 65535
    for image, (x, y) in zip(images, spec["offsets"], strict=True):
        canvas = draw(canvas, image, x, y)
    return canvas


# ---- uncompressed items ---------------------------------------------------------------------------------------------

# Component types of ISO/IEC 23001-17 and the names used here.
ROLES = {0: "mono", 1: "y", 2: "cb", 3: "cr", 4: "r", 5: "g", 6: "b", 7: "a", 12: "pad"}
FALLBACK = {1: ["mono"], 2: ["mono", "a"], 3: ["r", "g", "b"], 4: ["r", "g", "b", "a"]}
SAMPLING = {0: (1, 1), 1: (2, 1), 2: (2, 2), 3: (4, 1)}
COMPONENT, PIXEL, MIXED, ROW, TILE_COMPONENT = 0, 1, 2, 3, 4


def roles_of(config: dict, types: list[int] | None) -> list[str]:
    n = len(config["components"])
    if types is None:
        if n not in FALLBACK:
            raise boxes.BadFile("components without types")
        return FALLBACK[n]
    out = []
    for c in config["components"]:
        if c["index"] >= len(types) or types[c["index"]] not in ROLES:
            raise boxes.BadFile("unknown component")
        out.append(ROLES[types[c["index"]]])
    return out


def component_size(role: str, sampling: int, width: int, height: int) -> tuple[int, int]:
    if sampling not in SAMPLING:
        raise boxes.BadFile("sampling")
    sx, sy = SAMPLING[sampling] if role in ("cb", "cr") else (1, 1)
    if width % sx or height % sy:
        raise boxes.BadFile("size that sampling doesn't divide")
    return width // sx, height // sy


class BitRows:
    """Reads samples of any depth from bytes, most significant bit first; aligned ones may be little-endian."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8))
        self.at = 0

    def align(self, size: int, start: int = 0) -> None:
        step = 8 * size
        if step:
            self.at = start + -(-(self.at - start) // step) * step

    def take(self, n: int, depth: int, align: int, little: bool) -> np.ndarray:
        """n samples of depth bits, each in align bytes if that isn't 0."""
        slot = align * 8 if align else depth
        if align:
            self.align(1)
        end = self.at + n * slot
        if end > len(self.bits):
            raise boxes.BadFile("samples run over the end")
        part = self.bits[self.at : end].reshape(n, slot)
        self.at = end
        if little and align > 1:
            part = part.reshape(n, align, 8)[:, ::-1].reshape(n, slot)
        part = part[:, slot - depth :]
        return part.astype(np.int64) @ (1 << np.arange(depth - 1, -1, -1, dtype=np.int64))


def read_planes(data: bytes, config: dict, roles: list[str], width: int, height: int) -> list[np.ndarray]:
    """A plane of samples for each component."""
    if config["block_size"] or config.get("pad_lsb") or config.get("block_reversed"):
        raise boxes.BadFile("blocked samples")
    if any(c["format"] or not 1 <= c["depth"] <= 16 for c in config["components"]):
        raise boxes.BadFile("sample format")
    mode, columns, rows = config["interleave"], config["columns"], config["rows"]
    if width % columns or height % rows or mode > TILE_COMPONENT:
        raise boxes.BadFile("tiles or interleaving")
    tw, th, little = width // columns, height // rows, config["little_endian"]
    planes = [np.zeros(component_size(r, config["sampling"], width, height)[::-1], dtype=np.int64) for r in roles]
    sizes = [component_size(r, config["sampling"], tw, th) for r in roles]
    reader, entries = BitRows(data), list(enumerate(config["components"]))

    def put(k, column, row, y, values):
        w, h = sizes[k]
        planes[k][row * h + y, column * w : column * w + len(values)] = values

    def component(k, column, row):
        c, (w, h) = config["components"][k], sizes[k]
        for y in range(h):
            start = reader.at
            put(k, column, row, y, reader.take(w, c["depth"], c["align"], little))
            reader.align(config["row_align"], start)
        reader.align(1)

    if mode == TILE_COMPONENT:
        for k, _ in entries:
            for t in range(columns * rows):
                start = reader.at
                component(k, t % columns, t // columns)
                reader.align(config["tile_align"], start)
        return planes
    for t in range(columns * rows):
        column, row, start = t % columns, t // columns, reader.at
        if mode == COMPONENT:
            for k, _ in entries:
                component(k, column, row)
        elif mode == MIXED:
            chroma = [k for k, r in enumerate(roles) if r in ("cb", "cr")]
            for k, _ in entries:
                if k not in chroma:
                    component(k, column, row)
                elif k == chroma[0]:
                    w, h = sizes[k]
                    for y in range(h):
                        begin = reader.at
                        both = np.array([[reader.take(1, config["components"][j]["depth"], config["components"][j]["align"], little)[0] for j in chroma] for _ in range(w)])
                        for j, q in enumerate(chroma):
                            put(q, column, row, y, both[:, j])
                        reader.align(config["row_align"], begin)
        else:
            if len(set(sizes)) > 1:
                raise boxes.BadFile("sampling with interleaved pixels")
            for y in range(th):
                begin = reader.at
                if mode == ROW:
                    for k, c in entries:
                        inner = reader.at
                        put(k, column, row, y, reader.take(tw, c["depth"], c["align"], little))
                        reader.align(config["row_align"], inner)
                    continue
                for x in range(tw):
                    first = reader.at
                    for k, c in entries:
                        planes[k][row * th + y, column * tw + x] = reader.take(1, c["depth"], c["align"], little)[0]
                    if config["pixel_size"]:
                        reader.at = first + 8 * config["pixel_size"]
                    else:
                        reader.align(1 if any(c["align"] for _, c in entries) else 0)
                reader.align(config["row_align"], begin)
        reader.align(config["tile_align"], start)
    return planes


def compose(planes: list[np.ndarray], roles: list[str], depths: list[int], width: int, height: int, colour: dict | None = None) -> Image:
    """Planes to RGBA at the largest depth (8 at least)."""
    by = {r: (p, d) for r, p, d in zip(roles, planes, depths, strict=True)}
    depth = max(8, max(d for r, (_, d) in by.items() if r != "pad"))
    most = (1 << depth) - 1
    out = np.full((height, width, 4), most, dtype=np.int64)
    level = lambda r: rescale(by[r][0], (1 << by[r][1]) - 1, most)
    if "y" in by and "cb" in by and "cr" in by:
        out[..., :3] = ycbcr_to_rgb(by["y"][0], by["cb"][0], by["cr"][0], by["y"][1], by["cb"][1], depth, **(colour or {}))
    elif "r" in by and "g" in by and "b" in by:
        for k, r in enumerate("rgb"):
            out[..., k] = level(r)
    elif "mono" in by or "y" in by:
        out[..., :3] = level("mono" if "mono" in by else "y")[..., None]
    else:
        raise boxes.BadFile("components that make no image")
    if "a" in by:
        out[..., 3] = level("a")
    return Image(out.astype(np.uint16), depth, "a" in by)


# ---- colour ---------------------------------------------------------------------------------------------------------

WEIGHTS = {1: (0.2126, 0.0722), 4: (0.30, 0.11), 7: (0.212, 0.087), 9: (0.2627, 0.0593), 10: (0.2627, 0.0593)}
FRACTION = 14


def upsampled(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """Chroma terms on the luma grid: bilinear, chroma samples at even places, the last repeated. Terms are doubled for
    each axis that is interpolated, so that they stay integers; returns them with the number of doublings' scale."""
    for axis, size in ((1, width), (0, height)):
        n = plane.shape[axis]
        if n == size:
            continue
        after = np.concatenate([np.take(plane, range(1, n), axis), np.take(plane, [n - 1], axis)], axis)
        both = np.stack([2 * plane, plane + after], axis + 1)
        shape = list(plane.shape)
        shape[axis] *= 2
        plane = np.take(both.reshape(shape), range(size), axis)
    return plane


def ycbcr_to_rgb(y, cb, cr, y_depth: int, c_depth: int, depth: int, matrix: int = 6, full_range: bool = True) -> np.ndarray:
    """Fixed-point conversion; matrix 0 is GBR."""
    height, width = y.shape
    most = (1 << depth) - 1
    if matrix == 0:
        return np.stack([rescale(cr, (1 << c_depth) - 1, most), rescale(y, (1 << y_depth) - 1, most), rescale(cb, (1 << c_depth) - 1, most)], -1)
    kr, kb = WEIGHTS.get(matrix, (0.299, 0.114))
    kg = 1 - kr - kb
    low, ys, cs = (0, (1 << y_depth) - 1, (1 << c_depth) - 1) if full_range else (16 << (y_depth - 8), 219 << (y_depth - 8), 224 << (c_depth - 8))
    unit = most * (1 << FRACTION)
    fixed = lambda v: half_away(v * unit)
    luma = (y.astype(np.int64) - low) * fixed(1 / ys)
    u, v = cb.astype(np.int64) - (1 << (c_depth - 1)), cr.astype(np.int64) - (1 << (c_depth - 1))
    scale = (2 if u.shape[1] != width else 1) * (2 if u.shape[0] != height else 1)
    terms = [v * fixed(2 * (1 - kr) / cs), -(v * fixed(kr * 2 * (1 - kr) / kg / cs) + u * fixed(kb * 2 * (1 - kb) / kg / cs)), u * fixed(2 * (1 - kb) / cs)]
    out = []
    for t in terms:
        t = upsampled(t, width, height)
        t = (t + scale // 2) // scale if scale > 1 else t
        out.append(np.clip((luma + t + (1 << (FRACTION - 1))) >> FRACTION, 0, most))
    return np.stack(out, -1)


def gain_at(gain: np.ndarray, width: int, height: int) -> np.ndarray:
    """A gain map of 0..1 on the picture's grid: bilinear between sample centres, edges repeated."""
    h, w = gain.shape

    def axis(n, m):
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, m - 1), (at - low).astype(np.float32)

    y0, y1, fy = axis(height, h)
    x0, x1, fx = axis(width, w)
    rows = gain[y0] * (1 - fy)[:, None] + gain[y1] * fy[:, None]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def apply_gain(linear: np.ndarray, gain: np.ndarray, stops: float, weight: float = 1.0, base_offset: float = 0.0, offset: float = 0.0) -> np.ndarray:
    """(base + offset) * 2 ** (gain * stops * weight) - offset, for linear light."""
    return (linear + base_offset) * np.exp2(gain[..., None] * stops * weight) - offset


# ---- items ----------------------------------------------------------------------------------------------------------


class Decoder:
    """Decodes the items of one file; HEVC payloads are refused here."""

    def __init__(self, data: bytes, most_pixels: int = MOST_PIXELS):
        self.data, self.most = data, most_pixels
        self.file = boxes.read_file(data)
        self.items = {}
        for i in self.file["items"]:
            self.items.setdefault(i["item_id"], i)
        entries: dict[int, int] = {}
        self.links: dict[int, list[dict]] = {}
        for x in self.file["links"]:
            if entries.setdefault(x["item_id"], x["entry"]) == x["entry"] and x["prop_index"]:
                self.links.setdefault(x["item_id"], []).append(self.file["properties"][x["prop_index"] - 1])

    def properties(self, item: int, kind: str) -> list[dict]:
        return [p for p in self.links.get(item, []) if p["kind"] == kind]

    def inputs(self, item: int, kind: str = "dimg") -> list[int]:
        rows = [r for r in self.file["refs"] if r["from_id"] == item and r["ref_type"] == kind]
        return [r["to_id"] for r in rows if r["ref_ordinal"] == rows[0]["ref_ordinal"]]

    def bytes_of(self, item: int, depth: int = 0) -> bytes:
        rows = [e for e in self.file["extents"] if e["item_id"] == item]
        rows = [e for e in rows if e["location"] == rows[0]["location"]]
        sources, out = self.inputs(item, "iloc"), b""
        for e in rows:
            if e["method"] == "item":
                if depth >= 8 or not 0 <= max(e["source_index"], 1) - 1 < len(sources):
                    raise boxes.BadFile("items built of items")
                source = self.bytes_of(sources[max(e["source_index"], 1) - 1], depth + 1)
            else:
                source = self.file["idat"] if e["method"] == "idat" else self.data
            end = e["offset"] + e["length"] if e["length"] else len(source)
            if e["offset"] > len(source) or end > len(source):
                raise boxes.BadFile("extent out of range")
            out += source[e["offset"] : end]
            if len(out) > max(len(self.data), 1) * 4:
                raise boxes.BadFile("items that blow up")
        return out

    def decode(self, item: int | None = None, depth: int = 0) -> Image:
        item = self.file["primary_id"] if item is None else item
        if item not in self.items or depth > MOST_DEPTH:
            raise boxes.BadFile("missing item or nesting too deep")
        kind = self.items[item]["item_type"]
        if kind == "unci":
            image = self._uncompressed(item)
        elif kind == "grid":
            g = boxes.read_grid(self.bytes_of(item))
            check_size(g["width"], g["height"], self.most)
            image = assemble_grid([self.decode(t, depth + 1) for t in self.inputs(item)], g["rows"], g["columns"], g["width"], g["height"])
        elif kind == "iovl":
            ids = self.inputs(item)
            image = assemble_overlay(boxes.read_overlay(self.bytes_of(item), len(ids)), [self.decode(t, depth + 1) for t in ids])
        elif kind == "iden":
            image = self.decode(self.inputs(item)[0], depth + 1)
        else:
            raise boxes.BadFile(f"items of type {kind} aren't decoded")
        alpha = next((r["from_id"] for r in self.file["refs"] if r["ref_type"] == "auxl" and r["to_id"] == item and self._is_alpha(r["from_id"])), None)
        if alpha is not None:
            image = attach_alpha(image, self.decode(alpha, depth + 1))
        for p in self.links.get(item, []):
            if p["kind"] == "irot":
                image = rotate(image, p["angle"])
            elif p["kind"] == "imir":
                image = mirror(image, p["mirror"] == "top-bottom")
            elif p["kind"] == "clap":
                image = clean_aperture(image, p["aperture"])
        return image

    def _is_alpha(self, item: int) -> bool:
        return any((p["urn"] or "").endswith((":alpha", ":auxid:1")) for p in self.properties(item, "auxC"))

    def _uncompressed(self, item: int) -> Image:
        size, config = self.properties(item, "ispe"), self.properties(item, "uncC")
        if not size or not config:
            raise boxes.BadFile("unci without size or configuration")
        width, height = size[0]["width"], size[0]["height"]
        check_size(width, height, self.most)
        c = boxes.uncompressed_config(config[0]["raw"])
        if c["version"] == 1:
            raise boxes.BadFile("uncC by profile")
        described = self.properties(item, "cmpd")
        roles = roles_of(c, [t for t, _ in boxes.component_types(described[0]["raw"])] if described else None)
        planes = read_planes(self.bytes_of(item), c, roles, width, height)
        nclx = next((p for p in self.properties(item, "colr") if p["colour_type"] == "nclx"), None)
        colour = {"matrix": nclx["matrix"], "full_range": nclx["full_range"]} if nclx else None
        return compose(planes, roles, [x["depth"] for x in c["components"]], width, height, colour)


def decoded(parsed, items=None):
    """(path, item_id, width, height, bit_depth, has_alpha, data, error) of the primary image of each parsed file."""
    import pyarrow as pa

    schema = "path string, item_id bigint, width int, height int, bit_depth int, has_alpha boolean, data binary, error string"

    def run(batches):
        for batch in batches:
            rows = []
            for path, content, first in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "primary_id")), strict=True):
                row = {"path": path, "item_id": first, "width": None, "height": None, "bit_depth": None, "has_alpha": None, "data": None, "error": None}
                try:
                    i = Decoder(content).decode(first)
                    row |= {"width": i.width, "height": i.height, "bit_depth": i.depth, "has_alpha": i.has_alpha, "data": np.ascontiguousarray(i.data, dtype="<u2").tobytes()}
                except boxes.BadFile as e:
                    row["error"] = str(e)
                rows.append(row)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip([x.split()[0] for x in schema.split(", ")], kinds, strict=True))))

    return parsed.where("error is null and primary_id is not null").select("path", "content", "primary_id").mapInArrow(run, schema)
