"""HEVC streams: NAL units, Exp-Golomb fields, parameter sets for inspection, picture hashes, reference kernels.

These follow the syntax and tables of ITU-T H.265. Decoding of slice data isn't part of this module.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np


def split_annex_b(stream: bytes) -> list[bytes]:
    """NAL units between start codes, zeros behind them dropped."""
    starts, at = [], 0
    while (at := stream.find(b"\0\0\1", at)) >= 0:
        starts.append(at)
        at += 3
    ends = [*starts[1:], len(stream)]
    return [n for a, b in zip(starts, ends, strict=True) if (n := stream[a + 3 : b].rstrip(b"\0"))]


def from_lengths(data: bytes, size: int, sets: list[bytes] = ()) -> bytes:
    """Length-prefixed NAL units as a stream with start codes, parameter sets first."""
    out, at = [b"\0\0\0\1" + n for n in sets], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + size], "big")
        at += size
        if at + n > len(data):
            raise ValueError("NAL unit runs over the end")
        out.append(b"\0\0\0\1" + data[at : at + n])
        at += n
    return b"".join(out)


def unescape(nal: bytes) -> bytes:
    """Without the 3 of every 00 00 03."""
    return nal.replace(b"\0\0\3", b"\0\0")


def nal_header(nal: bytes) -> dict:
    x = int.from_bytes(nal[:2], "big")
    if x >> 15 or not x & 7:
        raise ValueError("NAL header")
    return {"type": x >> 9 & 63, "layer": x >> 3 & 63, "temporal_id": (x & 7) - 1}


def is_rasl(kind: int) -> bool:
    return kind in (8, 9)


def is_irap(kind: int) -> bool:
    return 16 <= kind <= 23


def is_slice(kind: int) -> bool:
    return kind < 32


def is_tid0_candidate(kind: int, temporal_id: int) -> bool:
    """May a picture be the anchor of later order counts: sublayer 0, no leading picture, no sub-layer non-reference."""
    return temporal_id == 0 and not 6 <= kind <= 9 and not (kind < 16 and kind % 2 == 0)


def access_units(stream: bytes) -> Iterator[list[bytes]]:
    """NAL units of one picture after another: a new one starts with the first slice, or what may stand before it."""
    unit: list[bytes] = []
    seen = False
    for nal in split_annex_b(stream):
        h = nal_header(nal)
        first = is_slice(h["type"]) and len(nal) > 2 and nal[2] >> 7
        before = h["type"] in (32, 33, 34, 35, 39) or 41 <= h["type"] <= 44 or 48 <= h["type"] <= 55
        if seen and (first or before):
            yield unit
            unit, seen = [], False
        unit.append(nal)
        seen = seen or is_slice(h["type"])
    if unit:
        yield unit


class Bits:
    """Fields of an RBSP, most significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def u(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("bits run out")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        x = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n)
        self.at += n
        return x & ((1 << n) - 1)

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 32:
                raise ValueError("Exp-Golomb of more than 32 zeros")
        return (1 << zeros) - 1 + (self.u(zeros) if zeros else 0)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k & 1 else -(k // 2)


def _tiers(r: Bits, sub_layers: int) -> dict:
    general = r.u(2), r.u(1), r.u(5)
    compatible = r.u(32)
    r.u(48)
    level = r.u(8)
    flags = [(r.u(1), r.u(1)) for _ in range(sub_layers)]
    if sub_layers:
        r.u(2 * (8 - sub_layers))
    for p, q in flags:
        r.u(88 * p)
        r.u(8 * q)
    return {"profile": general[2], "tier": general[1], "compatible": compatible, "level": level}


def sps(nal: bytes) -> dict:
    """The head of a sequence parameter set: size, window, format and depths."""
    r = Bits(unescape(nal[2:]))
    out: dict = {"vps": r.u(4)}
    sub = r.u(3)
    r.u(1)
    out |= _tiers(r, sub) | {"id": r.ue(), "chroma": r.ue()}
    if out["chroma"] == 3:
        out["separate_planes"] = r.u(1)
    out |= {"width": r.ue(), "height": r.ue(), "window": [0, 0, 0, 0]}
    if r.u(1):
        out["window"] = [r.ue() for _ in range(4)]
    out |= {"luma_depth": r.ue() + 8, "chroma_depth": r.ue() + 8, "poc_bits": r.ue() + 4}
    info = r.u(1)
    out["reorder"] = [(r.ue() + 1, r.ue(), r.ue()) for _ in range(sub + 1 if info else 1)][-1]
    out |= {"min_block": 1 << (r.ue() + 3)}
    out |= {"ctb": out["min_block"] << r.ue(), "min_transform": 1 << (r.ue() + 2)}
    out |= {"max_transform": out["min_transform"] << r.ue()}
    sx, sy = {0: (1, 1), 1: (2, 2), 2: (2, 1), 3: (1, 1)}[out["chroma"]]
    a, b, c, d = out["window"]
    out["shown"] = out["width"] - sx * (a + b), out["height"] - sy * (c + d)
    return out


def order_count(lsb: int, bits: int, irap: bool, anchor: int | None) -> int:
    """Picture order count from its low bits and the last anchor's count."""
    if irap or anchor is None:
        return lsb
    size = 1 << bits
    low, high = anchor % size, anchor - anchor % size
    if lsb < low and low - lsb >= size // 2:
        high += size
    elif lsb > low and lsb - low > size // 2:
        high -= size
    return high + lsb


def reference_list(before: list, after: list, long_term: list, active: int, entries: list[int] | None = None) -> list:
    """Nearest before, nearest after, long-term; repeated to the active number, or picked by explicit entries."""
    base = [*before, *after, *long_term]
    if not base:
        raise ValueError("no reference pictures")
    full = [base[k % len(base)] for k in range(max(active, len(base)))]
    return [full[e] for e in entries[:active]] if entries is not None else full[:active]


def scaled_motion(mv: tuple[int, int], td: int, tb: int) -> tuple[int, int]:
    """A motion vector over another distance of order counts."""
    td, tb = max(-128, min(127, td)), max(-128, min(127, tb))
    tx = int((16384 + (abs(td) >> 1)) / td)
    factor = max(-4096, min(4095, (tb * tx + 32) >> 6))
    one = lambda v: max(-32768, min(32767, (abs(factor * v) + 127 >> 8) * (1 if factor * v >= 0 else -1)))
    return one(mv[0]), one(mv[1])


# ---- picture hashes -------------------------------------------------------------------------------------------------


def _plane_bytes(plane: np.ndarray, depth: int) -> bytes:
    return plane.astype("<u2" if depth > 8 else "u1").tobytes()


def plane_md5(plane: np.ndarray, depth: int) -> bytes:
    return hashlib.md5(_plane_bytes(plane, depth)).digest()


def plane_crc(plane: np.ndarray, depth: int) -> int:
    """CRC of polynomial 0x1021 from 0xFFFF, low byte of a sample first, flushed by 16 zero bits."""
    crc = 0xFFFF
    for byte in _plane_bytes(plane, depth) + b"\0\0":
        for k in range(7, -1, -1):
            top = crc >> 15
            crc = ((crc << 1) | (byte >> k & 1)) & 0xFFFF
            if top:
                crc ^= 0x1021
    return crc


def plane_checksum(plane: np.ndarray, depth: int) -> int:
    h, w = plane.shape
    x, y = np.arange(w)[None, :], np.arange(h)[:, None]
    mask = (x & 255) ^ (y & 255) ^ (x >> 8) ^ (y >> 8)
    v = plane.astype(np.int64)
    total = int(((v & 255) ^ mask).sum())
    if depth > 8:
        total += int(((v >> 8) ^ mask).sum())
    return total & 0xFFFFFFFF


def picture_hash(sei: bytes, planes: int) -> tuple[str, list] | None:
    """The kind and values of a decoded picture hash message (payload 132), or None."""
    at = 0
    while at + 2 <= len(sei) and sei[at:] != b"\x80":
        kind = size = 0
        while sei[at] == 255:
            kind, at = kind + 255, at + 1
        kind, at = kind + sei[at], at + 1
        while sei[at] == 255:
            size, at = size + 255, at + 1
        size, at = size + sei[at], at + 1
        body, at = sei[at : at + size], at + size
        if kind == 132:
            name, n = {0: ("md5", 16), 1: ("crc", 2), 2: ("checksum", 4)}[body[0]]
            parts = [body[1 + k * n : 1 + (k + 1) * n] for k in range(planes)]
            return name, parts if name == "md5" else [int.from_bytes(p, "big") for p in parts]
    return None


# ---- transforms -----------------------------------------------------------------------------------------------------

# The first column of the 32-point core transform, in order of frequency, and the 4-point DST.
BASIS = (64, 90, 90, 90, 89, 88, 87, 85, 83, 82, 80, 78, 75, 73, 70, 67, 64, 61, 57, 54, 50, 46, 43, 38, 36, 31, 25, 22, 18, 13, 9, 4)
DST4 = np.array([[29, 55, 74, 84], [74, 74, 0, -74], [84, -29, -74, 55], [55, -84, 74, -29]], dtype=np.int64)
CHROMA_QP = (29, 30, 31, 32, 33, 33, 34, 34, 35, 35, 36, 36, 37, 37)


def core_matrix(n: int) -> np.ndarray:
    """Row k, column x: the sample of a cosine whose 32-point frequency is k * 32 / n, by its symmetries."""
    out = np.zeros((n, n), dtype=np.int64)
    for k in range(n):
        for x in range(n):
            phase = (2 * x + 1) * k * (32 // n) % 128  # in 1/128 of a turn
            if phase > 64:
                phase = 128 - phase
            out[k, x] = (BASIS[phase] if phase < 32 else 0 if phase == 32 else -BASIS[64 - phase]) if phase else 64
    return out


def inverse_transform(levels: np.ndarray, depth: int, dst: bool = False) -> np.ndarray:
    """Columns, then rows, clipped to 16 bits between."""
    m = DST4 if dst else core_matrix(len(levels))
    first = np.clip((m.T @ levels.astype(np.int64) + 64) >> 7, -32768, 32767)
    shift = 20 - depth
    return (first @ m + (1 << (shift - 1))) >> shift


def forward_transform(residual: np.ndarray, depth: int, dst: bool = False) -> np.ndarray:
    n = len(residual)
    m, log2 = DST4 if dst else core_matrix(n), n.bit_length() - 1
    s1, s2 = log2 + depth - 9, log2 + 6
    first = (residual.astype(np.int64) @ m.T + (1 << s1 >> 1)) >> s1
    return (m @ first + (1 << (s2 - 1))) >> s2


def hadamard_cost(difference: np.ndarray) -> int:
    """Sums of absolute 4x4 Hadamard coefficients, halved by block."""
    h = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])
    total = 0
    for y in range(0, difference.shape[0], 4):
        for x in range(0, difference.shape[1], 4):
            total += int(np.abs(h @ difference[y : y + 4, x : x + 4] @ h.T).sum()) // 2
    return total


def chroma_qp(qp: int, chroma: int = 1) -> int:
    if chroma != 1:
        return min(qp, 51)
    return qp if qp < 30 else CHROMA_QP[qp - 30 + 0] if qp < 44 else qp - 6


def intra_dc(left: np.ndarray, top: np.ndarray) -> int:
    n = len(left)
    return int(left.sum() + top.sum() + n) >> (n.bit_length())


def intra_planar(left: np.ndarray, top: np.ndarray, below_left: int, above_right: int) -> np.ndarray:
    n = len(left)
    x, y = np.arange(n)[None, :], np.arange(n)[:, None]
    return ((n - 1 - x) * left[:, None] + (x + 1) * above_right + (n - 1 - y) * top[None, :] + (y + 1) * below_left + n) >> n.bit_length()


def bi_average(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    shift = 15 - depth
    return np.clip((a + b + (1 << (shift - 1))) >> shift, 0, (1 << depth) - 1)


# ---- parameter sets and reference sets ------------------------------------------------------------------------------


def vps(nal: bytes) -> dict:
    r = Bits(unescape(nal[2:]))
    out = {"id": r.u(4)}
    r.u(2)
    out |= {"layers": r.u(6) + 1, "sub_layers": r.u(3) + 1, "nesting": bool(r.u(1))}
    if r.u(16) != 0xFFFF:
        raise ValueError("reserved bits of a VPS")
    return out | _tiers(r, out["sub_layers"] - 1)


def pps(nal: bytes) -> dict:
    """A picture parameter set up to its range extension."""
    r = Bits(unescape(nal[2:]))
    out: dict = {"id": r.ue(), "sps": r.ue(), "dependent_slices": r.u(1), "output_flag": r.u(1), "extra_bits": r.u(3), "sign_hiding": r.u(1), "cabac_init": r.u(1)}
    out |= {"active_l0": r.ue() + 1, "active_l1": r.ue() + 1, "qp": 26 + r.se(), "constrained_intra": r.u(1), "transform_skip": r.u(1), "qp_delta_depth": None}
    if r.u(1):
        out["qp_delta_depth"] = r.ue()
    out |= {"cb_offset": r.se(), "cr_offset": r.se(), "slice_chroma_offsets": r.u(1), "weighted": r.u(1), "weighted_bi": r.u(1), "bypass": r.u(1)}
    tiles, out["wavefront"] = r.u(1), r.u(1)
    out |= {"columns": [], "rows": [], "uniform": True, "tile_counts": (1, 1)}
    if tiles:
        n, m = r.ue() + 1, r.ue() + 1
        out["tile_counts"], out["uniform"] = (n, m), bool(r.u(1))
        if not out["uniform"]:
            out["columns"], out["rows"] = [r.ue() + 1 for _ in range(n - 1)], [r.ue() + 1 for _ in range(m - 1)]
        out["filter_across_tiles"] = r.u(1)
    out["filter_across_slices"] = r.u(1)
    if r.u(1):
        out["deblock_override"], off = r.u(1), r.u(1)
        out["deblock"] = None if off else (2 * r.se(), 2 * r.se())
    return out


def uniform_spacing(n: int, total: int) -> list[int]:
    return [(k + 1) * total // n - k * total // n for k in range(n)]


def tile_scan(width: int, height: int, columns: list[int], rows: list[int]) -> list[int]:
    """Raster addresses of the coding tree blocks in tile order."""
    if sum(columns) != width or sum(rows) != height:
        raise ValueError("tiles that don't cover the picture")
    out, y = [], 0
    for h in rows:
        x = 0
        for w in columns:
            out += [(y + j) * width + x + i for j in range(h) for i in range(w)]
            x += w
        y += h
    return out


def short_term_set(r: Bits, index: int, known: list[list[tuple[int, bool]]], in_slice: bool = False) -> list[tuple[int, bool]]:
    """(distance of order counts, used by this picture): before nearest first, then after nearest first."""
    if index and r.u(1):
        back = r.ue() + 1 if in_slice else 1
        if back > index:
            raise ValueError("reference set before the first")
        sign = r.u(1)
        delta = (1 - 2 * sign) * (r.ue() + 1)
        base = known[index - back]
        found = []
        for d, _ in [*base, (0, True)]:
            used = bool(r.u(1))
            if used or r.u(1):
                found.append((d + delta, used))
        before = sorted((x for x in found if x[0] < 0), reverse=True)
        return before + sorted(x for x in found if x[0] > 0)
    n_before, n_after = r.ue(), r.ue()
    if n_before + n_after > 16:
        raise ValueError("too many reference pictures")
    out, d = [], 0
    for _ in range(n_before):
        d -= r.ue() + 1
        out.append((d, bool(r.u(1))))
    d = 0
    for _ in range(n_after):
        d += r.ue() + 1
        out.append((d, bool(r.u(1))))
    return out


# ---- prediction and filters -----------------------------------------------------------------------------------------

# Interpolation filters for quarter luma and eighth chroma samples.
LUMA_TAPS = np.array([[0, 0, 0, 64, 0, 0, 0, 0], [-1, 4, -10, 58, 17, -5, 1, 0], [-1, 4, -11, 40, 40, -11, 4, -1], [0, 1, -5, 17, 58, -10, 4, -1]])
CHROMA_TAPS = np.array([[0, 64, 0, 0], [-2, 58, 10, -2], [-4, 54, 16, -2], [-6, 46, 28, -4], [-4, 36, 36, -4], [-4, 28, 46, -6], [-2, 16, 54, -4], [-2, 10, 58, -2]])


def interpolate(plane: np.ndarray, x: int, y: int, fx: int, fy: int, width: int, height: int, depth: int, taps: np.ndarray = LUMA_TAPS) -> np.ndarray:
    """A block at a fractional place, at 14 bits; samples outside the plane repeat its edge."""
    n = taps.shape[1]
    lead = n // 2 - 1
    ys = np.clip(np.arange(y - lead, y + height + n - 1 - lead), 0, plane.shape[0] - 1)
    xs = np.clip(np.arange(x - lead, x + width + n - 1 - lead), 0, plane.shape[1] - 1)
    block = plane[np.ix_(ys, xs)].astype(np.int64)
    if not fx and not fy:
        return block[lead : lead + height, lead : lead + width] << (14 - depth)
    if fx:
        block = sum(taps[fx][k] * block[:, k : k + width] for k in range(n)) >> (depth - 8)
    else:
        block = block[:, lead : lead + width]
    if not fy:
        return block[lead : lead + height]
    return sum(taps[fy][k] * block[k : k + height] for k in range(n)) >> (6 if fx else depth - 8)


def partition(mode: str, x: int, y: int, n: int) -> list[tuple[int, int, int, int]]:
    """The rectangles of a partitioning of a coding block."""
    h, q = n // 2, n // 4
    cuts = {"2Nx2N": ([n], [n]), "2NxN": ([n], [h, h]), "Nx2N": ([h, h], [n]), "NxN": ([h, h], [h, h]), "2NxnU": ([n], [q, n - q]), "2NxnD": ([n], [n - q, q]), "nLx2N": ([q, n - q], [n]), "nRx2N": ([n - q, q], [n])}
    widths, heights = cuts[mode]
    return [(x + sum(widths[:i]), y + sum(heights[:j]), w, g) for j, g in enumerate(heights) for i, w in enumerate(widths)]


def boundary_strength(intra: bool, edge_of_transform: bool, coded: bool, same_motion: bool) -> int:
    if intra:
        return 2
    return 1 if (edge_of_transform and coded) or not same_motion else 0


def sao_band(plane: np.ndarray, band: int, offsets: list[int], depth: int) -> np.ndarray:
    """Offsets for four neighbouring bands of 32."""
    table = np.zeros(32, dtype=np.int64)
    for k, o in enumerate(offsets):
        table[(band + k) % 32] = o
    return np.clip(plane + table[plane >> (depth - 5)], 0, (1 << depth) - 1)


def sao_edge(plane: np.ndarray, direction: int, offsets: list[int], depth: int) -> np.ndarray:
    """Offsets by the signs against two neighbours (0: across, 1: down, 2: falling, 3: rising); edges stay."""
    dy, dx = ((0, 1), (1, 0), (1, 1), (1, -1))[direction]
    out, h, w = plane.astype(np.int64).copy(), *plane.shape
    y, x = np.arange(dy, h - dy), np.arange(abs(dx), w - abs(dx))
    if not len(y) or not len(x):
        return out
    at = lambda a, b: plane[np.ix_(y + a, x + b)].astype(np.int64)
    kind = 2 + np.sign(at(0, 0) - at(-dy, -dx)) + np.sign(at(0, 0) - at(dy, dx))
    table = np.array([offsets[0], offsets[1], 0, offsets[2], offsets[3]])
    out[np.ix_(y, x)] = np.clip(at(0, 0) + table[kind], 0, (1 << depth) - 1)
    return out


def dequantised(levels: np.ndarray, qp: int, depth: int, scale: int = 16) -> np.ndarray:
    step = (40, 45, 51, 57, 64, 72)[qp % 6]
    shift = depth + (len(levels).bit_length() - 1) - 5
    v = ((levels.astype(np.int64) * scale * step) << (qp // 6)) + (1 << (shift - 1))
    return np.clip(v >> shift, -32768, 32767)


def quantised(coefficients: np.ndarray, qp: int, depth: int) -> np.ndarray:
    """Levels with the rounding of intra pictures (171 of 512)."""
    factor = (26214, 23302, 20560, 18396, 16384, 14564)[qp % 6]
    shift = 14 + qp // 6 + 15 - depth - (len(coefficients).bit_length() - 1)
    c = coefficients.astype(np.int64)
    return np.sign(c) * ((np.abs(c) * factor + (171 << (shift - 9))) >> shift)


def cropped(plane: np.ndarray, window: list[int], unit_x: int = 1, unit_y: int = 1) -> np.ndarray:
    """Without the conformance window's borders (left, right, top, bottom)."""
    a, b, c, d = window[0] * unit_x, window[1] * unit_x, window[2] * unit_y, window[3] * unit_y
    return plane[c : plane.shape[0] - d, a : plane.shape[1] - b]
