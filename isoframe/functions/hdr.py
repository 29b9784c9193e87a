"""Gain-map metadata (ISO 21496-1) and depth information of auxiliary images."""

from __future__ import annotations

from collections.abc import Iterator

import struct
from dataclasses import dataclass

import numpy as np

from .hevc import Bits, unescape


@dataclass
class GainMetadata:
    base_headroom: float  # stops
    alternate_headroom: float
    use_base_colour: bool
    channels: list[dict]  # minimum, maximum, gamma, base_offset, alternate_offset


def parse_gain_metadata(data: bytes) -> GainMetadata:
    """The payload of a tmap item; strict about versions, lengths and denominators."""
    if len(data) < 6 or data[0] or int.from_bytes(data[1:3], "big"):
        raise ValueError("gain-map metadata of an unknown version")
    n = 3 if data[5] & 128 else 1
    if len(data) < 22 + 40 * n:
        raise ValueError("gain-map metadata is cut off")
    at = 6

    def ratio(form):
        nonlocal at
        a, b = struct.unpack_from(f">{form}I", data, at)
        at += 8
        if not b:
            raise ValueError("zero denominator")
        return a / b

    base, other = ratio("I"), ratio("I")
    names = (("minimum", "i"), ("maximum", "i"), ("gamma", "I"), ("base_offset", "i"), ("alternate_offset", "i"))
    channels = [{k: ratio(f) for k, f in names} for _ in range(n)]
    if any(c["gamma"] <= 0 or c["maximum"] < c["minimum"] for c in channels):
        raise ValueError("gain-map range")
    return GainMetadata(base, other, bool(data[5] & 64), channels)


def gain_payload(headroom: float) -> bytes:
    """One channel from 0 to the headroom's stops, gamma 1, no offsets, over an SDR base."""
    stops = struct.pack(">II", round(np.log2(headroom) * 1_000_000), 1_000_000)
    none, one = struct.pack(">II", 0, 1), struct.pack(">II", 1, 1)
    return b"\0\0\0\0\0\x40" + none + stops + none + stops + one + none + none


def weight(meta: GainMetadata, headroom: float) -> float:
    """How much of the gain a display of the given headroom (a ratio) gets; negative if the base is the brighter one."""
    span = meta.alternate_headroom - meta.base_headroom
    if not span:
        return 0.0
    return float(np.clip((np.log2(headroom) - meta.base_headroom) / span, 0, 1) * np.sign(span))


def apply_gain_metadata(linear: np.ndarray, gain: np.ndarray, meta: GainMetadata, headroom: float) -> np.ndarray:
    """linear (h, w, 3) with a gain map (h, w, channels) of 0..1."""
    w, out = weight(meta, headroom), np.empty_like(linear)
    for k in range(3):
        c = meta.channels[k % len(meta.channels)]
        g = gain[..., k % gain.shape[-1]] ** (1 / c["gamma"])
        stops = c["minimum"] + (c["maximum"] - c["minimum"]) * g
        out[..., k] = (linear[..., k] + c["base_offset"]) * np.exp2(stops * w) - c["alternate_offset"]
    return out


def sized(data: bytes) -> list[bytes] | None:
    """Parts that each follow their 4-byte length; None if one runs over the end."""
    parts, at = [], 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return parts if at == len(data) else None


def sei_messages(body: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, payload) of the messages of an SEI unit; type and size are runs of 255 and a last byte."""
    at = 0

    def number() -> int:
        nonlocal at
        total = 0
        while at < len(body):
            at += 1
            total += body[at - 1]
            if body[at - 1] != 255:
                return total
        return -1

    while at < len(body):
        kind, size = number(), number()
        if kind < 0 or size < 0 or at + size > len(body):
            return
        yield kind, body[at : at + size]
        at += size


def depth_info(subtypes: bytes) -> dict | None:
    """Depth representation information (SEI 177) in the tail of an auxC property: groups of NAL units, each with its length;
    the first message of that type in a prefix or suffix SEI unit counts."""
    groups = sized(subtypes)
    for group in groups or ():
        for nal in sized(group) or ():
            if len(nal) > 2 and nal[0] >> 1 in (39, 40):
                for kind, payload in sei_messages(unescape(nal[2:])):
                    if kind == 177:
                        return depth_fields(payload)
    return None


def depth_fields(payload: bytes) -> dict:
    r = Bits(payload)
    flags = [r.u(1) for _ in range(4)]
    out: dict = {"kind": r.ue(), "z_near": None, "z_far": None, "d_min": None, "d_max": None, "reference_view": None, "nonlinear": None}
    if flags[2] or flags[3]:
        out["reference_view"] = r.ue()
    for name, present in zip(("z_near", "z_far", "d_min", "d_max"), flags, strict=True):
        if present:
            out[name] = depth_element(r)
    if out["kind"] == 3:
        out["nonlinear"] = [r.ue() for _ in range(r.ue() + 1)]
    return out


def depth_element(r: Bits) -> float | None:
    """A float of sign, 7-bit exponent and a mantissa of its own length."""
    sign, exponent, size = r.u(1), r.u(7), r.u(5) + 1
    mantissa = r.u(size)
    if exponent == 127:
        return None
    value = 2.0 ** (exponent - 31) * (1 + mantissa / 2**size) if exponent else 2.0 ** -(30 + size) * mantissa
    return -value if sign else value
