"""Colour profiles and primaries to sRGB, on arrays of light.

Matrix/curve profiles and the coded primaries of H.273; profiles made of lookup tables are refused (None). Arithmetic is
float64, results are samples rounded to the picture's depth.
"""

from __future__ import annotations

import struct

import numpy as np

# Chromaticities (red, green, blue, white) by H.273 code, and the D50 white of profiles.
D65, C_WHITE, D50 = (0.3127, 0.3290), (0.310, 0.316), (0.9642, 1.0, 0.8249)
PRIMARIES = {
    1: ((0.640, 0.330), (0.300, 0.600), (0.150, 0.060), D65),
    2: ((0.640, 0.330), (0.300, 0.600), (0.150, 0.060), D65),
    5: ((0.640, 0.330), (0.290, 0.600), (0.150, 0.060), D65),
    6: ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), D65),
    9: ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), D65),
    11: ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), (0.314, 0.351)),
    12: ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), D65),
}
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])


def xyz(chromaticity) -> np.ndarray:
    x, y = chromaticity
    return np.array([x / y, 1.0, (1 - x - y) / y])


def adaptation(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Bradford adaptation between two whites."""
    a, b = BRADFORD @ source, BRADFORD @ target
    return np.linalg.inv(BRADFORD) @ np.diag(b / a) @ BRADFORD


def to_xyz(primaries: int) -> np.ndarray:
    *rgb, white = PRIMARIES[primaries]
    m = np.stack([xyz(c) for c in rgb], 1)
    return m * np.linalg.solve(m, xyz(white))


def primaries_matrix(primaries: int) -> np.ndarray | None:
    """Linear light of the primaries to linear sRGB."""
    if primaries not in PRIMARIES:
        return None
    white = adaptation(xyz(PRIMARIES[primaries][3]), xyz(D65))
    return np.linalg.inv(to_xyz(1)) @ white @ to_xyz(primaries)


def transfer_curve(code: int):
    """A function from coded values to light, for SDR transfers; None for others."""
    bt709 = lambda x: np.where(x < 0.081, x / 4.5, ((x + 0.099) / 1.099) ** (1 / 0.45))
    srgb = lambda x: np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    curves = {4: lambda x: x**2.2, 5: lambda x: x**2.8, 8: lambda x: x, 13: srgb, 2: srgb, 0: srgb}
    return bt709 if code in (1, 6, 14, 15) else curves.get(code)


def encode_srgb(light: np.ndarray) -> np.ndarray:
    light = np.clip(light, 0, 1)
    return np.where(light <= 0.0031308, light * 12.92, 1.055 * light ** (1 / 2.4) - 0.055)


def convert(data: np.ndarray, depth: int, matrix: np.ndarray, curve) -> np.ndarray:
    """RGBA samples through curve, matrix and the sRGB encoding; alpha stays."""
    most = (1 << depth) - 1
    light = np.stack([curve(k, data[..., k] / most) for k in range(3)], -1) @ matrix.T
    out = data.copy()
    out[..., :3] = np.floor(encode_srgb(light) * most + 0.5)
    return out


def from_primaries(data: np.ndarray, depth: int, primaries: int, transfer: int) -> np.ndarray:
    matrix, curve = primaries_matrix(primaries), transfer_curve(transfer)
    if matrix is None or curve is None:
        raise ValueError("primaries or transfer that aren't converted")
    if primaries in (1, 2) and transfer in (2, 13):
        return data
    return convert(data, depth, matrix, lambda _, x: curve(x))


def parametric(kind: int, p: list[float], x: np.ndarray) -> np.ndarray:
    """The five parametric curves of profiles."""
    g, a, b, c, d, e, f = (p + [0.0] * 7)[:7]
    power = lambda v: np.maximum(v, 0) ** g
    if kind == 0:
        return power(x)
    if kind == 1:
        return np.where(x >= -b / a, power(a * x + b), 0)
    if kind == 2:
        return np.where(x >= -b / a, power(a * x + b) + c, c)
    if kind == 3:
        return np.where(x >= d, power(a * x + b), c * x)
    if kind == 4:
        return np.where(x >= d, power(a * x + b) + e, c * x + f)
    raise ValueError("parametric curve")


def curve_of(tag: bytes):
    kind = tag[:4]
    if kind == b"curv":
        n = int.from_bytes(tag[8:12], "big")
        if n == 0:
            return lambda x: x
        values = np.frombuffer(tag, ">u2", n, 12).astype(float)
        if n == 1:
            return lambda x: x ** (values[0] / 256)
        return lambda x: np.interp(x, np.linspace(0, 1, n), values / 65535)
    if kind == b"para":
        form = int.from_bytes(tag[8:10], "big")
        n = (1, 3, 4, 5, 7)[form]
        p = [v / 65536 for v in struct.unpack_from(f">{n}i", tag, 12)]
        return lambda x: parametric(form, p, x)
    raise ValueError("curve")


def profile(data: bytes) -> tuple[np.ndarray, list] | None:
    """The matrix to linear sRGB and the three curves of an RGB matrix profile; None for other kinds."""
    if len(data) < 132 or data[16:20] != b"RGB ":
        return None
    tags = {}
    for k in range(min(int.from_bytes(data[128:132], "big"), 256)):
        name, at, size = struct.unpack_from(">4sII", data, 132 + 12 * k)
        tags[name] = data[at : at + size]
    names = (b"rXYZ", b"gXYZ", b"bXYZ", b"rTRC", b"gTRC", b"bTRC")
    if any(n not in tags for n in names):
        return None
    columns = [[v / 65536 for v in struct.unpack_from(">3i", tags[n], 8)] for n in names[:3]]
    to_srgb = np.linalg.inv(to_xyz(1)) @ adaptation(np.array(D50), xyz(D65))
    return to_srgb @ np.array(columns).T, [curve_of(tags[n]) for n in names[3:]]


def lab_to_xyz(l: float, a: float, b: float) -> np.ndarray:
    """CIE Lab with the D50 white."""
    y = (l + 16) / 116
    f = np.array([y + a / 500, y, y - b / 200])
    return np.where(f > 6 / 29, f**3, (f - 16 / 116) * 3 * (6 / 29) ** 2) * np.array(D50)
