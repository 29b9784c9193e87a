"""Colour and transfer functions as Spark columns: nothing here leaves generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of SMPTE ST 2084, ARIB STD-B67 and IEC 61966-2-1; SDR white in cd/m2.
PQ_M1, PQ_M2 = 2610 / 16384, 2523 / 4096 * 128
PQ_C1, PQ_C2, PQ_C3 = 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073
PQ_PEAK, HLG_PEAK, WHITE = 10_000.0, 1_000.0, 203.0


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def pq_to_linear(v: Column) -> Column:
    """1 is SDR white."""
    p = F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / PQ_M2))
    return F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / (PQ_C2 - PQ_C3 * p), F.lit(1 / PQ_M1)) * (PQ_PEAK / WHITE)


def hlg_to_scene(v: Column) -> Column:
    v = F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    return F.when(v <= 0.5, v * v / 3).otherwise((F.exp((v - HLG_C) / HLG_A) + HLG_B) / 12)


def hlg_to_linear(r: Column, g: Column, b: Column) -> list[Column]:
    """Scene light by the inverse OETF, then the reference OOTF for 1000 cd/m2 with BT.2020 luma."""
    scene = [hlg_to_scene(x) for x in (r, g, b)]
    luma = 0.2627 * scene[0] + 0.6780 * scene[1] + 0.0593 * scene[2]
    return [x * F.pow(luma, F.lit(0.2)) * (HLG_PEAK / WHITE) for x in scene]


def kr_kb(matrix: Column) -> tuple[Column, Column]:
    """Luma weights of red and blue by matrix coefficients."""
    kr = F.when(matrix == 1, 0.2126).when(matrix == 4, 0.30).when(matrix == 7, 0.212).when(matrix.isin(9, 10), 0.2627).otherwise(0.299)
    kb = F.when(matrix == 1, 0.0722).when(matrix == 4, 0.11).when(matrix == 7, 0.087).when(matrix.isin(9, 10), 0.0593).otherwise(0.114)
    return kr, kb


def rescale(v: Column, source_max: Column, target_max) -> Column:
    """An integer sample to another depth, rounded."""
    return F.floor((v * target_max + F.floor(source_max / 2)) / source_max)


def quality_to_qp(quality: Column) -> Column:
    return F.greatest(F.least(F.round(68 - 0.6 * F.least(quality, F.lit(100)).cast("double")), F.lit(51.0)), F.lit(8.0)).cast("int")


def human_bytes(n: Column) -> Column:
    """B, whole KB or MB with one digit, in steps of 1000."""
    return (
        F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1_000_000, F.format_string("%.0f KB", F.bround(n / 1000.0, 0)))
        .otherwise(F.format_string("%.1f MB", n / 1e6))
    )


def parse_size(text: Column) -> Column:
    """Bytes of 500K, 2M, 1.5MB or plain numbers; null for anything else."""
    low = F.rtrim(F.lower(F.trim(text)), F.lit("b"))
    unit = F.when(low.endswith("k"), 1000.0).when(low.endswith("m"), 1e6).otherwise(1.0)
    number = F.trim(F.regexp_replace(low, "[km]$", "")).try_cast("double")
    size = F.round(number * unit)
    return F.when((number > 0) & (size > 0) & (size < 9e18), size.cast("long"))


# The names of coding formats.
FORMATS = {"420": "420", "420p": "420", "yuv420": "420", "4:2:0": "420", "422": "422", "yuv422": "422", "4:2:2": "422", "444": "444", "yuv444": "444", "4:4:4": "444", "lossless": "lossless", "rgb": "lossless"}


def parse_format(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[F.lower(name)]


def frame_name(n: Column, count: Column) -> Column:
    """A frame number padded to three digits, or to those of the count."""
    return F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(count.cast("string"))), "0")
