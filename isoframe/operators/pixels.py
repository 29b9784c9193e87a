"""Geometry and blending over pixel tables (key, x, y, samples): coordinate projections, filters and integer arithmetic.

One row for a pixel lets Catalyst fuse a chain of transforms into one projection. Whole pictures are kept as bytes
(`isoframe.operators.images`); pixel tables are for tiles, thumbnails and checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(df: DataFrame, key: str, samples: str, width: int, value: Column | None = None) -> DataFrame:
    """(key, x, y, v) of rows that hold a picture of the given width as an array."""
    rows = df.select(key, F.posexplode(samples).alias("pos", "raw"))
    v = F.col("raw") if value is None else value
    return rows.select(key, (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).cast("int").alias("y"), v.alias("v"))


def rotate(pixels: DataFrame, quarters: int, width: int, height: int) -> DataFrame:
    """Anti-clockwise by quarters of a turn."""
    x, y = F.col("x"), F.col("y")
    to = {0: (x, y), 1: (y, width - 1 - x), 2: (width - 1 - x, height - 1 - y), 3: (height - 1 - y, x)}[quarters % 4]
    return pixels.withColumns({"x": to[0], "y": to[1]})


def mirror(pixels: DataFrame, top_bottom: bool, width: int, height: int) -> DataFrame:
    return pixels.withColumn("y", height - 1 - F.col("y")) if top_bottom else pixels.withColumn("x", width - 1 - F.col("x"))


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The part of the rectangle that lies in the picture, its corner at (0, 0)."""
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return pixels.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def place_tile(pixels: DataFrame, tile: str, columns: int, tile_width: int, tile_height: int, width: int, height: int) -> DataFrame:
    """Tiles, numbered row by row, on the canvas of a grid; what lies beyond the canvas is cut."""
    x = F.col("x") + F.col(tile) % columns * tile_width
    y = F.col("y") + F.floor(F.col(tile) / columns).cast("int") * tile_height
    return pixels.withColumns({"x": x, "y": y}).where((F.col("x") < width) & (F.col("y") < height))


def blend(front: Column, back: Column, alpha: Column, most: int = 255) -> Column:
    """front over back, rounded."""
    return F.floor((front * alpha + back * (most - alpha) + most // 2) / most).cast("int")


def overlay(back: DataFrame, front: DataFrame, key: str, dx: int, dy: int) -> DataFrame:
    """back(key, x, y, v) with front(key, x, y, v, a) drawn at (dx, dy)."""
    moved = front.select(key, (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col("v").alias("fv"), F.col("a").alias("fa"))
    rows = back.join(moved, [key, "x", "y"], "left")
    return rows.select(key, "x", "y", F.when(F.col("fa").isNull(), F.col("v")).otherwise(blend(F.col("fv"), F.col("v"), F.col("fa"))).alias("v"))


def box_average(pixels: DataFrame, key: str, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Rounded integer means over the spans of a smaller picture (spans that don't overlap: sizes that divide)."""
    cell = lambda c, n, t: F.floor(F.col(c) * t / n).cast("int")
    n = F.count("*")
    return pixels.groupBy(key, cell("x", width, to_width).alias("ox"), cell("y", height, to_height).alias("oy")).agg(F.floor((F.sum("v") + F.floor(n / 2)) / n).cast("int").alias("v"))


def log_gain(pixels: DataFrame, key: str, base: str, bright: str, headroom: float) -> DataFrame:
    """2x2 means of log2(bright / base) between 0 and the headroom, as bytes."""
    ratio = F.when(F.col(base) > 0, F.col(bright) / F.col(base)).when(F.col(bright) > 0, F.lit(2.0**headroom)).otherwise(1.0)
    stops = F.least(F.log2(F.greatest(ratio, F.lit(1.0))), F.lit(headroom))
    cell = lambda c: F.floor(F.col(c) / 2).cast("int")
    return pixels.groupBy(key, cell("x").alias("mx"), cell("y").alias("my")).agg(F.round(F.avg(stops) / headroom * 255).cast("int").alias("gain"))


def plane_checksum(pixels: DataFrame, key: str) -> DataFrame:
    """The picture checksum of 8-bit samples: each byte under a mask of its place, summed modulo 2**32."""
    x, y = F.col("x"), F.col("y")
    mask = x.bitwiseXOR(y).bitwiseXOR(F.shiftright(x, 8)).bitwiseXOR(F.shiftright(y, 8)).bitwiseAND(255)
    return pixels.groupBy(key).agg((F.sum(F.col("v").bitwiseAND(255).bitwiseXOR(mask).cast("long")) % (1 << 32)).alias("checksum"))


def hadamard_cost(pixels: DataFrame, key: str, size: int = 4) -> DataFrame:
    """Sums of absolute 4x4 Hadamard coefficients of each picture's blocks, halved: conditional sums instead of a matrix join."""
    px, py = F.col("x") % size, F.col("y") % size
    block = [key, F.floor(F.col("x") / size).cast("int").alias("bx"), F.floor(F.col("y") / size).cast("int").alias("by_")]
    sums = []
    for u in range(size):
        for v in range(size):
            parity = F.bit_count(px.bitwiseAND(u)) + F.bit_count(py.bitwiseAND(v))
            sums.append(F.abs(F.sum(F.when(parity % 2 == 0, F.col("v")).otherwise(-F.col("v")))).alias(f"h{u}{v}"))
    rows = pixels.groupBy(*block).agg(*sums)
    total = sum((F.col(f"h{u}{v}") for u in range(size) for v in range(size)), F.lit(0))
    return rows.groupBy(key).agg(F.sum(F.floor(total / 2)).alias("satd"))


def smooth_rows(pixels: DataFrame, key: str) -> DataFrame:
    """[1 2 1] / 4 along rows, rounded, edges repeated."""
    w = Window.partitionBy(key, "y").orderBy("x")
    v = F.col("v")
    before, after = F.coalesce(F.lag(v).over(w), v), F.coalesce(F.lead(v).over(w), v)
    return pixels.withColumn("v", F.floor((before + 2 * v + after + 2) / 4).cast("int"))


def squared_error(pixels: DataFrame, key: str, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return pixels.groupBy(key).agg(F.sum(d * d).alias("sse"))


def psnr(mse: Column, peak: float = 255.0) -> Column:
    return F.when(mse == 0, F.lit(99.0)).otherwise(10 * F.log10(F.lit(peak * peak) / mse))


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted values."""
    return F.array_sort(values)[F.floor(F.size(values) / 2).cast("int")]


def uniform_spacing(i: Column, n: Column, total: Column) -> Column:
    """The size of part i of n parts of total."""
    return (F.floor((i + 1) * total / n) - F.floor(i * total / n)).cast("int")
