"""Image sequences: run expansion of sample tables, display order, durations, groups of pictures, keyframe lookup.

All are windows or explodes keyed by (path, track_id); a track's samples are one window partition, as the format bounds
them (boxes.read_tracks refuses more than 2**24).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["path", "track_id"]


def samples(tracks: DataFrame) -> DataFrame:
    """(path, track_id, n, offset, size, duration, sync, composition_offset) in decoding order.

    A chunk's samples are counted by the last stsc run that starts at or before it. Time runs longer than the track are
    cut, shorter ones leave duration 0; without stss every sample is a sync sample.
    """
    sized = tracks.select(*KEY, F.posexplode("sizes").alias("n", "size"))
    chunk = tracks.select(*KEY, "stsc", F.posexplode("chunks").alias("chunk", "chunk_offset"))
    per = F.aggregate("stsc", F.lit(0).cast("long"), lambda a, r: F.when(r[0] <= F.col("chunk") + 1, r[1]).otherwise(a))
    w = Window.partitionBy(*KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk = chunk.withColumn("per", per).withColumn("first", F.coalesce(F.sum("per").over(w), F.lit(0)))
    placed = chunk.where("per > 0").select(*KEY, "chunk", "chunk_offset", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("per") - 1)).alias("k", "n"))
    rows = sized.join(placed.withColumn("n", F.col("n").cast("int")), [*KEY, "n"])
    before = Window.partitionBy(*KEY, "chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.col("chunk_offset") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    rows = rows.join(expanded(tracks, "stts", "duration"), [*KEY, "n"], "left").join(expanded(tracks, "ctts", "composition_offset"), [*KEY, "n"], "left")
    rows = rows.join(tracks.select(*KEY, "stss"), KEY)
    sync = F.coalesce(F.array_contains("stss", (F.col("n") + 1).cast("long")), F.lit(True))
    return rows.select(*KEY, "n", "offset", "size", F.coalesce("duration", F.lit(0)).alias("duration"), sync.alias("sync"), F.coalesce("composition_offset", F.lit(0)).alias("composition_offset"))


def expanded(tracks: DataFrame, runs: str, value: str) -> DataFrame:
    """(path, track_id, n, value) of runs [count, value]; runs past the track's samples are cut."""
    rows = tracks.select(*KEY, F.size("sizes").alias("most"), F.posexplode(runs).alias("run", "r"))
    w = Window.partitionBy(*KEY).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum(F.col("r")[0]).over(w), F.lit(0)))
    last = F.least(F.col("first") + F.col("r")[0], F.col("most")) - 1
    rows = rows.where((F.col("r")[0] > 0) & (F.col("first") < F.col("most")))
    return rows.select(*KEY, F.explode(F.sequence("first", last)).alias("n"), F.col("r")[1].alias(value)).withColumn("n", F.col("n").cast("int"))


def composition(rows: DataFrame, key: list[str], order: list[str], duration: str = "duration", offset: str | None = "composition_offset") -> DataFrame:
    """rows with t: the sum of the durations before a sample, plus its offset."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = F.coalesce(F.sum(duration).over(before), F.lit(0))
    return rows.withColumn("t", t + F.col(offset) if offset else t)


def display(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows with frame_no and ticks: rank by time (ties in decoding order), and the time to the next frame shown; the
    last frame keeps its own duration."""
    w = Window.partitionBy(*key).orderBy("t", *order)
    return rows.withColumn("frame_no", F.row_number().over(w) - 1).withColumn("ticks", F.coalesce(F.lead("t").over(w) - F.col("t"), F.col("duration")))


def frames(tracks: DataFrame) -> DataFrame:
    """(path, track_id, frame_no, n, duration in seconds, keyframe) in display order."""
    shown = display(composition(samples(tracks), KEY, ["n"]), KEY, ["n"]).join(tracks.select(*KEY, "timescale"), KEY)
    seconds = F.when(F.col("timescale") > 0, F.col("ticks").cast("double") / F.col("timescale")).otherwise(F.lit(0.0))
    return shown.select(*KEY, "frame_no", "n", seconds.alias("duration"), F.col("sync").alias("keyframe"))


def track_durations(tracks: DataFrame) -> DataFrame:
    """(path, track_id, seconds): the sum of all sample durations over the timescale, 0 for timescale 0."""
    total = samples(tracks).groupBy(*KEY).agg(F.sum("duration").alias("d"))
    return total.join(tracks.select(*KEY, "timescale"), KEY).select(*KEY, F.when(F.col("timescale") > 0, F.col("d").cast("double") / F.col("timescale")).otherwise(F.lit(0.0)).alias("seconds"))


def main_tracks(tracks: DataFrame) -> DataFrame:
    """The first pict or vide track of each file that is no thumbnail or auxiliary."""
    rows = tracks.where(F.col("handler").isin("pict", "vide") & ~F.array_contains("refs", "thmb") & ~F.array_contains("refs", "auxl"))
    first = rows.groupBy("path").agg(F.min("track_id").alias("track_id"))
    return rows.join(first, KEY, "left_semi")


def picture_groups(rows: DataFrame, key: list[str], order: list[str], sync: str = "sync", leading: str | None = None) -> DataFrame:
    """(key, gop, first_n, past_n): groups from one sync sample to the next.

    A sequence that doesn't start with one, or that has a leading picture that is skipped (leading), isn't split: none.
    """
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    gop = F.sum(F.col(sync).cast("int")).over(Window.partitionBy(*key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    numbered = numbered.withColumn("gop", gop)
    whole = numbered.groupBy(*key).agg(F.min("gop").alias("low"), (F.max(F.col(leading).cast("int")) if leading else F.lit(0)).alias("led"))
    split = whole.where("low > 0 and led = 0").select(*key)
    return numbered.join(split, key).groupBy(*key, "gop").agg(F.min("n").alias("first_n"), (F.max("n") + 1).alias("past_n"))


def keyframe_before(rows: DataFrame, key: list[str], order: list[str], sync: str = "sync") -> DataFrame:
    """rows with n and from_n: the last sync sample at or before each sample (null if there is none)."""
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    w = Window.partitionBy(*key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("from_n", F.max(F.when(F.col(sync), F.col("n"))).over(w))


def sample_bytes(rows: DataFrame, files: DataFrame) -> DataFrame:
    """samples with their bytes; a sample outside its file has none."""
    inside = (F.col("offset") + F.col("size") <= F.length("content")) & (F.col("offset") >= 0)
    data = F.when(inside, F.col("content").substr((F.col("offset") + 1).cast("int"), F.col("size").cast("int")))
    return rows.join(files.select("path", "content"), "path").withColumn("data", data).drop("content")


def sample_runs(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """(key, run, count, value): equal neighbours as runs, for the sample tables of a writer."""
    w = Window.partitionBy(*key).orderBy(order)
    new = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    rows = rows.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "run").agg(F.count("*").alias("count"), F.first(value).alias(value))
