"""Streams: a folder of new files, and pictures put out in display order as their decoding order allows.

`new_files` reads a folder as it fills; the container tables above it are the same as in a batch. `bumped` is the output
process of a decoder: a picture waits in state until more pictures wait than the stream reorders, or one has waited
too long; the flush mark of a track puts out the rest. State is one list for each track, bounded by the buffer size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, folder: str, glob: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """Files of a folder as a stream, at most files_per_trigger at a time."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def step(waiting: list[tuple[int, int, int]], poc: int, n: int, clears: bool, most_reorder: int, most_latency: int | None) -> list[tuple[int, int]]:
    """Take picture n with order count poc; returns the (n, poc) put out. waiting: (poc, n, pictures since), changed in place."""
    out = []
    if clears:
        out += [(k, p) for p, k, _ in sorted(waiting)]
        waiting.clear()
    waiting[:] = [(p, k, since + 1) for p, k, since in waiting]
    waiting.append((poc, n, 0))
    while len(waiting) > most_reorder or (most_latency is not None and any(s >= most_latency for _, _, s in waiting)):
        waiting.sort()
        p, k, _ = waiting.pop(0)
        out.append((k, p))
    return out


def bumped(pictures: DataFrame, key: str = "track_id", most_reorder: int = 2, most_latency: int | None = None) -> DataFrame:
    """(key, n, poc, shown) of pictures(key, n, poc, clears, last): in the order of display. last flushes the track."""
    kind = dict(pictures.dtypes)[key]

    def run(keys, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shown, *flat = state.get if state.exists else (0, [])
        waiting = [tuple(flat[0][k : k + 3]) for k in range(0, len(flat[0]), 3)]
        rows = []
        for frame in frames:
            for r in frame.sort_values("n").itertuples():
                rows += step(waiting, int(r.poc), int(r.n), bool(r.clears), most_reorder, most_latency)
                if r.last:
                    rows += [(k, p) for p, k, _ in sorted(waiting)]
                    waiting = []
        state.update((shown + len(rows), [int(v) for w in waiting for v in w]))
        yield pd.DataFrame({key: [keys[0]] * len(rows), "n": [k for k, _ in rows], "poc": [p for _, p in rows], "shown": range(shown, shown + len(rows))})

    rows = pictures.select(key, "n", "poc", F.col("clears").cast("boolean"), F.col("last").cast("boolean"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, n bigint, poc bigint, shown bigint", "shown bigint, waiting array<bigint>", "append", GroupStateTimeout.NoTimeout)
