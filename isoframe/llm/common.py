"""Helpers shared by the training-data operators: shared folders and Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW_BYTES = 4 << 20

#: Bytes translation that lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only a session without that setting (a local test) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def local_root() -> str:
    return tempfile.mkdtemp(prefix="isoframe-")


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Writes in this block remove their shuffle files when they are done."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    path = shared_dir(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def in_arrow(rows: DataFrame, f, schema) -> DataFrame:
    """rows.mapInArrow(f, schema) with Arrow batches of at most ARROW_BYTES: the JVM and the worker each hold some at a time.

    The session's setting is lowered to that (Spark reads it when the plan runs); a lower one stays.
    """
    spark, name = rows.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))
    return rows.mapInArrow(f, schema)


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def byte_data(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls one after another, and where each text begins (and the last ends)."""
    _, at, data = column.buffers()
    bounds = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def distinct(data: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct strings between bounds of the data, and the place of each string in these."""
    found = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()


def small(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most limit bytes of text (a longer text is a batch of its own)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for k, n in enumerate(lengths.tolist()):
            if k > at and held + n > limit:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += n
        if batch.num_rows > at:
            yield batch.slice(at)


class Kept:
    """Id lists (and numbers) of strings, kept in about limit bytes.

    Beyond that the strings used least since they were added go, half of the limit at least.
    """

    EACH = 400  # bytes that a string takes besides its characters and ids, with its share of free room

    def __init__(self, limit: int, numbers: int = 0):
        self.limit, self.numbers = limit, numbers
        self.place: dict = {}
        self.bytes, self.used = 0, 0
        self.flat = np.zeros(1 << 14, dtype=np.uint32)
        self.start, self.length, self.uses = (np.zeros(1 << 12, dtype=np.int64) for _ in range(3))
        self.values = np.zeros((1 << 12, numbers))

    def add(self, strings: list, lengths: np.ndarray, ids: np.ndarray, values=None) -> None:
        n, new = len(self.place), len(strings)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + new > len(self.start):
            self.start, self.length, self.uses, self.values = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.uses, self.values))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + new] = self.used + offsets(lengths)[:-1]
        self.length[n : n + new], self.uses[n : n + new] = lengths, 0
        if self.numbers:
            self.values[n : n + new] = values
        self.used += len(ids)
        self.bytes += sum(map(len, strings)) + self.EACH * new + 4 * len(ids)
        self.place.update(zip(strings, range(n, n + new), strict=True))

    def places(self, strings: list) -> np.ndarray:
        """The place of each string, -1 if it isn't kept."""
        return np.fromiter(map(self.place.get, strings, repeat(-1)), np.int64, len(strings))

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings one after another, and their ends (the first is 0)."""
        lengths = self.length[places]
        ends = offsets(lengths)
        self.uses[: len(self.place)] += np.bincount(places, minlength=len(self.place))
        return self.flat[np.repeat(self.start[places] - ends[:-1], lengths) + np.arange(ends[-1])], ends

    def trim(self) -> None:
        if self.bytes <= self.limit:
            return
        strings, n = list(self.place), len(self.place)
        size = np.fromiter(map(len, strings), np.int64, n) + self.EACH + 4 * self.length[:n]
        order = np.lexsort((np.arange(n), -self.uses[:n]))
        order = order[: np.searchsorted(np.cumsum(size[order]), self.limit // 2)]
        order = np.sort(order[self.uses[order] > 1])
        old, uses, values = self.ids(order)[0], self.uses[order] // 2, self.values[order]
        lengths = self.length[order]
        self.__init__(self.limit, self.numbers)
        self.add([strings[k] for k in order.tolist()], lengths, old, values)
        self.uses[: len(order)] = uses


def crc_fold(column: str, mod: int):
    """crc32 of an id's decimal text, modulo mod; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def offsets(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words, with wrap-around."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
