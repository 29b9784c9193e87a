"""A Spark data source, `spark.read.format("heif")`: the items of all HEIF files in a folder.

Only the boxes in front of the data are read (see `front`), so large files cost little. Files are found on the driver
and dealt over the tasks; the folder must be one that pyarrow's file systems reach. For stores that only Spark reads
there is `isoframe.sources.heif.read`, over Spark's binaryFile source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import boxes
from .heif import ITEM

SUFFIXES = (".heic", ".heif", ".hif", ".heics", ".heifs")
MOST_FRONT, MOST_BOXES = 64 << 20, 4096


def front(file, size: int) -> bytes:
    """The ftyp and meta boxes of an open file, other boxes skipped."""
    out, at = b"", 0
    for _ in range(MOST_BOXES):
        if at + 8 > size:
            break
        file.seek(at)
        head = file.read(32)
        kind, _, length, to_end, _ = boxes.header(head, 0)
        length = size - at if to_end else length
        if kind in ("ftyp", "meta"):
            if length > MOST_FRONT - len(out) or at + length > size:
                raise boxes.BadFile(f"box {kind!r} of {length} bytes")
            file.seek(at)
            out += file.read(length)
        at += length
        if kind == "meta":
            break
    return out


class Slice(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Slice]:
        store, root = fs.FileSystem.from_uri(self.options["path"])
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(SUFFIXES))
        step = int(self.options.get("filespertask", 64))
        return [Slice(files[k : k + step]) for k in range(0, len(files), step)] or [Slice([])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        for path, size in partition.files:
            rows = []
            try:
                with store.open_input_file(path) as file:
                    rows = [{"path": path, "error": None} | i for i in boxes.read_file(front(file, size))["items"]]
            except (boxes.BadFile, ValueError) as e:
                rows = [{"path": path, "error": str(e)}]
            kinds = pa.schema([("path", pa.string()), ("error", pa.string()), ("ordinal", pa.int32()), ("item_id", pa.int64()), ("item_type", pa.string()), ("name", pa.string()), ("hidden", pa.bool_()), ("content_type", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)


class HeifSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "heif"

    def schema(self) -> str:
        return f"path string, error string, {ITEM}"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HeifSource)
