"""HEIF files as DataFrames.

`read(spark, path)` parses each file once, in one Arrow pass over Spark's binaryFile source, into a row of nested tables;
`Containers` gives them as relational tables, each an explode that Catalyst prunes to the columns used. A file that
can't be parsed gives a row in `errors` and none elsewhere.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cached_property
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import boxes

ITEM = "ordinal int, item_id bigint, item_type string, name string, hidden boolean, content_type string"
EXTENT = "location int, item_id bigint, extent_no int, method string, offset bigint, length bigint, source_index bigint"
REF = "ref_ordinal int, ref_type string, from_id bigint, to_pos int, to_id bigint"
CONFIG = "profile int, level int, chroma int, luma_depth int, chroma_depth int, nal_size int"
PROPERTY = (
    "prop_index int, kind string, width bigint, height bigint, depths array<int>, colour_type string, primaries int, transfer int, matrix int,"
    f" full_range boolean, icc binary, angle int, mirror string, aperture array<bigint>, urn string, subtypes binary, config struct<{', '.join(x.replace(' ', ':') for x in CONFIG.split(', '))}>, raw binary"
)
LINK = "entry int, item_id bigint, assoc_pos int, prop_index int, essential boolean"
TRACK = (
    "track_id bigint, handler string, refs array<string>, timescale bigint, sizes array<bigint>, chunks array<bigint>, stsc array<array<bigint>>,"
    " stts array<array<bigint>>, ctts array<array<bigint>>, stss array<bigint>"
)
#: Key and order of the tables in which the first of a key counts; their nested rows are marked by `first`.
FIRST = {"items": (("item_id",), "ordinal"), "refs": (("from_id", "ref_type"), "ref_ordinal"), "links": (("item_id",), "entry")}
MOST_FILES = 500  # parsed into Python rows at once
NESTED = {"items": ITEM, "extents": EXTENT, "refs": REF, "properties": PROPERTY, "links": LINK, "tracks": TRACK}


def _nested(ddl: str) -> str:
    return StructType.fromDDL(ddl).simpleString()


SCHEMA = (
    "path string, length bigint, content binary, error string, major string, minor bigint, compatible array<string>, primary_id bigint, idat binary, "
)


def schema(spark: SparkSession) -> StructType:
    return StructType.fromDDL(SCHEMA + ", ".join(f"{k} array<{_nested(v + ', first boolean' * (k in FIRST))}>" for k, v in NESTED.items()))


def mark_first(rows: list[dict], keys: tuple[str, ...], order: str) -> None:
    """first: whether a row has the least order of its key (several may have it)."""
    key, least = itemgetter(*keys), {}
    for x in rows:
        k = key(x)
        if least.setdefault(k, x[order]) > x[order]:
            least[k] = x[order]
    for x in rows:
        x["first"] = least[key(x)] == x[order]


def parse(files: DataFrame, keep_content: bool = True) -> DataFrame:
    """files(path, length, content) to one row of nested tables for each file."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = schema(files.sparkSession)
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in (b.slice(at, MOST_FILES) for b in batches for at in range(0, b.num_rows, MOST_FILES)):
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                row = dict.fromkeys(kinds.names) | {"path": path, "length": len(content or b""), "content": content if keep_content else None}
                try:
                    tracks = boxes.read_tracks(content or b"")
                    try:
                        found = boxes.read_file(content or b"")
                    except boxes.BadFile:
                        if not tracks:
                            raise
                        found = {"brands": None, "primary_id": None, "items": [], "extents": [], "refs": [], "properties": [], "links": [], "idat": b""}
                    brands = found.pop("brands") or {"major": None, "minor": None, "compatible": None}
                    for name, by in FIRST.items():
                        mark_first(found[name], *by)
                    row |= found | brands | {"tracks": tracks}
                except (boxes.BadFile, UnicodeDecodeError) as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path", "length", "content").mapInArrow(run, out)


def read(spark: SparkSession, path: str, glob: str | None = None) -> Containers:
    """All files below path; glob names the files to take."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return Containers(parse((reader.option("pathGlobFilter", glob) if glob else reader).load(path)))


class Containers:
    """The relational tables of parsed files; key columns are (path, item_id)."""

    def __init__(self, parsed: DataFrame):
        self.parsed = parsed

    def _table(self, name: str) -> DataFrame:
        rows = self.parsed.where("error is null").select("path", F.explode(name).alias("x")).select("path", "x.*")
        return rows.drop("first") if name in FIRST else rows

    def first_rows(self, name: str) -> DataFrame:
        """The rows of a table of FIRST that come first of their key."""
        rows = self.parsed.where("error is null").select("path", F.explode(name).alias("x")).where("x.first")
        return rows.select("path", "x.*").drop("first")

    @cached_property
    def files(self) -> DataFrame:
        return self.parsed.select("path", "length", "content", "major", "minor", "compatible", "primary_id", "error")

    @cached_property
    def errors(self) -> DataFrame:
        return self.parsed.where("error is not null").select("path", F.lit("container").alias("stage"), F.col("error").alias("message"))

    @cached_property
    def items(self) -> DataFrame:
        return self._table("items")

    @cached_property
    def item_extents(self) -> DataFrame:
        return self._table("extents")

    @cached_property
    def item_refs(self) -> DataFrame:
        return self._table("refs")

    @cached_property
    def properties(self) -> DataFrame:
        return self._table("properties")

    @cached_property
    def item_properties(self) -> DataFrame:
        return self._table("links")

    @cached_property
    def tracks(self) -> DataFrame:
        return self._table("tracks")

    def register(self, prefix: str = "") -> None:
        """Temporary views of all tables."""
        for name in ("files", "errors", "items", "item_extents", "item_refs", "properties", "item_properties", "tracks"):
            getattr(self, name).createOrReplaceTempView(prefix + name)

    def stored(self) -> Containers:
        """Parse once and keep, in a folder of its own below spark.checkpoint.dir (a local one where that isn't set)."""
        root = self.parsed.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="isoframe-")
        return self.write(f"{root.rstrip('/')}/containers-{uuid.uuid4().hex}")

    def write(self, path: str) -> Containers:
        """Parse once and keep: the nested rows as Parquet, read back."""
        self.parsed.write.parquet(path)
        return Containers(self.parsed.sparkSession.read.parquet(path))


def box_rows(files: DataFrame) -> DataFrame:
    """(path, depth, parent_offset, offset, box_type, header_size, size, to_end, user_type) of every box; the scan of a file
    ends at its first broken box."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    for depth, parent, b in boxes.tree(content or b""):
                        rows.append({"path": path, "depth": depth, "parent_offset": parent, "offset": b.offset, "box_type": b.kind, "header_size": b.header,
                                     "size": b.size, "to_end": b.to_end, "user_type": b.uuid})
                except boxes.BadFile:
                    pass
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType.fromDDL("path string, depth int, parent_offset bigint, offset bigint, box_type string, header_size int, size bigint, to_end boolean, user_type binary")
    kinds = to_arrow_schema(out)
    return files.select("path", "content").mapInArrow(run, out)


def file_types(files: DataFrame) -> DataFrame:
    """(path, file_type) from the first bytes alone, as one expression."""
    n, kind, brand = F.length("content"), F.substring("content", 5, 4), F.substring("content", 9, 4)
    text = lambda c: F.decode(c, "ISO-8859-1")
    verdict = (
        F.when(n < 8, "MayBe").when(text(kind) != "ftyp", "No").when(n < 12, "MayBe")
        .when(text(brand).isin(*boxes.HEVC_BRANDS), "Supported").when(text(brand).isin(*boxes.ANY_BRANDS), "MayBe").otherwise("Unsupported")
    )
    return files.select("path", verdict.alias("file_type"))
