"""The container operators on one written file for each row of `part`.

Each row's values go into a file (images, thumbnails, Exif, IPTC, XMP, an auxiliary image, a sequence) by the writer; the
files are parsed, and the views must give the values back, which SQL reads from the table itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hevc
from ..operators import sequences as seq
from ..sources import heif
from ..sources import writer as w
from . import container as ct
from . import samples

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TASK_FILES = 20_000  # files that a task writes and parses, at most about so many
SIZES = "2 + p_size % 7 AS w, 2 + p_partkey % 5 AS h"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def dataset(number: int, text: str) -> bytes:
    raw = text.encode()
    return bytes((0x1C, 2, number)) + len(raw).to_bytes(2, "big") + raw


def file_of(key: int, name: str, brand: str, kind: str, size: int) -> bytes:
    """Item 1 is the primary image, 2 another one, 3 and 4 thumbnails of it; then Exif, XMP and IPTC (5 to 7), maybe alpha (8)."""
    f = w.Writer("mif1")
    image = lambda n, wide, high, *p, **how: f.add_image("unci", bytes(3 * wide * high), wide, high, *samples.UNCOMPRESSED, *p, **how)  # noqa: E731, ARG005
    wide, high = 2 + size % 7, 2 + key % 5
    first = image(1, wide, high, w.nclx(9 if size % 2 else 1, 13, 6, True))
    image(2, 4, 4, hidden=key % 3 != 0)
    for side in (1 + size % 3, 1 + key % 3):
        f.add_thumbnail(first, "unci", bytes(3 * side * side), side, side, *samples.UNCOMPRESSED)
    f.add_exif(first, samples.tiff({0x010F: brand.encode() + b"\0", 0x0110: kind.encode() + b"\0", 0x0112: 1 + size % 8}))
    f.add_xmp(first, f"<x>{name}</x>".encode())
    f.describe(first, "iptc", b"\x1c\x01\x5a\x00\x03\x1b%G" + dataset(120, name) + dataset(90, kind) + dataset(25, brand) + dataset(25, str(size)))
    if size % 2 == 0:
        f.add_alpha(first, "unci", bytes(wide * high), wide, high, w.component_types(0), w.uncompressed([(8, 0)]), w.pixi(8))
    track = w.Track(wide, high, timescale=25, per_chunk=2)
    for n in range(1 + size % 4):
        track.add_sample(bytes(n + 1), 1 + key % 3, n == 0, 0)
    f.set_sequence(track)
    return f.finish()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, length, content): a file for each part."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [file_of(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            paths = [str(k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "length": pa.array(map(len, found), pa.int64()), "content": pa.array(found, pa.binary())})

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    # The rows are small and a row group isn't split: as read, a million files would be written and parsed in one task.
    tasks = max(spark.sparkContext.defaultParallelism, -(-part.count() // TASK_FILES))
    return part.repartition(tasks, "p_partkey").mapInArrow(run, samples.FILES)


def containers(spark: SparkSession, sf_dir: str) -> heif.Containers:
    return heif.Containers(heif.parse(files(spark, sf_dir))).stored()


def keyed(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(F.col("path").cast("long").alias("p_partkey"), *columns)


@query("SELECT p_partkey, p_brand AS make, p_type AS model, 1 + p_size % 8 AS orientation, false AS has_gps FROM part")
def file_exif(spark, sf_dir):
    return keyed(ct.exif_fields(containers(spark, sf_dir)).where("item_id = 1"), "make", "model", "orientation", "has_gps")


@query("SELECT p_partkey, p_name AS caption, p_type AS city, [p_brand, p_size::VARCHAR] AS keywords FROM part")
def file_iptc(spark, sf_dir):
    return keyed(ct.iptc_fields(containers(spark, sf_dir)).where("item_id = 1"), "caption", "city", "keywords")


@query("SELECT p_partkey, '<x>' || p_name || '</x>' AS xmp FROM part")
def file_xmp(spark, sf_dir):
    c = containers(spark, sf_dir)
    data = ct.item_data(c, ("mime",)).withColumnRenamed("item_id", "source_id")
    return keyed(ct.xmp_items(c).where("item_id = 1").join(data, ["path", "source_id"]), F.decode("data", "UTF-8").alias("xmp"))


@query("SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 0 THEN [1, 2] ELSE [1] END)::BIGINT AS item_id FROM part")
def file_top_level(spark, sf_dir):
    return keyed(ct.top_level_images(containers(spark, sf_dir)), "item_id")


@query(f"SELECT p_partkey, w::BIGINT AS width, h::BIGINT AS height FROM (SELECT p_partkey, {SIZES} FROM part)")
def file_sizes(spark, sf_dir):
    return keyed(ct.image_sizes(containers(spark, sf_dir)).where("item_id = 1"), "width", "height")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < p_size % 3 THEN 4 ELSE 3 END::BIGINT AS thumb_id FROM part")
def file_thumbnails(spark, sf_dir):
    return keyed(ct.thumbnails(containers(spark, sf_dir)), "thumb_id")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 9 ELSE 1 END::INTEGER AS primaries, 13 AS transfer FROM part")
def file_colours(spark, sf_dir):
    return keyed(ct.colours(containers(spark, sf_dir)).where("item_id = 1"), F.col("primaries").cast("int").alias("primaries"), F.col("transfer").cast("int").alias("transfer"))


@query(f"SELECT p_partkey, 8::BIGINT AS aux_id, w::BIGINT AS width, h::BIGINT AS height FROM (SELECT p_partkey, p_size, {SIZES} FROM part) WHERE p_size % 2 = 0")
def file_auxiliary(spark, sf_dir):
    rows = ct.auxiliary_images(containers(spark, sf_dir)).where((F.col("item_id") == 1) & ct.is_alpha(F.col("urn")))
    return keyed(rows, "aux_id", "width", "height")


@query("SELECT p_partkey, unnest(CASE WHEN p_size % 2 = 0 THEN [1, 5, 6, 7, 8] ELSE [1, 5, 6, 7] END)::BIGINT AS item_id FROM part")
def file_wanted(spark, sf_dir):
    c = containers(spark, sf_dir)
    return keyed(ct.wanted_items(c, ct.primary_items(c).select("path", "item_id")), "item_id")


@query(f"SELECT p_partkey, w = 4 AND h = 4 AS shared FROM (SELECT p_partkey, {SIZES} FROM part)")
def file_property_sharing(spark, sf_dir):
    c = containers(spark, sf_dir)
    rows = ct.linked_properties(c).where("kind = 'ispe' and item_id in (1, 2)").groupBy("path").agg(F.count_distinct("prop_index").alias("n"))
    return keyed(rows, (F.col("n") == 1).alias("shared"))


@query("""SELECT p_partkey, n AS frame_no, (1 + p_partkey % 3)::DOUBLE / 25 AS duration, n = 0 AS keyframe
FROM (SELECT p_partkey, unnest(range(1 + p_size % 4)) AS n FROM part)""")
def file_frames(spark, sf_dir):
    return keyed(seq.frames(containers(spark, sf_dir).tracks), F.col("frame_no").cast("long").alias("frame_no"), "duration", "keyframe")


@query("SELECT p_partkey, ((1 + p_size % 4) * (1 + p_partkey % 3))::DOUBLE / 25 AS seconds FROM part")
def file_track_seconds(spark, sf_dir):
    return keyed(seq.track_durations(containers(spark, sf_dir).tracks), "seconds")


@query("""SELECT p_partkey, n, 1 + n AS size, md5(repeat('00', (1 + n)::INTEGER)) AS data FROM (SELECT p_partkey, unnest(range(1 + p_size % 4)) AS n FROM part)""")
def file_sample_bytes(spark, sf_dir):
    c = containers(spark, sf_dir)
    rows = seq.sample_bytes(seq.samples(c.tracks), c.parsed.select("path", "content"))
    return keyed(rows, F.col("n").cast("long").alias("n"), F.col("size").cast("long").alias("size"), F.md5(F.hex("data")).alias("data"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Supported' WHEN 1 THEN 'MayBe' WHEN 2 THEN 'Unsupported' ELSE 'No' END AS file_type FROM part""")
def file_kinds(spark, sf_dir):
    """The probe of the first bytes, on files of four kinds."""
    k = F.col("p_size") % 4
    start = F.when(k == 0, "ftypheic").when(k == 1, "ftypmif1").when(k == 2, "ftypavif").otherwise("JFIF\0\1\2\3")
    content = F.concat(F.lit("\0\0\0\x18"), start, F.col("p_name")).cast("binary")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"))
    return keyed(heif.file_types(rows), "file_type")


@query("""SELECT vec_id, md5(unhex(string_agg(printf('%02x', v), '' ORDER BY k))) AS md5 FROM
(SELECT vec_id, k, (floor(abs(e::DOUBLE) * 1000)::BIGINT % 256)::INTEGER AS v FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)) GROUP BY vec_id""")
def picture_md5(spark, sf_dir):
    """The picture hash of embeddings as 8x8 planes."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = []
            for e in batch.column("embedding").to_pylist():
                plane = (np.floor(np.abs(np.array(e, dtype=np.float64)) * 1000).astype(np.int64) % 256).reshape(-1, 8)
                found.append(hevc.plane_md5(plane, 8).hex())
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "md5": pa.array(found, pa.string())})

    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, md5 string")
