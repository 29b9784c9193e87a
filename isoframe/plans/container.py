"""Relational views over container tables: item resolution, references, fallbacks and derived lookups.

The format's rule is that the first match in file order wins; a plain join would multiply rows. Within one table the parser
marks what comes first (`Containers.first_rows`), so nothing is shuffled for it; what is found by joins takes the least
ordinal of its key (`first_by`), an aggregate that Spark combines before its shuffle.
All joins are on (path, ...): tables of one file are small, those of all files are partitioned by path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import metadata
from ..sources.heif import Containers

# Item types that are images, and the two names each of alpha and depth auxiliaries.
IMAGE_TYPES = ("hvc1", "hev1", "avc1", "av01", "jpeg", "unci", "grid", "iovl", "iden")
ALPHA_URNS = ("urn:mpeg:hevc:2015:auxid:1", "urn:mpeg:mpegB:cicp:systems:auxiliary:alpha")
DEPTH_URNS = ("urn:mpeg:hevc:2015:auxid:2", "urn:mpeg:mpegB:cicp:systems:auxiliary:depth")
APPLE_GAIN_URN, GAIN_SUFFIX = "urn:com:apple:photo:2020:aux:hdrgainmap", ":aux:hdrgainmap"
MOST_HOPS = 4


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes first in order."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return picked.select(*keys, "x.*")


def is_image(kind: Column) -> Column:
    return kind.isin(*IMAGE_TYPES)


def is_alpha(urn: Column) -> Column:
    return urn.isin(*ALPHA_URNS)


def is_depth(urn: Column) -> Column:
    return urn.isin(*DEPTH_URNS)


def is_gain_map(urn: Column) -> Column:
    return (urn == APPLE_GAIN_URN) | urn.endswith(GAIN_SUFFIX)


def unique_items(c: Containers) -> DataFrame:
    return c.first_rows("items")


def primary_items(c: Containers) -> DataFrame:
    ids = c.files.where("error is null").select("path", F.col("primary_id").alias("item_id"))
    return unique_items(c).join(ids, ["path", "item_id"])


def linked_properties(c: Containers) -> DataFrame:
    """Properties of each item in association order; only the first association entry of an item counts."""
    links = c.parsed.where("error is null").select("path", "properties", F.explode("links").alias("x")).where("x.first and x.prop_index > 0")
    # properties are in order of their index, from 1
    own = links.select("path", "x.item_id", "x.assoc_pos", "x.essential", F.get("properties", F.col("x.prop_index") - 1).alias("p"))
    return own.where("p is not null").select("path", "item_id", "assoc_pos", "essential", "p.*")


def first_property(c: Containers, kind: str, *columns: str) -> DataFrame:
    rows = linked_properties(c).where(F.col("kind") == kind).select("path", "item_id", "assoc_pos", *columns)
    return first_by(rows, ["path", "item_id"], ["assoc_pos"]).drop("assoc_pos")


def image_sizes(c: Containers) -> DataFrame:
    return first_property(c, "ispe", "width", "height")


def references(c: Containers) -> DataFrame:
    """Targets of the first reference of each (from, type), in order."""
    return c.first_rows("refs")


def referencing(c: Containers, kind: str) -> DataFrame:
    """(path, item_id, from_id, ref_ordinal): who refers to an item, each reference once."""
    rows = c.item_refs.where(F.col("ref_type") == kind)
    return rows.select("path", F.col("to_id").alias("item_id"), "from_id", "ref_ordinal").distinct()


def first_inputs(c: Containers) -> DataFrame:
    """(path, item_id, input_id): the first input of each derived image."""
    rows = references(c).where("ref_type = 'dimg' and to_pos = 0")
    return rows.select("path", F.col("from_id").alias("item_id"), F.col("to_id").alias("input_id"))


def with_fallback(c: Containers, found: DataFrame) -> DataFrame:
    """found(path, item_id, ...): own rows of an item, else those of its first input (one hop)."""
    owners = found.select("path", "item_id").distinct()
    bare = first_inputs(c).join(owners, ["path", "item_id"], "left_anti")
    borrowed = bare.join(found.withColumnRenamed("item_id", "input_id"), ["path", "input_id"]).drop("input_id")
    return found.unionByName(borrowed.select(found.columns))


def auxiliary_items(c: Containers) -> DataFrame:
    return with_fallback(c, referencing(c, "auxl").withColumnRenamed("from_id", "aux_id"))


def auxiliary_images(c: Containers) -> DataFrame:
    """(path, item_id, aux_id, item_type, urn, width, height, bit_depth): items without auxC are none; no size is 0, no depth 8."""
    urns = first_property(c, "auxC", "urn").withColumnRenamed("item_id", "aux_id")
    about = unique_items(c).select("path", F.col("item_id").alias("aux_id"), "item_type")
    size = image_sizes(c).withColumnRenamed("item_id", "aux_id")
    depth = bit_depths(c).withColumnRenamed("item_id", "aux_id")
    rows = auxiliary_items(c).join(urns, ["path", "aux_id"]).join(about, ["path", "aux_id"]).join(size, ["path", "aux_id"], "left").join(depth, ["path", "aux_id"], "left")
    zero = F.lit(0).cast("long")
    return rows.select("path", "item_id", "aux_id", "item_type", "urn", F.coalesce("width", zero).alias("width"), F.coalesce("height", zero).alias("height"), F.coalesce("bit_depth", F.lit(8)).alias("bit_depth"))


def has_alpha(c: Containers) -> DataFrame:
    urns = linked_properties(c).where("kind = 'auxC'").select("path", "item_id", "urn")
    return urns.groupBy("path", "item_id").agg(F.bool_or(is_alpha(F.col("urn"))).alias("is_alpha"))


def auxiliary_subtypes(c: Containers) -> DataFrame:
    return first_property(c, "auxC", "subtypes")


def top_level_images(c: Containers) -> DataFrame:
    """(path, item_id, ordinal): visible images that are no input, thumbnail or auxiliary; the primary item always is."""
    targets = c.item_refs.where("ref_type = 'dimg'").select("path", F.col("to_id").alias("item_id"))
    sources = c.item_refs.where("ref_type in ('thmb', 'auxl')").select("path", F.col("from_id").alias("item_id"))
    seen = unique_items(c).where(~F.col("hidden") & is_image(F.col("item_type")))
    top = seen.join(targets, ["path", "item_id"], "left_anti").join(sources, ["path", "item_id"], "left_anti").select("path", "item_id", "ordinal")
    primary = primary_items(c).select("path", "item_id").join(top, ["path", "item_id"], "left_anti").select("path", "item_id", F.lit(-1).alias("ordinal"))
    return top.unionByName(primary)


def plain_coded_images(c: Containers) -> DataFrame:
    """hvc1 items without auxiliaries and without geometry."""
    changed = linked_properties(c).where("kind in ('clap', 'irot', 'imir')").select("path", "item_id")
    aux = referencing(c, "auxl").select("path", "item_id")
    return unique_items(c).where("item_type = 'hvc1'").select("path", "item_id").join(changed, ["path", "item_id"], "left_anti").join(aux, ["path", "item_id"], "left_anti")


def described(c: Containers, accept: Column) -> DataFrame:
    """(path, item_id, source_id, ordinal): descriptions of an item that pass, else of its first input."""
    rows = referencing(c, "cdsc").withColumnRenamed("from_id", "source_id")
    about = unique_items(c).where(accept).select("path", F.col("item_id").alias("source_id"), "ordinal")
    return with_fallback(c, rows.join(about, ["path", "source_id"]).drop("ref_ordinal"))


def xmp_items(c: Containers) -> DataFrame:
    found = described(c, (F.col("item_type") == "mime") & (F.col("content_type") == "application/rdf+xml"))
    return first_by(found, ["path", "item_id"], ["ordinal"])


def exif_items(c: Containers) -> DataFrame:
    return described(c, F.col("item_type") == "Exif")


def iptc_items(c: Containers) -> DataFrame:
    found = described(c, (F.col("item_type") == "iptc") | ((F.col("item_type") == "mime") & (F.col("content_type") == "application/x-iptc")))
    return first_by(found, ["path", "item_id"], ["ordinal"])


def region_items(c: Containers) -> DataFrame:
    """Region items that describe an item itself; there is no fallback."""
    about = unique_items(c).where("item_type = 'rgan'").select("path", F.col("item_id").alias("source_id"), "ordinal")
    return referencing(c, "cdsc").withColumnRenamed("from_id", "source_id").join(about, ["path", "source_id"]).drop("ref_ordinal")


def along_inputs(c: Containers, own: DataFrame, value: str, hops: int = MOST_HOPS) -> DataFrame:
    """value of each item, else of the first input along its chain, at most hops away. Hops are joins of (path, item_id)."""
    reach = unique_items(c).select("path", "item_id", F.col("item_id").alias("at"), F.lit(0).alias("hop"))
    inputs, rows = first_inputs(c).select("path", F.col("item_id").alias("at"), "input_id"), reach
    for k in range(1, hops + 1):
        reach = reach.join(inputs, ["path", "at"]).select("path", "item_id", F.col("input_id").alias("at"), F.lit(k).alias("hop"))
        rows = rows.unionByName(reach)
    found = rows.join(own.withColumnRenamed("item_id", "at"), ["path", "at"]).where(F.col(value).isNotNull())
    return first_by(found.select("path", "item_id", "hop", value), ["path", "item_id"], ["hop"]).select("path", "item_id", value)


def bit_depths(c: Containers) -> DataFrame:
    """pixi, else the coding configuration, else the first input's."""
    rows = linked_properties(c)
    by = {"pixi": F.array_max("depths"), "hvcC": F.greatest("config.luma_depth", "config.chroma_depth")}
    parts = [rows.where(F.col("kind") == k).select("path", "item_id", F.lit(n).alias("rank"), "assoc_pos", e.cast("int").alias("bit_depth")) for n, (k, e) in enumerate(by.items())]
    own = first_by(parts[0].unionByName(parts[1]).where("bit_depth is not null"), ["path", "item_id"], ["rank", "assoc_pos"])
    return along_inputs(c, own.select("path", "item_id", "bit_depth"), "bit_depth")


def colours(c: Containers) -> DataFrame:
    """(primaries, transfer) of the item's nclx, else of the first input's."""
    rows = linked_properties(c).where("kind = 'colr' and colour_type = 'nclx'")
    own = first_by(rows.select("path", "item_id", "assoc_pos", F.struct("primaries", "transfer", "matrix", "full_range").alias("nclx")), ["path", "item_id"], ["assoc_pos"])
    return along_inputs(c, own.select("path", "item_id", "nclx"), "nclx").select("path", "item_id", "nclx.*")


def icc_profiles(c: Containers, hops: int = 8) -> DataFrame:
    rows = linked_properties(c).where("kind = 'colr' and icc is not null and length(icc) > 0").select("path", "item_id", "assoc_pos", "icc")
    return along_inputs(c, first_by(rows, ["path", "item_id"], ["assoc_pos"]).drop("assoc_pos"), "icc", hops)


def thumbnails(c: Containers) -> DataFrame:
    """(path, item_id, thumb_id): the smallest thumbnail by area; without a size last; ties to the first."""
    rows = referencing(c, "thmb").withColumnRenamed("from_id", "thumb_id")
    size = image_sizes(c).withColumnRenamed("item_id", "thumb_id")
    area = F.coalesce(F.col("width") * F.col("height"), F.lit((1 << 63) - 1))
    return first_by(rows.join(size, ["path", "thumb_id"], "left").withColumn("area", area), ["path", "item_id"], ["area", "ref_ordinal"]).select("path", "item_id", "thumb_id")


def tone_maps(c: Containers) -> DataFrame:
    """(path, item_id, base_id, map_id): a tmap of two inputs, that of the primary image before others."""
    inputs = references(c).where("ref_type = 'dimg'").groupBy("path", "from_id").agg(F.count("*").alias("n"), F.min_by("to_id", "to_pos").alias("base_id"), F.max_by("to_id", "to_pos").alias("map_id"))
    rows = unique_items(c).where("item_type = 'tmap'").join(inputs.where("n = 2").withColumnRenamed("from_id", "item_id"), ["path", "item_id"])
    rows = rows.join(c.files.select("path", "primary_id"), "path").withColumn("other", F.col("base_id") != F.col("primary_id"))
    return first_by(rows.select("path", "item_id", "base_id", "map_id", "other", "ordinal"), ["path"], ["other", "ordinal"]).select("path", "item_id", "base_id", "map_id")


def wanted_items(c: Containers, roots: DataFrame) -> DataFrame:
    """(path, item_id): what decoding roots(path, item_id) needs: inputs, auxiliaries, sources of constructed items, and descriptions.

    Chains may have any length and may run in circles. The references of a file, bounded by the file, meet in one row.
    """
    dimg = references(c).where("ref_type = 'dimg'").select("path", F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    aux = referencing(c, "auxl").select("path", F.col("item_id").alias("a"), F.col("from_id").alias("b"))
    built = references(c).where("ref_type = 'iloc'").select("path", F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    edges = dimg.unionByName(aux).unionByName(built).groupBy("path").agg(F.collect_set(F.struct("a", "b")).alias("edges"))
    asked = roots.groupBy("path").agg(F.collect_set("item_id").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            paths, ids = [], []
            for row in batch.to_pylist():
                follow: dict[int, list[int]] = {}
                for e in row["edges"] or []:
                    follow.setdefault(e["a"], []).append(e["b"])
                found, front = set(row["ids"]), list(row["ids"])
                while front:
                    new = set(follow.get(front.pop(), [])) - found
                    found |= new
                    front += new
                paths += [row["path"]] * len(found)
                ids += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(ids, pa.int64())], names=["path", "item_id"])

    found = asked.join(edges, "path", "left").select("path", "ids", "edges").mapInArrow(run, "path string, item_id bigint")
    notes = referencing(c, "cdsc").join(found, ["path", "item_id"]).select("path", F.col("from_id").alias("item_id"))
    return found.unionByName(notes).distinct()


def item_data(c: Containers, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(path, item_id, data): extents in file order, from the file or its idat; items made of other items have no row here.

    Only the first location of an item counts; length 0 runs to the end; an extent out of range makes the whole null. A file's
    extents lie beside its bytes, so nothing is joined. kinds: only the ids that some item of these types has.
    """
    place = F.transform("extents", lambda x: F.struct(*(x[k].alias(k) for k in ("location", "item_id", "method", "offset", "length"))))
    asked = F.transform(F.filter("items", lambda x: x["item_type"].isin(*kinds)), lambda x: x["item_id"]) if kinds else F.lit(None).cast("array<bigint>")
    rows = c.parsed.where("error is null").select("path", asked.alias("asked"), place.alias("places"), "idat", "content")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            paths, ids, data = [], [], []
            for path, asked, places, idat, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                asked = None if asked is None else set(asked)
                first: dict[int, int] = {}
                pieces: dict[int, list[bytes | None]] = {}
                for x in places or []:
                    n = x["item_id"]
                    if (asked is not None and n not in asked) or first.setdefault(n, x["location"]) != x["location"] or x["method"] == "item":
                        continue
                    pieces.setdefault(n, []).append(extent(idat if x["method"] == "idat" else content, x["offset"], x["length"]))
                paths += [path] * len(pieces)
                ids += pieces
                data += [None if None in p else b"".join(p) for p in pieces.values()]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["path", "item_id", "data"])

    return (rows.where(F.size("asked") > 0) if kinds else rows).mapInArrow(run, "path string, item_id bigint, data binary")


def extent(source: bytes | None, offset: int, length: int) -> bytes | None:
    if source is None:
        return None
    n = length or len(source) - offset
    return source[offset : offset + n] if 0 <= offset <= len(source) and 0 <= n <= len(source) - offset else None


def fields_of(c: Containers, found: DataFrame, kinds: tuple[str, ...], read, ddl: str) -> DataFrame:
    """(path, item_id, and what read makes of the bytes) of the first described item, of one of these types, of each image."""
    data = item_data(c, kinds).withColumnRenamed("item_id", "source_id")
    rows = first_by(found, ["path", "item_id"], ["ordinal"]).join(data, ["path", "source_id"]).select("path", "item_id", "data")
    kinds = to_arrow_schema(T.StructType.fromDDL(ddl))
    names = kinds.names

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values = [read(d or b"") for d in batch.column("data").to_pylist()]
            columns = [pa.array([v.get(n) for v in values], kinds.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("item_id"), *columns], names=["path", "item_id", *names])

    return rows.mapInArrow(run, f"path string, item_id bigint, {ddl}")


def exif_fields(c: Containers) -> DataFrame:
    return fields_of(c, exif_items(c), ("Exif",), metadata.exif, "make string, model string, software string, date_time string, orientation int, has_gps boolean")


def iptc_fields(c: Containers) -> DataFrame:
    """A broken block has only null fields."""

    def read(data: bytes) -> dict:
        try:
            return metadata.iptc_view(data)
        except ValueError:
            return {}

    ddl = ", ".join(f"{k} string" for k in metadata.IPTC_FIELDS) + ", keywords array<string>"
    return fields_of(c, iptc_items(c), ("iptc", "mime"), read, ddl)


def report(c: Containers) -> DataFrame:
    """One line of text for each top-level image."""
    size, depth, aux = image_sizes(c), bit_depths(c), auxiliary_images(c).groupBy("path", "item_id").agg(F.count("*").alias("n_aux"))
    rows = top_level_images(c).join(unique_items(c).select("path", "item_id", "item_type", "name"), ["path", "item_id"])
    rows = rows.join(size, ["path", "item_id"], "left").join(depth, ["path", "item_id"], "left").join(aux, ["path", "item_id"], "left")
    line = F.format_string("item %d: %s %sx%s, %s bits, %s auxiliary images", "item_id", "item_type", F.coalesce(F.col("width").cast("string"), F.lit("?")), F.coalesce(F.col("height").cast("string"), F.lit("?")), F.coalesce(F.col("bit_depth").cast("string"), F.lit("?")), F.coalesce("n_aux", F.lit(0)).cast("string"))
    return rows.select("path", "item_id", line.alias("line"))
