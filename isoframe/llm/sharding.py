"""Sharding by size-tiered compaction, with a versioned manifest.

Arrivals are appended as small immutable shards of about SMALL bytes. Compaction takes the shards of a manifest
version in tiers by size (SMALL * FAN ** k), and merges runs of neighbours of one tier into a run of the next until
they reach TARGET. The tiers are worked out on the manifest alone, so a row is rewritten once however many tiers its
shard climbs. Each append and each compaction commits the next version: entries are written first, then one small
file is renamed into place, which fails if another writer has taken the version. Readers see a whole version or
the one before; a lost executor's task is rerun before anything is committed.

An arrival is a stretch of doc_ids: ARRIVAL_DOCS of them, or where ids are sparse (fewer than FULL rows for each occupied
stretch of that length) as many as hold ARRIVAL_DOCS rows on average. Arrivals are numbered from the least doc_id, after
those of earlier appends, so any 64-bit id fits. Rows without doc_id are dealt to NULL_ARRIVALS further arrivals by a
hash of the text; rows of one doc_id stay together. Shards of SEGMENT neighbouring arrivals are compacted together, so no
window grows with the table. Sizes are logical: bytes of text and ROW_BYTES for each row. Everything is a DataFrame or
SQL expression. A row is stored as one struct column, so its columns may have any names. An empty table makes a version
without shards. vacuum() removes shards that no version kept names.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, shuffles_dropped

SMALL, FAN, TARGET = 4 << 20, 4, 64 << 20
ARRIVAL_DOCS, SEGMENT = 2048, 256
ROW_BYTES = 64
FULL = 64
MOST_WIDE = 1 << 62
NULL_ARRIVALS = 1024
PLACE = 1 << 20  # shards of an arrival, at most
LAYOUT = ["isoframe_version", "isoframe_shard"]
ENTRIES = "isoframe_version int, isoframe_shard string, run bigint, shard_bytes bigint, shard_rows bigint"


class CommitConflict(RuntimeError):
    """Another writer has committed the version first."""


def row_size(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def stretch(number: Column, width: int) -> Column:
    """number / width rounded down, in whole numbers."""
    w = F.lit(width).cast("long")
    return F.call_function("div", number, w) - F.when(number % w < 0, 1).otherwise(0)


def limits(small: int, fan: int, target: int) -> list[int]:
    """Upper sizes of the tiers below the target."""
    out = [small]
    while out[-1] < target:
        out.append(min(out[-1] * fan, target))
    return out


class ShardStore:
    """Shards below root/data and manifest versions below root/manifest."""

    def __init__(self, spark: SparkSession, root: str, small: int = SMALL, fan: int = FAN, target: int = TARGET, doc_id: str = "doc_id", text: str = "text", arrival_docs: int = ARRIVAL_DOCS, segment: int = SEGMENT):
        self.spark, self.root = spark, root
        self.small, self.fan, self.target = small, fan, target
        self.doc_id, self.text, self.arrival_docs, self.segment = doc_id, text, arrival_docs, segment

    # -- manifest ------------------------------------------------------------------------------------------------

    def _context(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/{name}")

    def versions(self) -> list[int]:
        _, context = self._context()
        if not context.util().exists(self._path("x").getParent()):
            return []
        names = [f.getPath().getName() for f in context.util().listStatus(self._path("x").getParent())]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version (the last by default)."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], ENTRIES)
        n = have[-1] if version is None else version
        line = self.spark.read.text(f"{self.root}/manifest/v{n:08d}.json", wholetext=True).first()[0]
        return self.spark.read.schema(ENTRIES).parquet(f"{self.root}/manifest/{json.loads(line)['entries']}")

    def commit(self, entries: DataFrame, version: int) -> None:
        """Make entries the given version, or raise CommitConflict; the rename is the commit."""
        folder = f"entries-{uuid.uuid4().hex}"
        entries.select("isoframe_version", "isoframe_shard", "run", "shard_bytes", "shard_rows").write.parquet(f"{self.root}/manifest/{folder}")
        jvm, context = self._context()
        draft, final = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"v{version:08d}.json")
        flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
        out = context.create(draft, flags, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
        out.write(json.dumps({"version": version, "entries": folder}).encode())
        out.close()
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, how)
        except Exception as e:
            context.delete(draft, False)
            if "AlreadyExists" in str(e):
                raise CommitConflict(f"version {version}") from e
            raise

    # -- data ----------------------------------------------------------------------------------------------------

    def _rows(self, version: int) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(f"{self.root}/data/isoframe_version={version}")

    def _write(self, rows: DataFrame, version: int) -> None:
        placed = rows.withColumn("isoframe_version", F.lit(version))
        ordered = placed.sortWithinPartitions("isoframe_shard", f"row.{self.doc_id}")
        with shuffles_dropped(self.spark):
            ordered.write.mode("append").option("compression", "zstd").partitionBy(*LAYOUT).parquet(f"{self.root}/data")

    def append(self, docs: DataFrame) -> int:
        """Add the rows of docs as small shards; returns the version committed."""
        before = self.versions()
        version = before[-1] + 1 if before else 1
        last = self.manifest().agg(F.max("run")).first()[0]
        offset = 0 if last is None else last // PLACE + 1
        chunks = docs.groupBy(stretch(F.col(self.doc_id), self.arrival_docs).alias("c")).agg(F.count(self.doc_id).alias("n"), F.min(self.doc_id).alias("lo"), F.max(self.doc_id).alias("hi"))
        about = chunks.where("n > 0").agg(F.sum("n"), F.count("*"), F.min("lo"), F.max("hi")).first()
        rows, stretches, low, high = (0, 0, 0, 0) if about[0] is None else about
        width = min(MOST_WIDE, self.arrival_docs * max(1, (high - low) // rows if rows < FULL * stretches else 1))
        place = stretch(F.col(f"row.{self.doc_id}"), width) - F.lit(low // width)
        spread = (high // width - low // width + 1) + F.pmod(F.xxhash64(F.coalesce(F.col(f"row.{self.text}"), F.lit(""))), F.lit(NULL_ARRIVALS))
        placed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row")).withColumn("arrival", F.coalesce(place, spread) + offset)
        earlier = Window.partitionBy("arrival").orderBy(f"row.{self.doc_id}").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        same = Window.partitionBy("arrival", f"row.{self.doc_id}")
        size = row_size(f"row.{self.text}")
        filled = F.sum(size).over(earlier) - F.sum(size).over(same)  # of the rows with a lesser id
        run = F.col("arrival") * PLACE + F.floor(filled / self.small)
        self._write(placed.select("row", F.concat(F.lit("s"), run.cast("string")).alias("isoframe_shard")), version)
        made = self._entries(version) if rows or not docs.isEmpty() else self.spark.createDataFrame([], ENTRIES)
        self.commit(self.manifest().unionByName(made), version)
        return version

    def _entries(self, version: int) -> DataFrame:
        run = F.substring("isoframe_shard", 2, 40).cast("long")
        return self._rows(version).groupBy(*LAYOUT).agg(F.sum(row_size(f"row.{self.text}")).alias("shard_bytes"), F.count("*").alias("shard_rows")).withColumn("run", run)

    def plan(self, entries: DataFrame) -> DataFrame:
        """entries with the run each shard ends in (target_run) and how many shards that run has (merged)."""
        segment = F.floor(F.floor(F.col("run") / PLACE) / self.segment)
        out = entries.withColumn("segment", segment).withColumn("target_run", F.col("run"))
        tops = limits(self.small, self.fan, self.target)
        for k, top in enumerate(tops[1:]):
            size = F.sum("shard_bytes").over(Window.partitionBy("segment", "target_run"))
            low = tops[k - 1] if k else 0
            # A small shard holds SMALL bytes give or take its last document: tier k is below the middle of its step.
            inside = (F.col("size") >= low * 3 // 4) & (F.col("size") < tops[k + 1] * 3 // 4)
            out = out.withColumn("size", size).withColumn("inside", inside)
            before = Window.partitionBy("segment", "inside").orderBy("target_run").rangeBetween(Window.unboundedPreceding, -1)
            filled = F.coalesce(F.sum("shard_bytes").over(before), F.lit(0))
            out = out.withColumn("part", F.when(F.col("inside"), F.floor(filled / top)).otherwise(F.lit(-1)))
            first = F.min("target_run").over(Window.partitionBy("segment", "inside", "part"))
            out = out.withColumn("target_run", F.when(F.col("inside"), first).otherwise(F.col("target_run")))
        merged = F.count("*").over(Window.partitionBy("segment", "target_run"))
        return out.withColumn("merged", merged).select(*entries.columns, "target_run", "merged")

    def compact(self) -> int:
        """Merge the last version's shards and commit the next; the same version if there is nothing to merge."""
        last = self.versions()[-1]
        version, path = last + 1, f"{self.root}/manifest/plan-{uuid.uuid4().hex}"
        self.plan(self.manifest(last)).write.parquet(path)
        planned = self.spark.read.parquet(path)
        move = planned.where("merged > 1").select(*LAYOUT, "target_run")
        sources = [r[0] for r in move.select("isoframe_version").distinct().collect()]  # versions, not shards
        if not sources:
            return last
        rows = self._union(sorted(sources))
        rows = rows.join(move, LAYOUT).drop(*LAYOUT).withColumn("isoframe_shard", F.concat(F.lit("r"), F.col("target_run").cast("string")))
        self._write(rows.drop("target_run").repartition("isoframe_shard"), version)
        kept = planned.where("merged = 1").select("isoframe_version", "isoframe_shard", "run", "shard_bytes", "shard_rows")
        made = planned.where("merged > 1").groupBy("target_run").agg(F.sum("shard_bytes").alias("shard_bytes"), F.sum("shard_rows").alias("shard_rows"))
        made = made.select(F.lit(version).alias("isoframe_version"), F.concat(F.lit("r"), F.col("target_run").cast("string")).alias("isoframe_shard"), F.col("target_run").alias("run"), "shard_bytes", "shard_rows")
        self.commit(kept.unionByName(made), version)
        return version

    def _union(self, versions: list[int]) -> DataFrame:
        """The rows of these versions' folders; columns that some lack are null there."""
        parts = [self._rows(v) for v in versions]
        if len({p.schema["row"].dataType.json() for p in parts}) > 1:
            names = list(dict.fromkeys(c for p in parts for c in p.schema["row"].dataType.names))
            flat = [p.select(*LAYOUT, *[F.col(f"row.`{c}`").alias(f"c{names.index(c)}") for c in p.schema["row"].dataType.names]) for p in parts]
            both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flat)
            return both.select(F.struct(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)]).alias("row"), *LAYOUT)
        return reduce(DataFrame.unionByName, parts)

    def placed(self, version: int | None = None) -> DataFrame:
        """(row, and the entry of its shard) of every row of a version; only the folders that the version names are listed."""
        entries = self.manifest(version)
        named = sorted(r[0] for r in entries.select("isoframe_version").distinct().collect())
        if not named:
            raise ValueError("the version has no shards")
        return self._union(named).join(entries, LAYOUT)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        return self.placed(version).select("row.*")

    def vacuum(self, keep: list[int] | None = None) -> int:
        """Forget all versions but those to keep (by default the last) and remove the shards that none of them names.

        Shards are listed as a table and named to the driver one at a time; returns how many went.
        """
        have = self.versions()
        keep = have[-1:] if keep is None else keep
        live = reduce(DataFrame.unionByName, [self.manifest(v) for v in keep]).select(*LAYOUT).distinct()
        known = reduce(DataFrame.unionByName, [self.manifest(v) for v in have]).select(*LAYOUT).distinct()
        jvm, context = self._context()
        removed = 0
        for v in have:
            if v not in keep:
                context.delete(self._path(f"v{v:08d}.json"), False)
        for r in known.join(live, LAYOUT, "left_anti").toLocalIterator():
            context.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/isoframe_version={r[0]}/isoframe_shard={r[1]}"), True)
            removed += 1
        return removed


def compacted(docs: DataFrame, root: str | None = None, **sizes) -> DataFrame:
    """Append docs, compact, and read the committed version: doc_id and the shard of every row."""
    spark = docs.sparkSession
    store = ShardStore(spark, root or shared_dir(spark, "shards"), **sizes)
    store.append(docs)
    store.compact()
    if store.manifest().isEmpty():
        return spark.createDataFrame([], "doc_id bigint, run bigint, version int, shard_bytes bigint, shard_rows bigint")
    return store.placed().select(F.col(f"row.{store.doc_id}").alias("doc_id"), "run", F.col("isoframe_version").alias("version"), "shard_bytes", "shard_rows")


def sql(small: int = SMALL, fan: int = FAN, target: int = TARGET, arrival_docs: int = ARRIVAL_DOCS, segment: int = SEGMENT) -> str:
    tops = limits(small, fan, target)
    low = lambda x, w: f"({x} // {w} - ({x} % {w} < 0)::INTEGER)"
    steps, last = [], "p0"
    for k, top in enumerate(tops[1:]):
        least = tops[k - 1] if k else 0
        steps.append(f"""
a{k} AS (SELECT *, sum(shard_bytes) OVER (PARTITION BY segment, target_run) AS size FROM {last}),
b{k} AS (SELECT *, size >= {least * 3 // 4} AND size < {tops[k + 1] * 3 // 4} AS inside FROM a{k}),
c{k} AS (SELECT *, CASE WHEN inside THEN coalesce(sum(shard_bytes) OVER (PARTITION BY segment, inside ORDER BY target_run
         RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {top} ELSE -1 END AS part FROM b{k}),
p{k + 1} AS (SELECT run, shard_bytes, shard_rows, segment,
         CASE WHEN inside THEN min(target_run) OVER (PARTITION BY segment, inside, part) ELSE target_run END AS target_run FROM c{k}),""")
        last = f"p{k + 1}"
    return f"""
WITH about AS (SELECT min(doc_id) AS lo, least({MOST_WIDE}, {arrival_docs} * greatest(1, CASE WHEN count(doc_id) < {FULL} * count(DISTINCT {low("doc_id", arrival_docs)})
  THEN (max(doc_id)::HUGEINT - min(doc_id)) // count(doc_id) ELSE 1 END)::HUGEINT) AS width FROM documents),
d AS (SELECT doc_id, ({low("doc_id", "width")} - {low("lo", "width")})::BIGINT AS arrival, coalesce(strlen("text"), 0) + {ROW_BYTES} AS n FROM documents, about),
e AS (SELECT doc_id, n, arrival * {PLACE} + coalesce(sum(n) OVER (PARTITION BY arrival ORDER BY doc_id
      RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {small} AS run FROM d),
s AS (SELECT run, sum(n)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM e GROUP BY run),
p0 AS (SELECT *, floor(floor(run / {PLACE}) / {segment}) AS segment, run AS target_run FROM s),{"".join(steps)}
t AS (SELECT target_run, count(*) AS merged, sum(shard_bytes)::BIGINT AS shard_bytes, sum(shard_rows)::BIGINT AS shard_rows FROM {last} GROUP BY target_run)
SELECT e.doc_id, t.target_run AS run, CASE WHEN merged > 1 THEN 2 ELSE 1 END::INTEGER AS version, t.shard_bytes, t.shard_rows
FROM e JOIN {last} p ON p.run = e.run JOIN t ON t.target_run = p.target_run
"""


SQL = sql()
