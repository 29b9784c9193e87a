"""MinHash near-duplicate groups with circulant permutations, banding and exact verification.

A shingle's hash is permuted once (sigma) onto 32-bit values; coordinate k of the signature is the minimum of a second
permutation pi after a circular shift by k steps: two permutations make all COORDINATES. BANDS bands of ROWS
coordinates give candidate buckets. With similarity s a pair shares a bucket with probability
1 - (1 - s ** ROWS) ** BANDS: at 0.85 all but 6e-11, at 0.8 all but 1.3e-7.

The steps, each over classes (documents of one shingle set are one class, so copies are never paired):

1. signatures, bands and a digest of the set in one pass over the texts;
2. buckets of two or more classes; inside a bucket the classes whose sizes and signatures allow a link are joined, and
   only the edges that hold them together leave the task (fewer than members, whatever the number of pairs);
3. candidate clusters: the components of these edges;
4. the full sets of the classes in clusters, fetched once; each is compared with its cluster's hub, the class with
   most candidate edges, which links most of a group;
5. the others are compared with all of their cluster, a block of at most BLOCK against another, on full sets; again only
   the edges that hold the linked ones together leave the task;
6. components of the verified edges, by alternating large and small stars.

A signature rejects a pair only if its estimate lies MARGIN standard deviations below the threshold. Links inside
a component that is already joined aren't expanded; no link between different components is left out but with
the probabilities above. Documents without words are alone. A document is a row: rows of one doc_id with different
texts are linked each by its own text, and carry the same name. A row without doc_id takes the component of documents
with the very same set, else its component is null and kept is false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_texts, in_arrow, mix64, offsets, small, stored

BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
BLOCK = 2048
MARGIN = 5.0
STEP = 0x9E3779B1  # odd: the shifts k * STEP mod 2**32 are distinct
SHIFTS = (np.arange(COORDINATES, dtype=np.uint64) * np.uint64(STEP)).astype(np.uint32)


class WordHashes(dict):
    """64-bit hashes of words, kept while they are fewer than LIMIT."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        x = xxhash.xxh3_64_intdigest(word)
        self[word] = x = x - (1 << 64) if x >> 63 else x
        return x


def shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of the whole text if it has fewer words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.array(list(map(hashes.__getitem__, words)), dtype=np.int64).view(np.uint64)
    width = min(width, len(ids))
    n = len(ids) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        h = mix64(h + ids[k : k + n])
    return np.unique(h)


def permute(x: np.ndarray) -> np.ndarray:
    """pi: a permutation of the 32-bit values, in place."""
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    x ^= x >> np.uint32(15)
    return x


def signature(found: np.ndarray) -> np.ndarray:
    sigma = (mix64(found ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(sigma), 1024):
        np.minimum(out, permute(sigma[None, k : k + 1024] + SHIFTS[:, None]).min(1), out=out)
    return out


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature, of its number and rows."""
    rows = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        h = mix64(h + rows[:, :, k])
    return h.view(np.int64)


FEATURES = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sig binary"


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit words for each set."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), dtype=np.int64).reshape(-1, 2)


def features(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        hashes = WordHashes()
        for batch in small(batches, "body"):
            sets = [shingles(t, width, hashes) for t in byte_texts(batch.column("body"))]
            n, d = np.array([len(x) for x in sets], dtype=np.int64), digests(sets)
            signed = [signature(x) for x in sets if len(x)]
            found = np.stack(signed) if signed else np.zeros((0, COORDINATES), np.uint32)
            low, some = pa.py_buffer(found.astype(np.uint8).tobytes()), n > 0
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_shingles": pa.array(n), "d1": pa.array(d[:, 0]), "d2": pa.array(d[:, 1]),
                 "bands": pa.ListArray.from_arrays(pa.array(offsets(some * BANDS), pa.int32()), pa.array(band_keys(found).ravel())),
                 "sig": pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets(some * COORDINATES).astype(np.int32)), low])}
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body")).transform(in_arrow, run, FEATURES)


def least_estimate(percent: int) -> int:
    """The fewest equal coordinates of a pair that may reach the threshold."""
    s = percent / 100
    s += (1 - s) / 256  # coordinates are kept to 8 bits
    return int(COORDINATES * (s - MARGIN * (s * (1 - s) / COORDINATES) ** 0.5))


def sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the edges (i, j) over n places join: each place but the first with the first of its part."""
    part = np.arange(n)
    while True:
        before = part.copy()
        low = np.minimum(part[i], part[j])
        np.minimum.at(part, i, low)
        np.minimum.at(part, j, low)
        part = part[part]
        if (part == before).all():
            rest = np.flatnonzero(part != np.arange(n))
            return rest, part[rest]


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups, in rows that come sorted by names."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        own = np.stack([held.column(c).to_numpy() for c in names], 1)
        other = np.flatnonzero((own != own[-1]).any(1))
        if len(other):
            yield held.slice(0, other[-1] + 1)
            held = held.slice(other[-1] + 1)
    if held is not None:
        yield held


def group_of(t: pa.Table, names: list[str]) -> np.ndarray:
    own = np.stack([t.column(c).to_numpy() for c in names], 1)
    return np.concatenate([[0], np.cumsum((own[1:] != own[:-1]).any(1))])


def in_blocks(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Each row once for each pair of blocks of its key (lo, hi) that holds its own block."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    out = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    out = out.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")
    return out.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def candidates(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that hold together the classes of each bucket that may be linked."""
    least, names = least_estimate(percent), ["key", "lo", "hi"]
    rows = members.join(classes.select("node", "n_shingles", "sig"), "node")

    def run(batches):
        for t in groups(batches, names):
            cut = group_of(t, names)
            n, node, block, lo, hi = (t.column(c).to_numpy() for c in ("n_shingles", "node", "block", "lo", "hi"))
            sig = sigs(t.column("sig").combine_chunks())
            left, right = [], []
            for d in range(1, int(np.bincount(cut).max())):
                i = np.flatnonzero(cut[d:] == cut[:-d])
                j = i + d
                ok = ((lo[i] == hi[i]) | (block[i] != block[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                ok = (sig[i] == sig[j]).sum(1) >= least
                left.append(i[ok])
                right.append(j[ok])
            if left:
                i, j = spanning(len(node), np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_pydict({"a": node[i], "b": node[j]})

    return in_blocks(rows, "key", "size").transform(in_arrow, run, "a bigint, b bigint").where("a <> b").distinct()


FILTER_BITS = 1 << 26


def fetched(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(name, body) of the rows of docs whose id is among ids(name).

    A bitmap of the ids' hashes (at most FILTER_BITS bits, 16 MB as a table of 64-bit words, however many ids) drops most
    other rows before the shuffle of the join.
    """
    place = F.pmod(F.xxhash64("name"), F.lit(FILTER_BITS))
    word, bit = F.floor(place / 64).cast("int"), F.pmod(place, F.lit(64)).cast("int")
    bits = ids.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    rows = docs.select(F.col(doc_id).cast("long").alias("name"), F.col(text).alias("body")).where("name is not null")
    likely = rows.withColumn("word", word).join(F.broadcast(bits), "word").where(F.getbit("bits", bit) == 1).select("name", "body")
    return likely.join(ids, "name", "left_semi")


def clustered_sets(docs: DataFrame, clusters: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """clusters(name, d1, d2, node, cluster) with the full set of each class: that of a row of this id and digest."""

    def to_sets(batches):
        hashes = WordHashes()
        for batch in small(batches, "body"):
            sets = [shingles(t, width, hashes) for t in byte_texts(batch.column("body"))]
            d = digests(sets)
            yield pa.RecordBatch.from_pydict(
                {"name": batch.column("name"), "d1": pa.array(d[:, 0]), "d2": pa.array(d[:, 1]), "set": pa.array([x.tobytes() for x in sets], pa.binary())}
            )

    sets = fetched(docs, clusters.select("name").distinct(), doc_id, text).transform(in_arrow, to_sets, "name bigint, d1 bigint, d2 bigint, set binary")
    return stored(sets.join(clusters, ["name", "d1", "d2"]).dropDuplicates(["node"]).select("node", "cluster", "set"), "cluster-sets")


def linked(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are linked with set x (all are sorted)."""
    sizes = np.array([len(y) for y in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    both = np.add.reduceat((x[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * both >= percent * (len(x) + sizes - both)


def with_hub(sets: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """sets with a flag: linked with the hub of the cluster (the hub itself is)."""
    of_hub = sets.join(hubs, "node", "left_semi").select("cluster", F.col("set").alias("hub_set"))

    def run(batches):
        for batch in batches:
            flag = [
                bool(linked(np.frombuffer(h.as_buffer(), np.uint64), [np.frombuffer(s.as_buffer(), np.uint64)], percent)[0])
                for s, h in zip(batch.column("set"), batch.column("hub_set"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("cluster"), pa.array(flag, pa.bool_())], names=["node", "cluster", "near"])

    pairs = sets.select("node", "cluster", "set").join(of_hub, "cluster")
    return stored(pairs.transform(in_arrow, run, "node bigint, cluster bigint, near boolean"), "hub-links")


def remaining(sets: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Verified edges between classes that aren't linked with their hub and all of their cluster."""
    names = ["cluster", "turn", "lo", "hi"]
    counts = near.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(F.when(~F.col("near"), 1).otherwise(0)).alias("far"))
    rows = sets.join(near.select("node", "near"), "node").join(counts.where("far > 0"), "cluster")
    far_blocks, all_blocks = F.ceil(F.col("far") / BLOCK).cast("int"), F.ceil(F.col("size") / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    # Turn 0 holds the far classes that are compared, turn 1 all that they are compared with.
    far = rows.where(~F.col("near")).withColumn("turn", F.lit(0)).withColumn("lo", own(far_blocks)).withColumn("hi", F.explode(F.sequence(F.lit(0), all_blocks - 1)))
    every = rows.withColumn("turn", F.lit(1)).withColumn("hi", own(all_blocks)).withColumn("lo", F.explode(F.sequence(F.lit(0), far_blocks - 1)))
    columns = ["cluster", "lo", "hi", "turn", "node", "near", "set"]
    dealt = far.select(columns).union(every.select(columns)).repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "turn", "node")

    def run(batches):
        for t in groups(batches, ["cluster", "lo", "hi"]):
            cut = group_of(t, ["cluster", "lo", "hi"])
            turn, node, near_hub = (t.column(c).to_numpy() for c in ("turn", "node", "near"))
            sets_of = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
            size = np.array([len(x) for x in sets_of])
            a, b = [], []
            for g in np.split(np.arange(len(cut)), np.flatnonzero(np.diff(cut)) + 1):
                ask, rest = g[turn[g] == 0], g[turn[g] == 1]
                part = {int(node[k]): -1 if near_hub[k] else int(node[k]) for k in g}  # -1: with the hub
                inside = np.array([part[int(node[k])] for k in rest])
                for q in ask:
                    mine = part[int(node[q])]
                    ok = (inside != mine) & (100 * np.minimum(size[rest], size[q]) >= percent * np.maximum(size[rest], size[q]))
                    other = rest[ok]
                    if not len(other):
                        continue
                    hit = other[linked(sets_of[q], [sets_of[k] for k in other], percent)]
                    parts, first = np.unique([part[int(node[k])] for k in hit], return_index=True)
                    for p, k in zip(parts.tolist(), hit[first].tolist(), strict=True):
                        a.append(int(node[q]))
                        b.append(int(node[k]))
                        for n, v in part.items():
                            if v == p:
                                part[n] = mine
                        inside[inside == p] = mine
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.transform(in_arrow, run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge: alternating large and small stars until nothing changes.

    The joins with a node's least neighbour are on a second key as well, so they are dealt anew and Spark may split a hub's
    rows (it doesn't where it reads an aggregate in place).
    """

    def down(e, x="a", y="b"):
        return e.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a > b").distinct()

    def mark(e):
        return e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()

    def with_least(e, u, least):
        deal = lambda d: d.withColumn("dealt", F.pmod(F.xxhash64(u), F.lit(1 << 20)))
        return deal(e).join(deal(least), [u, "dealt"]).drop("dealt")

    now = stored(down(edges), "stars")
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_least(both, "u", least).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = with_least(large, "a", low)
        small = joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = stored(down(small), "stars")
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    made = stored(features(docs, width, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "signatures")
    full = made.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "row")).alias("r")).select("d1", "d2", F.col("r.doc_id").alias("name"), F.col("r.row").alias("node"))
    classes = stored(full.join(reps.select(F.col("node").alias("row"), "node"), "row").select("node", "n_shingles", "bands", "sig"), "classes")
    keyed = classes.select("node", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    edges = stored(candidates(keyed.join(sizes, "key"), classes, percent), "candidates")
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    clusters = components(edges).withColumnRenamed("component", "cluster").join(degree, "node").join(reps, "node")
    clusters = stored(clusters, "clusters")
    hubs = clusters.groupBy("cluster").agg(F.max(F.struct("degree", "node")).alias("h")).select(F.col("h.node").alias("node"))
    sets = clustered_sets(docs, clusters.select("name", "d1", "d2", "node", "cluster"), width, doc_id, text)
    near = with_hub(sets, hubs, percent)
    hub_of = clusters.join(hubs, "node", "left_semi").select("cluster", F.col("node").alias("b"))
    star = near.where("near").join(hub_of, "cluster").select(F.col("node").alias("a"), "b")
    parts = components(stored(star.union(remaining(sets, near, percent)), "links"))
    linked_classes = parts.join(clusters.select("node", "name", "d1", "d2"), "node")
    least = linked_classes.groupBy("component").agg(F.min("name").alias("least"))
    of_class = linked_classes.join(least, "component").select("d1", "d2", "least")
    of_class = reps.join(of_class, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("least", "name").alias("least"))
    part = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return made.join(of_class, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", part.alias("component_id"), F.coalesce(F.col("doc_id") == part, F.lit(False)).alias("kept")
    )


_LOW = "translate(coalesce(\"text\", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sig AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS cls FROM s GROUP BY doc_id),
rep AS (SELECT cls, min(doc_id) AS rep FROM sig GROUP BY cls),
rs AS (SELECT s.* FROM s JOIN rep ON rep.rep = s.doc_id),
both_sides AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM rs x JOIN rs y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_sides JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk(node, seen) AS (SELECT rep, rep FROM rep UNION SELECT e.b, walk.seen FROM walk JOIN edges e ON e.a = walk.node),
part AS (SELECT node, min(seen) AS component FROM walk GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id,
       coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN sig ON sig.doc_id = d.doc_id LEFT JOIN rep ON rep.cls = sig.cls
LEFT JOIN part ON part.node = rep.rep
"""
