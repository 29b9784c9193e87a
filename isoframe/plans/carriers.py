"""The engine's relational operators on the driver's tables.

Those tables hold no images; they carry the operators' algebra (a user's events as the samples of a track, embeddings as
8x8 pictures), so that each can be held against SQL. Every query runs over its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import colour
from ..operators import pixels as px
from ..operators import sequences as seq
from .container import first_by

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", F.floor("value").cast("long").alias("duration"), (F.col("event_id") % 3).alias("composition_offset"), (F.col("event_type") == "signup").alias("sync"))


EV = """e AS (SELECT user_id, ts, event_id, floor(value)::BIGINT AS duration, event_id % 3 AS off, event_type = 'signup' AS sync,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"""
ORDER = ["ts", "event_id"]
PIXELS = "p AS (SELECT vec_id, (k - 1) % 8 AS x, (k - 1) // 8 AS y, (floor(abs(e::DOUBLE) * 1000)::BIGINT % 256)::INTEGER AS v FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings))"


def pictures(spark, sf_dir) -> DataFrame:
    """embeddings as 8x8 pictures of 8-bit samples."""
    value = (F.floor(F.abs(F.col("raw").cast("double")) * 1000) % 256).cast("int")
    return px.exploded(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, value)


@query(f"""WITH {EV}, t AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + off AS t FROM e)
SELECT user_id, event_id, t::BIGINT AS t, row_number() OVER w - 1 AS frame_no, coalesce(lead(t) OVER w - t, duration)::BIGINT AS ticks
FROM t WINDOW w AS (PARTITION BY user_id ORDER BY t, ts, event_id)""")
def display_order(spark, sf_dir):
    rows = seq.display(seq.composition(events(spark, sf_dir), ["user_id"], ORDER), ["user_id"], ORDER)
    return rows.select("user_id", "event_id", "t", F.col("frame_no").cast("long").alias("frame_no"), "ticks")


@query(f"""WITH {EV} SELECT user_id, event_id, n, coalesce(max(CASE WHEN sync THEN n END) OVER (PARTITION BY user_id ORDER BY n), -1) AS from_n FROM e""")
def keyframe_before(spark, sf_dir):
    rows = seq.keyframe_before(events(spark, sf_dir), ["user_id"], ORDER)
    return rows.select("user_id", "event_id", F.col("n").cast("long").alias("n"), F.coalesce("from_n", F.lit(-1)).cast("long").alias("from_n"))


@query(f"""WITH {EV}, g AS (SELECT user_id, n, sum(sync::INT) OVER (PARTITION BY user_id ORDER BY n) AS gop FROM e),
ok AS (SELECT user_id FROM g GROUP BY user_id HAVING min(gop) > 0)
SELECT user_id, gop::BIGINT AS gop, min(n) AS first_n, max(n) + 1 AS past_n FROM g WHERE user_id IN (SELECT user_id FROM ok) GROUP BY user_id, gop""")
def picture_groups(spark, sf_dir):
    rows = seq.picture_groups(events(spark, sf_dir), ["user_id"], ORDER)
    return rows.select("user_id", *[F.col(c).cast("long").alias(c) for c in ("gop", "first_n", "past_n")])


@query(f"""WITH {EV} SELECT user_id, n // 30 AS grp, count(*) AS frames, sum(duration)::BIGINT AS ticks FROM e GROUP BY user_id, n // 30""")
def thirty_frame_groups(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    rows = events(spark, sf_dir).withColumn("grp", F.floor((F.row_number().over(w) - 1) / 30))
    return rows.groupBy("user_id", "grp").agg(F.count("*").alias("frames"), F.sum("duration").alias("ticks"))


@query(f"""WITH {EV}, r AS (SELECT *, sum(CASE WHEN duration % 4 IS NOT DISTINCT FROM l THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS run
FROM (SELECT *, lag(duration % 4) OVER (PARTITION BY user_id ORDER BY n) AS l FROM e))
SELECT user_id, run::BIGINT AS run, count(*) AS count, min(duration % 4) AS d FROM r GROUP BY user_id, run""")
def sample_runs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    rows = events(spark, sf_dir).select("user_id", F.row_number().over(w).alias("n"), (F.col("duration") % 4).alias("d"))
    return seq.sample_runs(rows, ["user_id"], "n", "d").select("user_id", F.col("run").cast("long").alias("run"), "count", "d")


@query(f"WITH {PIXELS} SELECT vec_id, y AS x, 7 - x AS y, v FROM p")
def rotate_left(spark, sf_dir):
    return _xyv(px.rotate(pictures(spark, sf_dir), 1, 8, 8))


@query(f"WITH {PIXELS} SELECT vec_id, 7 - y AS x, x AS y, v FROM p")
def rotate_right(spark, sf_dir):
    return _xyv(px.rotate(pictures(spark, sf_dir), 3, 8, 8))


@query(f"WITH {PIXELS} SELECT vec_id, 7 - x AS x, y, v FROM p")
def mirror_left_right(spark, sf_dir):
    return _xyv(px.mirror(pictures(spark, sf_dir), False, 8, 8))


@query(f"WITH {PIXELS} SELECT vec_id, x, 7 - y AS y, v FROM p")
def mirror_top_bottom(spark, sf_dir):
    return _xyv(px.mirror(pictures(spark, sf_dir), True, 8, 8))


@query(f"WITH {PIXELS} SELECT vec_id, x - 2 AS x, y - 3 AS y, v FROM p WHERE x BETWEEN 2 AND 6 AND y BETWEEN 3 AND 11")
def crop_picture(spark, sf_dir):
    return _xyv(px.crop(pictures(spark, sf_dir), 2, 3, 5, 9))


def _xyv(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "v")


@query(f"""WITH {PIXELS} SELECT b.vec_id, b.x, b.y, (CASE WHEN f.v IS NULL THEN b.v ELSE (f.v * f.a + b.v * (255 - f.a) + 127) // 255 END)::INTEGER AS v
FROM p b LEFT JOIN (SELECT vec_id - 1 AS vec_id, x + 2 AS x, y - 1 AS y, v, (v * 7) % 256 AS a FROM p) f ON f.vec_id = b.vec_id AND f.x = b.x AND f.y = b.y""")
def overlay_blend(spark, sf_dir):
    p = pictures(spark, sf_dir)
    front = p.select((F.col("vec_id") - 1).alias("vec_id"), "x", "y", "v", (F.col("v") * 7 % 256).alias("a"))
    return _xyv(px.overlay(p, front, "vec_id", 2, -1))


@query(f"""WITH {PIXELS} SELECT vec_id // 4 AS canvas, x + 8 * (vec_id % 2) AS x, y + 8 * (vec_id % 4 // 2) AS y, v FROM p WHERE x + 8 * (vec_id % 2) < 14 AND y + 8 * (vec_id % 4 // 2) < 13""")
def grid_assembly(spark, sf_dir):
    p = pictures(spark, sf_dir).withColumn("tile", (F.col("vec_id") % 4).cast("int"))
    rows = px.place_tile(p, "tile", 2, 8, 8, 14, 13)
    return rows.select(F.floor(F.col("vec_id") / 4).alias("canvas"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "v")


@query(f"WITH {PIXELS} SELECT vec_id, x // 4 AS ox, y // 2 AS oy, ((sum(v) + count(*) // 2) // count(*))::INTEGER AS v FROM p GROUP BY ALL")
def thumbnail_average(spark, sf_dir):
    rows = px.box_average(pictures(spark, sf_dir), "vec_id", 8, 8, 2, 4)
    return rows.select("vec_id", F.col("ox").cast("long").alias("ox"), F.col("oy").cast("long").alias("oy"), "v")


@query(f"""WITH {PIXELS} SELECT vec_id, x // 2 AS mx, y // 2 AS my, round(avg(least(log2(greatest(CASE WHEN v > 0 THEN ((v * 5) % 256)::DOUBLE / v WHEN (v * 5) % 256 > 0 THEN 8.0::DOUBLE ELSE 1.0::DOUBLE END, 1.0::DOUBLE)), 3.0::DOUBLE)) / 3.0::DOUBLE * 255)::INTEGER AS gain FROM p GROUP BY ALL""")
def gain_map_build(spark, sf_dir):
    p = pictures(spark, sf_dir).withColumn("bright", (F.col("v") * 5 % 256).cast("double"))
    rows = px.log_gain(p, "vec_id", "v", "bright", 3.0)
    return rows.select("vec_id", F.col("mx").cast("long").alias("mx"), F.col("my").cast("long").alias("my"), "gain")


@query(f"WITH {PIXELS} SELECT vec_id, (sum(xor(v & 255, xor(xor(x, y), xor(x >> 8, y >> 8)) & 255)) % 4294967296)::BIGINT AS checksum FROM p GROUP BY vec_id")
def plane_checksum(spark, sf_dir):
    return px.plane_checksum(pictures(spark, sf_dir), "vec_id")


@query(f"""WITH {PIXELS}, h AS (SELECT vec_id, x // 4 AS bx, y // 4 AS yy, u, w, abs(sum(CASE WHEN (bit_count((x % 4)::INT & u::INT) + bit_count((y % 4)::INT & w::INT)) % 2 = 0 THEN v ELSE -v END)) AS h
FROM p, range(4) a(u), range(4) b(w) GROUP BY ALL), s AS (SELECT vec_id, bx, yy, sum(h) // 2 AS s FROM h GROUP BY ALL)
SELECT vec_id, sum(s)::BIGINT AS satd FROM s GROUP BY vec_id""")
def hadamard_cost(spark, sf_dir):
    return px.hadamard_cost(pictures(spark, sf_dir), "vec_id")


@query(f"""WITH {PIXELS} SELECT vec_id, x, y, ((coalesce(lag(v) OVER w, v) + 2 * v + coalesce(lead(v) OVER w, v) + 2) // 4)::INTEGER AS v FROM p WINDOW w AS (PARTITION BY vec_id, y ORDER BY x)""")
def neighbour_filter(spark, sf_dir):
    return _xyv(px.smooth_rows(pictures(spark, sf_dir), "vec_id"))


@query(f"""WITH {PIXELS} SELECT vec_id, sum((v - (v // 16) * 16) * (v - (v // 16) * 16))::BIGINT AS sse,
round(CASE WHEN sum((v % 16) * (v % 16)) = 0 THEN 99.0 ELSE 10 * log10(65025.0::DOUBLE / (sum((v % 16) * (v % 16))::DOUBLE / count(*))) END, 6) AS psnr FROM p GROUP BY vec_id""")
def picture_psnr(spark, sf_dir):
    p = pictures(spark, sf_dir).withColumn("coarse", F.floor(F.col("v") / 16) * 16)
    rows = px.squared_error(p, "vec_id", "v", "coarse")
    return rows.select("vec_id", F.col("sse").cast("long").alias("sse"), F.round(px.psnr(F.col("sse").cast("double") / 64), 6).alias("psnr"))


PQ = "pow(greatest(pow(x, 1 / 78.84375::DOUBLE) - 0.8359375::DOUBLE, 0) / (18.8515625::DOUBLE - 18.6875::DOUBLE * pow(x, 1 / 78.84375::DOUBLE)), 1 / 0.1593017578125::DOUBLE) * (10000.0::DOUBLE / 203)"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END, 6) AS srgb, round({PQ}, 6) AS pq,
round(CASE WHEN x <= 0.5 THEN x * x / 3 ELSE (exp((x - 0.55991073::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12 END, 6) AS hlg FROM l""")
def transfer_functions(spark, sf_dir):
    x = F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(colour.srgb_to_linear(x), 6).alias("srgb"), F.round(colour.pq_to_linear(x), 6).alias("pq"), F.round(colour.hlg_to_scene(x), 6).alias("hlg")
    )


@query("SELECT p_partkey, ((p_size * 255 + 25) // 50)::BIGINT AS v8 FROM part")
def depth_rescale(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", colour.rescale(F.col("p_size"), F.lit(50), 255).alias("v8"))


@query("""WITH k AS (SELECT *, CASE p_size % 12 WHEN 1 THEN 0.2126::DOUBLE WHEN 4 THEN 0.30::DOUBLE WHEN 7 THEN 0.212::DOUBLE WHEN 9 THEN 0.2627::DOUBLE WHEN 10 THEN 0.2627::DOUBLE ELSE 0.299::DOUBLE END AS kr,
CASE p_size % 12 WHEN 1 THEN 0.0722::DOUBLE WHEN 4 THEN 0.11::DOUBLE WHEN 7 THEN 0.087::DOUBLE WHEN 9 THEN 0.0593::DOUBLE WHEN 10 THEN 0.0593::DOUBLE ELSE 0.114::DOUBLE END AS kb FROM part)
SELECT p_partkey, round(p_size * 4 + 2 * (1 - kr) * (p_partkey % 64), 6) AS r, round(p_size * 4 + 2 * (1 - kb) * (p_partkey % 32), 6) AS b FROM k""")
def colour_matrix(spark, sf_dir):
    kr, kb = colour.kr_kb(F.col("p_size") % 12)
    y = F.col("p_size") * 4
    return table(spark, sf_dir, "part").select("p_partkey", F.round(y + 2 * (1 - kr) * (F.col("p_partkey") % 64), 6).alias("r"), F.round(y + 2 * (1 - kb) * (F.col("p_partkey") % 32), 6).alias("b"))


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
r(root, node, hop) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer UNION ALL SELECT root, e.b, hop + 1 FROM r JOIN e ON e.a = r.node WHERE hop < 4)
SELECT root, node, hop FROM r""")
def reference_closure(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = customer.select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("to")).unionByName(nation.select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("to")))
    front = customer.select(key("c", "c_custkey").alias("root"), key("c", "c_custkey").alias("node"), F.lit(0).alias("hop"))
    found = front
    for hop in range(1, 5):
        front = front.join(edges, "node").select("root", F.col("to").alias("node"), F.lit(hop).alias("hop"))
        found = found.unionByName(front)
    return found


@query("""SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def top_level_anti_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return docs.join(labels.where("quality = 0"), "doc_id", "left_anti").join(labels.where("toxic = 1"), "doc_id", "left_anti")


@query("SELECT s_nationkey, s_suppkey, s_name FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal), s_suppkey) = 1")
def smallest_first_match(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("area", F.abs("s_acctbal"))
    return first_by(rows, ["s_nationkey"], ["area", "s_suppkey"]).select("s_nationkey", "s_suppkey", "s_name")


@query("SELECT d.doc_id, coalesce(l.quality, h.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN labels h ON h.doc_id = d.doc_id // 2")
def fallback_chain(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    other = labels.select(F.col("doc_id").alias("half"), F.col("quality").alias("other"))
    rows = docs.join(labels, "doc_id", "left").join(other, F.floor(F.col("doc_id") / 2) == F.col("half"), "left")
    return rows.select("doc_id", F.coalesce("quality", "other", F.lit(-1)).alias("quality"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_custkey % 7 AS n FROM orders),
x AS (SELECT o_custkey, o_orderkey, unnest(range(n)) AS k, 1 + o_orderkey % 5 AS size FROM r)
SELECT o_custkey, o_orderkey, k, (sum(size) OVER (PARTITION BY o_custkey ORDER BY o_orderkey, k) - size)::BIGINT AS off FROM x""")
def run_expansion(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 7).alias("n")).where("n > 0")
    rows = runs.select("o_custkey", "o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"), (1 + F.col("o_orderkey") % 5).alias("size"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey", "k").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("o_custkey", "o_orderkey", "k", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("off"))


@query("""SELECT doc_id, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN printf('%.0f KB', n / 1000.0::DOUBLE) ELSE printf('%.1f MB', n / 1e6) END AS human, lpad(doc_id::VARCHAR, greatest(3, strlen(c::VARCHAR))::INT, '0') AS name
FROM (SELECT doc_id, n_chars * 7 AS n FROM documents), (SELECT count(*) AS c FROM documents)""")
def human_sizes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", colour.human_bytes(F.col("n_chars") * 7).alias("human"), colour.frame_name(F.col("doc_id"), F.lit(docs.count())).alias("name"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 1500000 ELSE p_size END::BIGINT AS bytes FROM part WHERE p_size > 0""")
def size_text(spark, sf_dir):
    n = F.col("p_size")
    text = F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit("K"))).when(n % 3 == 1, F.concat((n * 1.5).cast("string"), F.lit(" mb"))).otherwise(n.cast("string"))
    return table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", colour.parse_size(text).alias("bytes"))


@query("SELECT qp, min(q)::BIGINT AS low, max(q)::BIGINT AS high FROM (SELECT q, least(greatest(round(68 - 0.6 * q), 8), 51)::INTEGER AS qp FROM range(101) t(q)) GROUP BY qp")
def quality_levels(spark, sf_dir):
    rows = spark.range(101).withColumn("qp", colour.quality_to_qp(F.col("id")))
    return rows.groupBy("qp").agg(F.min("id").alias("low"), F.max("id").alias("high"))


@query("SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS med FROM events GROUP BY event_type")
def upper_median(spark, sf_dir):
    # A type may hold a third of all events: approximate quantiles bracket the median, and only the few rows between
    # them are ranked.
    e = table(spark, sf_dir, "events").where("value is not null").select("event_type", "value")
    edge = e.groupBy("event_type").agg(F.count("*").alias("m"), F.percentile_approx("value", [0.5 - 5e-5, 0.5 + 5e-5], 100_000).alias("q"))
    near = e.join(edge, "event_type").where((F.col("value") >= F.col("q")[0]) & (F.col("value") <= F.col("q")[1]))
    below = e.join(edge, "event_type").groupBy("event_type").agg(F.count_if(F.col("value") < F.col("q")[0]).alias("below"))
    counts = near.groupBy("event_type", "value", "m").agg(F.count("*").alias("n")).join(below, "event_type")
    w = Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.col("below") + F.sum("n").over(w))
    return ranked.where(F.col("upto") > F.floor(F.col("m") / 2)).groupBy("event_type").agg(F.min("value").alias("med"))


@query("SELECT c_custkey, i, ((i + 1) * (c_custkey % 90 + 10) // 6 - i * (c_custkey % 90 + 10) // 6)::INTEGER AS size FROM customer, range(6) r(i)")
def uniform_tiles(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("i"))
    return rows.withColumn("size", px.uniform_spacing(F.col("i"), F.lit(6), F.col("c_custkey") % 90 + 10))
