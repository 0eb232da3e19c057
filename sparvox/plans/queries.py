"""The engine's queries over the driver's tables, and the same in SQL.

The tables are not volumes, so grids are derived from them: G1 is sparse and crosses all node levels, G2 is compact, G3 has
a grid for each hour of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import masks as M
from ..functions import optics as O
from ..operators import codec as C
from ..operators import grids as G
from ..operators import lookup as L
from ..operators import rays as R
from ..operators import sequences as S
from ..sources import nvdb as N

# --- Grids ------------------------------------------------------------------------------------------------------------

LOW2, HIGH2 = (-30, -24, -5), (29, 25, 5)


def _lineitem(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def g1(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = (F.col("l_partkey") % 512).cast("int") - 256, F.col("l_quantity").cast("int") - 25, (F.col("l_suppkey") % 256).cast("int") - 128
    rows = _lineitem(spark, d).groupBy(x.alias("x"), y.alias("y"), z.alias("z")).agg(F.max("l_quantity").alias("value"))
    return G.with_active(rows)


def g2(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = (F.col("l_orderkey") % 60).cast("int") - 30, F.col("l_quantity").cast("int") - 25, F.round(F.col("l_discount") * 100).cast("int") - 5
    rows = _lineitem(spark, d).groupBy(x.alias("x"), y.alias("y"), z.alias("z")).agg(F.max("l_quantity").alias("value"))
    return G.with_active(rows)


def g3(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    frame = F.floor(F.unix_timestamp("ts") / F.lit(3600.0)).cast("long")
    return e.groupBy(frame.alias("frame"), ((F.col("user_id") % 16).cast("int") - 8).alias("x"), (F.col("user_id") % 7).cast("int").alias("y"), F.lit(0).alias("z")).agg(F.count("*").cast("double").alias("value"))


G1 = "g1 AS (SELECT CAST(l_partkey % 512 AS INT) - 256 AS x, CAST(l_quantity AS INT) - 25 AS y, CAST(l_suppkey % 256 AS INT) - 128 AS z, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"
G2 = "g2 AS (SELECT CAST(l_orderkey % 60 AS INT) - 30 AS x, CAST(l_quantity AS INT) - 25 AS y, CAST(round(l_discount * 100) AS INT) - 5 AS z, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"
G3 = "g3 AS (SELECT CAST(floor(epoch_us(ts) / 1000000 / 3600) AS BIGINT) AS frame, CAST(user_id % 16 AS INT) - 8 AS x, CAST(user_id % 7 AS INT) AS y, 0 AS z, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2, 3)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _xyz():
    return F.col("x"), F.col("y"), F.col("z")


# --- Keys and masks ---------------------------------------------------------------------------------------------------


@query("key_root_key", f"WITH {G1} SELECT x, y, z, ((z & 4294967295) >> 12) | (((y & 4294967295) >> 12) << 21) | (((x & 4294967295) >> 12) << 42) AS root_key FROM (SELECT x::BIGINT x, y::BIGINT y, z::BIGINT z FROM g1)")
def key_root_key(spark, d):
    return g1(spark, d).select(*[F.col(a).cast("long").alias(a) for a in K.AXES], K.root_key(*_xyz()).alias("root_key"))


@query("key_slots", f"WITH {G1} SELECT x, y, z, ((x & 4095) >> 7) * 1024 + ((y & 4095) >> 7) * 32 + ((z & 4095) >> 7) AS upper_slot, ((x & 127) >> 3) * 256 + ((y & 127) >> 3) * 16 + ((z & 127) >> 3) AS lower_slot, (x & 7) * 64 + (y & 7) * 8 + (z & 7) AS leaf_slot FROM g1")
def key_slots(spark, d):
    return g1(spark, d).select(*K.AXES, K.upper_slot(*_xyz()).alias("upper_slot"), K.lower_slot(*_xyz()).alias("lower_slot"), K.leaf_slot(*_xyz()).alias("leaf_slot"))


QUERIES["key_leaf_slot"], SQL["key_leaf_slot"] = (lambda s, d: key_slots(s, d).select("x", "y", "z", "leaf_slot")), f"WITH {G1} SELECT x, y, z, (x & 7) * 64 + (y & 7) * 8 + (z & 7) AS leaf_slot FROM g1"


@query("key_block_align", f"WITH {G1} SELECT DISTINCT (x >> 3) * 8 AS x8, (y >> 7) * 128 AS y128, (z >> 12) * 4096 AS z4096 FROM g1")
def key_block_align(spark, d):
    return g1(spark, d).select(K.align(F.col("x"), 8).alias("x8"), K.align(F.col("y"), 128).alias("y128"), K.align(F.col("z"), 4096).alias("z4096")).distinct()


@query("key_slot_inverse", f"WITH {G1} SELECT DISTINCT (x & 7) * 64 + (y & 7) * 8 + (z & 7) AS slot, x & 7 AS lx, y & 7 AS ly, z & 7 AS lz FROM g1")
def key_slot_inverse(spark, d):
    slot = g1(spark, d).select(K.leaf_slot(*_xyz()).alias("slot")).distinct()
    lx, ly, lz = K.slot_offset(F.col("slot"), 3, 1)
    return slot.select("slot", lx.alias("lx"), ly.alias("ly"), lz.alias("lz"))


@query("key_world_round_trip", f"WITH {G1} SELECT x, y, z, x * 0.5::DOUBLE + 3 AS wx, CAST((x * 0.5::DOUBLE + 3 - 3) / 0.5 AS DOUBLE) AS ix FROM g1")
def key_world_round_trip(spark, d):
    vs, w0, i0 = F.lit(0.5), F.lit(3.0), F.lit(0)
    wx = K.index_to_world(F.col("x"), vs, w0, i0)
    return g1(spark, d).select(*K.AXES, wx.alias("wx"), K.world_to_index(wx, vs, w0, i0).alias("ix"))


@query("key_bbox_atlas_dims", f"WITH {G1} SELECT max(x) - min(x) + 1 AS size_x, max(y) - min(y) + 1 AS size_y, least(max(x) - min(x) + 1, 256) AS dim_x FROM g1")
def key_bbox_atlas_dims(spark, d):
    box = g1(spark, d).agg(*[f(a).alias(f"{n}_{a}") for a in "xy" for f, n in ((F.min, "min"), (F.max, "max"))])
    sx = K.bbox_size(F.col("min_x"), F.col("max_x"))
    return box.select(sx.alias("size_x"), K.bbox_size(F.col("min_y"), F.col("max_y")).alias("size_y"), K.atlas_dims(sx, 256).alias("dim_x"))


@query("key_map_point", f"WITH {G1} SELECT x, y, z, 2.0::DOUBLE * x + 0.5::DOUBLE * y + 1 AS px, 3.0::DOUBLE * y - 2 AS py, 0.25::DOUBLE * z + x AS pz FROM g1")
def key_map_point(spark, d):
    p = K.map_point([2, 0.5, 0, 0, 3, 0, 1, 0, 0.25], [1, -2, 0], list(_xyz()))
    return g1(spark, d).select(*K.AXES, *[c.alias(n) for c, n in zip(p, ("px", "py", "pz"), strict=True)])


@query("key_version", "SELECT n_nationkey AS n, (32 << 21) | (n_nationkey << 10) | 7 AS packed, 32 AS major, n_nationkey AS minor, 7 AS patch FROM nation")
def key_version(spark, d):
    n = F.col("n_nationkey")
    v = K.pack_version(F.lit(32), n, F.lit(7))
    a, b, c = K.unpack_version(v)
    return spark.read.parquet(f"{d}/nation.parquet").select(n.alias("n"), v.alias("packed"), a.alias("major"), b.alias("minor"), c.alias("patch"))


@query("key_type_names", "SELECT n_nationkey AS id, ['Unknown', 'Float', 'Double', 'Int16', 'Int32', 'Int64', 'Vec3f', 'Vec3d', 'Mask', 'Half', 'UInt32', 'Boolean', 'RGBA8', 'Fp4', 'Fp8', 'Fp16', 'FpN', 'Vec4f', 'Vec4d', 'Index', 'OnIndex', 'Retired21', 'Retired22', 'PointIndex', 'Vec3u8'][CAST(n_nationkey AS INT) + 1] AS name FROM nation")
def key_type_names(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), K.name_of(F.col("n_nationkey"), K.GRID_TYPES, "Unknown").alias("name"))


@query("key_limits", "SELECT DISTINCT p_size AS n, CAST(power(2, ceil(log2(p_size))) AS BIGINT) AS pow2 FROM part")
def key_limits(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").alias("n"), K.next_pow2(F.col("p_size")).cast("long").alias("pow2")).distinct()


@query("key_probe_coords")
def key_probe_coords(spark, d):
    return K.probes(spark, 2000, 0x1234567890ABCDEF, (-10, -10, -10), (10, 10, 10))


LEAF1 = "(x >> 3) * 8 AS ox, (y >> 3) * 8 AS oy, (z >> 3) * 8 AS oz"


@query("msk_popcount", f"WITH {G1} SELECT {LEAF1}, CAST(count(*) AS INT) AS ones, 512 - CAST(count(*) AS INT) AS zeros, min((x & 7) * 64 + (y & 7) * 8 + (z & 7)) AS first_slot FROM g1 GROUP BY 1, 2, 3")
def msk_popcount(spark, d):
    rows = G.leaves(g1(spark, d))
    return rows.select("ox", "oy", "oz", M.count_bits(F.col("mask")).alias("ones"), M.count_zero_bits(F.col("mask")).alias("zeros"), M.ones(F.col("mask"))[0].alias("first_slot"))


@query("msk_iter_ones", f"WITH {G1} SELECT {LEAF1}, (x & 7) * 64 + (y & 7) * 8 + (z & 7) AS slot FROM g1")
def msk_iter_ones(spark, d):
    return G.leaves(g1(spark, d)).select("ox", "oy", "oz", F.explode(M.ones(F.col("mask"))).alias("slot"))


@query("msk_words", f"WITH {G1}, s AS (SELECT {LEAF1}, (x & 7) * 64 + (y & 7) * 8 + (z & 7) AS slot FROM g1), b AS (SELECT ox, oy, oz, w, coalesce(sum(CAST(power(2, slot & 31) AS HUGEINT) * CASE WHEN slot & 32 = 32 THEN 4294967296 ELSE 1 END) FILTER (WHERE slot >> 6 = w), 0) AS n FROM s CROSS JOIN range(8) r(w) GROUP BY 1, 2, 3, 4) SELECT ox, oy, oz, CAST(w AS INT) AS word, CAST(CASE WHEN n > 9223372036854775807 THEN n - 18446744073709551616::HUGEINT ELSE n END AS BIGINT) AS bits FROM b")
def msk_words(spark, d):
    return G.leaves(g1(spark, d)).select("ox", "oy", "oz", F.posexplode("mask").alias("word", "bits"))


@query("udf_leaf_voxels", f"WITH {G2}, l AS (SELECT DISTINCT {LEAF1} FROM g2), s AS (SELECT CAST(ox + (k >> 6) AS INT) AS x, CAST(oy + (k >> 3 & 7) AS INT) AS y, CAST(oz + (k & 7) AS INT) AS z FROM l CROSS JOIN range(512) r(k)) SELECT s.x, s.y, s.z, coalesce(g.v, 0) AS value, g.v IS NOT NULL AS active FROM s LEFT JOIN g2 g ON g.x = s.x AND g.y = s.y AND g.z = s.z")
def udf_leaf_voxels(spark, d):
    return G.leaf_voxels(G.leaves(g2(spark, d))).withColumn("value", F.col("value").cast("double"))


@query("key_names", "SELECT n_nationkey AS id, n_name AS grid, n_name AS raw, 'float' AS value_type FROM nation")
def key_names(spark, d):
    unique, raw = F.concat("n_name", F.lit("\x1e"), "n_nationkey"), F.concat("n_name", F.lit("\x00rest")).cast("binary")
    return spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("id"), K.grid_name(unique).alias("grid"), K.c_string(raw).alias("raw"), K.value_type(F.lit("Tree_float_5_4_3_HalfFloat")).alias("value_type"))


# --- Filters and edits ------------------------------------------------------------------------------------------------


@query("flt_active_exact", f"WITH {G1} SELECT x, y, z, v AS value FROM g1 WHERE v <> 7")
def flt_active_exact(spark, d):
    return G.with_active(g1(spark, d), background=7.0).where("active").select(*K.AXES, "value")


@query("flt_active_threshold", f"WITH {G1} SELECT x, y, z, v AS value FROM g1 WHERE abs(v - 25) > 10")
def flt_active_threshold(spark, d):
    return G.with_active(g1(spark, d), background=25.0, threshold=10.0).where("active").select(*K.AXES, "value")


@query("flt_nonempty_leaves", f"WITH {G1} SELECT {LEAF1}, count(*) FILTER (WHERE abs(v - 25) > 20) AS active_count FROM g1 GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE abs(v - 25) > 20) > 0")
def flt_nonempty_leaves(spark, d):
    return G.leaves(G.with_active(g1(spark, d), 25.0, 20.0), 25.0).select("ox", "oy", "oz", "active_count")


@query("flt_region_bbox", f"WITH {G1} SELECT x, y, z, v AS value FROM g1 WHERE x BETWEEN -16 AND 40 AND y BETWEEN -8 AND 8 AND z BETWEEN -64 AND 63")
def flt_region_bbox(spark, d):
    return G.region(g1(spark, d), (-16, -8, -64), (40, 8, 63)).select(*K.AXES, "value")


for _p, _e in (("double", "v * 2"), ("half", "v * 0.5::DOUBLE"), ("negate", "-v"), ("clamp01", "least(greatest(v, 0.0::DOUBLE), 1.0::DOUBLE)"), ("expr", "v * v - 1")):
    query(f"flt_value_{_p}", f"WITH {G1} SELECT x, y, z, {_e} AS value FROM g1")(lambda s, d, p=_p: G.edit_values(g1(s, d), "value * value - 1" if p == "expr" else p).select(*K.AXES, "value"))


@query("flt_transform_world_bbox", f"WITH {G1} SELECT min(x) AS min_x, max(x) AS max_x, min(x) * 0.5::DOUBLE + 10 AS world_min_x, (max(x) + 1) * 0.5::DOUBLE + 10 AS world_max_x, (max(z) + 1) * 0.5::DOUBLE - 4 AS world_max_z FROM g1")
def flt_transform_world_bbox(spark, d):
    grid = G.node_stats(g1(spark, d), "root")
    moved = G.transform_grids(grid, matrix=K.scale_matrix([0.5] * 3, [10, 0, -4]))
    return moved.select("min_x", "max_x", "world_min_x", "world_max_x", "world_max_z")


@query("flt_normalise_u8", f"WITH {G1} SELECT x, y, z, CAST(floor(least(greatest((v - 10) / 30, 0), 1) * 255 + 0.5) AS INT) AS u8, CAST(floor(least(greatest(v * 7, 0), 255) + 0.5) AS INT) AS clamped FROM g1")
def flt_normalise_u8(spark, d):
    return g1(spark, d).select(*K.AXES, O.to_u8(F.col("value"), F.lit(10.0), F.lit(40.0)).alias("u8"), O.clamp_u8(F.col("value") * 7).alias("clamped"))


# --- Lookups ----------------------------------------------------------------------------------------------------------

PROBE = "p AS (SELECT o_orderkey AS probe_id, CAST(o_custkey % 600 AS INT) - 300 AS x, CAST(o_orderkey % 60 AS INT) - 30 AS y, CAST(o_custkey % 257 AS INT) - 128 AS z FROM orders)"
NO_TILES = "t AS (SELECT 1 AS level, 0 AS ox, 0 AS oy, 0 AS oz, 0.0::DOUBLE AS v, true AS a WHERE false)"
TILES = "t(level, ox, oy, oz, v, a) AS (VALUES (1, -304, -32, -128, 5.5::DOUBLE, true), (2, 256, 0, -128, 6.5::DOUBLE, false), (3, 0, -4096, 0, 7.5::DOUBLE, true))"


def _probes(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("probe_id"), ((F.col("o_custkey") % 600).cast("int") - 300).alias("x"), ((F.col("o_orderkey") % 60).cast("int") - 30).alias("y"), ((F.col("o_custkey") % 257).cast("int") - 128).alias("z"))


def _tiles(spark):
    return spark.createDataFrame([(1, -304, -32, -128, 5.5, True), (2, 256, 0, -128, 6.5, False), (3, 0, -4096, 0, 7.5, True)], "level int, ox int, oy int, oz int, value double, active boolean")


#: Which nodes there are, as the format has it: a lower node above each leaf or lower tile, an upper node above each of those or an upper tile.
NODES = "lo AS (SELECT DISTINCT x >> 7 AS x, y >> 7 AS y, z >> 7 AS z FROM g UNION SELECT ox >> 7, oy >> 7, oz >> 7 FROM t WHERE level = 1), up AS (SELECT DISTINCT x >> 12 AS x, y >> 12 AS y, z >> 12 AS z FROM g UNION SELECT ox >> 12, oy >> 12, oz >> 12 FROM t WHERE level < 3)"
RESOLVED = """b AS (SELECT DISTINCT x >> 3 AS x, y >> 3 AS y, z >> 3 AS z FROM g),
j AS (SELECT p.probe_id, g.v AS gv, b.x IS NOT NULL AS leaf, lo.x IS NOT NULL AS lower, up.x IS NOT NULL AS upper, t1.v AS v1, t1.a AS a1, t2.v AS v2, t2.a AS a2, t3.v AS v3, t3.a AS a3 FROM p
  LEFT JOIN g ON p.x = g.x AND p.y = g.y AND p.z = g.z
  LEFT JOIN b ON p.x >> 3 = b.x AND p.y >> 3 = b.y AND p.z >> 3 = b.z
  LEFT JOIN lo ON p.x >> 7 = lo.x AND p.y >> 7 = lo.y AND p.z >> 7 = lo.z
  LEFT JOIN up ON p.x >> 12 = up.x AND p.y >> 12 = up.y AND p.z >> 12 = up.z
  LEFT JOIN t t1 ON t1.level = 1 AND p.x >> 3 = t1.ox >> 3 AND p.y >> 3 = t1.oy >> 3 AND p.z >> 3 = t1.oz >> 3
  LEFT JOIN t t2 ON t2.level = 2 AND p.x >> 7 = t2.ox >> 7 AND p.y >> 7 = t2.oy >> 7 AND p.z >> 7 = t2.oz >> 7
  LEFT JOIN t t3 ON t3.level = 3 AND p.x >> 12 = t3.ox >> 12 AND p.y >> 12 = t3.oy >> 12 AND p.z >> 12 = t3.oz >> 12)
SELECT probe_id, CASE WHEN leaf THEN coalesce(gv, {0}) WHEN lower THEN coalesce(v1, {0}) WHEN upper THEN coalesce(v2, {0}) ELSE coalesce(v3, {0}) END AS value,
  CASE WHEN leaf THEN gv IS NOT NULL WHEN lower THEN coalesce(a1, false) WHEN upper THEN coalesce(a2, false) ELSE coalesce(a3, false) END AS active,
  CASE WHEN leaf THEN 0 WHEN lower THEN 1 WHEN upper THEN 2 WHEN v3 IS NOT NULL THEN 3 ELSE 4 END AS level FROM j"""


@query("join_read_value", f"WITH {G1}, {PROBE}, {NO_TILES}, g AS (SELECT * FROM g1), {NODES}, {RESOLVED.format('-1.0::DOUBLE')}")
def join_read_value(spark, d):
    return L.read_values(_probes(spark, d), G.leaves(G.with_active(g1(spark, d), -1.0), -1.0), -1.0).select("probe_id", "value", "active", "level")


@query("join_level_resolve", f"WITH {G1}, {PROBE}, {TILES}, g AS (SELECT * FROM g1 WHERE x < 0), {NODES}, {RESOLVED.format('0.25::DOUBLE')}")
def join_level_resolve(spark, d):
    half = G.with_active(g1(spark, d).where("x < 0").drop("active"), 0.25)
    return L.read_values(_probes(spark, d), G.leaves(half, 0.25), 0.25, _tiles(spark)).select("probe_id", "value", "active", "level")


POINT = "p AS (SELECT o_orderkey AS probe_id, CAST(o_custkey % 240 AS DOUBLE) / 4 - 30 AS x, CAST(o_orderkey % 200 AS DOUBLE) / 4 - 24 AS y, CAST((o_custkey + o_orderkey) % 44 AS DOUBLE) / 4 - 5 AS z FROM orders)"


def _points(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return o.select(k.alias("probe_id"), ((c % 240).cast("double") / 4 - 30).alias("x"), ((k % 200).cast("double") / 4 - 24).alias("y"), (((c + k) % 44).cast("double") / 4 - 5).alias("z"))


@query("join_trilinear", f"WITH {G2}, {POINT}, f AS (SELECT p.*, dx, dy, dz, coalesce(g.v, 0) AS gv FROM p CROSS JOIN (VALUES (0), (1)) a(dx) CROSS JOIN (VALUES (0), (1)) b(dy) CROSS JOIN (VALUES (0), (1)) c(dz) LEFT JOIN g2 g ON g.x = CAST(floor(p.x) AS INT) + dx AND g.y = CAST(floor(p.y) AS INT) + dy AND g.z = CAST(floor(p.z) AS INT) + dz), e AS (SELECT probe_id, x - floor(x) AS fx, y - floor(y) AS fy, z - floor(z) AS fz, max(CASE WHEN dx = 0 AND dy = 0 AND dz = 0 THEN gv END) AS v0, max(CASE WHEN dx = 1 AND dy = 0 AND dz = 0 THEN gv END) AS v1, max(CASE WHEN dx = 0 AND dy = 1 AND dz = 0 THEN gv END) AS v2, max(CASE WHEN dx = 1 AND dy = 1 AND dz = 0 THEN gv END) AS v3, max(CASE WHEN dx = 0 AND dy = 0 AND dz = 1 THEN gv END) AS v4, max(CASE WHEN dx = 1 AND dy = 0 AND dz = 1 THEN gv END) AS v5, max(CASE WHEN dx = 0 AND dy = 1 AND dz = 1 THEN gv END) AS v6, max(CASE WHEN dx = 1 AND dy = 1 AND dz = 1 THEN gv END) AS v7 FROM f GROUP BY probe_id, x, y, z), q AS (SELECT probe_id, fz, (v0 + (v1 - v0) * fx) + ((v2 + (v3 - v2) * fx) - (v0 + (v1 - v0) * fx)) * fy AS c0, (v4 + (v5 - v4) * fx) + ((v6 + (v7 - v6) * fx) - (v4 + (v5 - v4) * fx)) * fy AS c1 FROM e) SELECT probe_id, c0 + (c1 - c0) * fz AS value FROM q")
def join_trilinear(spark, d):
    return L.sample_trilinear(_points(spark, d), G.leaves(g2(spark, d))).select("probe_id", "value")


@query("join_nearest", f"WITH {G2}, {POINT} SELECT probe_id, coalesce(g.v, 0) AS value, g.v IS NOT NULL AS active FROM p LEFT JOIN g2 g ON g.x = CAST(floor(p.x + 0.5) AS INT) AND g.y = CAST(floor(p.y + 0.5) AS INT) AND g.z = CAST(floor(p.z + 0.5) AS INT)")
def join_nearest(spark, d):
    return L.sample_nearest(_points(spark, d), G.leaves(g2(spark, d))).select("probe_id", "value", "active")


@query("join_parity", f"WITH {G1} SELECT count(*) AS n, CAST(0 AS BIGINT) AS mismatches, 0.0::DOUBLE AS max_error FROM g1")
def join_parity(spark, d):
    v = g1(spark, d).withColumn("probe_id", F.concat_ws(",", *K.AXES))
    return L.compare(v.select("probe_id", "value", "active"), L.read_values(v.select("probe_id", *K.AXES), G.leaves(g1(spark, d))).select("probe_id", "value", "active"))


@query("ray_zslice_gray", f"WITH {G2}, c AS (SELECT g.x - 30 AS x, h.y - 24 AS y FROM range(60) g(x) CROSS JOIN range(50) h(y)), r AS (SELECT c.x, c.y, coalesce(g.v, 0) AS value, g.v IS NOT NULL AS active FROM c LEFT JOIN g2 g ON g.x = c.x AND g.y = c.y AND g.z = 1), s AS (SELECT min(value) AS lo, max(value) AS hi FROM r WHERE active) SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, value, active, CASE WHEN active THEN CAST(floor((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 255 + 0.5) AS INT) ELSE 0 END AS gray FROM r, s")
def ray_zslice_gray(spark, d):
    return L.slice_z(spark, G.leaves(g2(spark, d)), 1, LOW2, HIGH2)


# --- Aggregates -------------------------------------------------------------------------------------------------------

STATS = "count(*) AS n, sum(v) AS vsum, sum(v * v) AS vsq, min(v) AS vmin, max(v) AS vmax, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z"
AT = {n: f"(x >> {b}) * {1 << b} AS ox, (y >> {b}) * {1 << b} AS oy, (z >> {b}) * {1 << b} AS oz" for n, b in (("leaf", 3), ("lower", 7), ("upper", 12))}
for _l in ("leaf", "lower", "upper"):
    query(f"agg_{_l}_stats", f"WITH {G1} SELECT {AT[_l]}, {STATS} FROM g1 GROUP BY 1, 2, 3")(lambda s, d, level=_l: G.node_stats(g1(s, d), level))


@query("agg_root_stats", f"WITH {G1} SELECT {STATS}, round(sum(v) / count(*), 6) AS average, round(sqrt(greatest(sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)), 0)), 6) AS std_dev FROM g1")
def agg_root_stats(spark, d):
    out = G.with_moments(G.node_stats(g1(spark, d), "root"))
    return out.withColumn("average", F.round("average", 6)).withColumn("std_dev", F.round("std_dev", 6))


@query("agg_grouping_sets_stats", f"WITH {G1} " + " UNION ALL ".join(f"SELECT '{n}' AS level, {a}, {STATS} FROM g1 GROUP BY 2, 3, 4" for n, a in AT.items()) + f" UNION ALL SELECT 'root', 0, 0, 0, {STATS} FROM g1")
def agg_grouping_sets_stats(spark, d):
    return G.hierarchy_stats(g1(spark, d)).fillna(0, ["ox", "oy", "oz"])


@query("agg_histogram256", f"WITH {G1}, s AS (SELECT min(v) AS lo, max(v) AS hi FROM g1), h AS (SELECT CAST(least(floor(least(greatest((v - lo) / greatest(hi - lo, 1e-20), 0), 1) * 256), 255) AS INT) AS bin, count(*) AS n FROM g1, s GROUP BY 1) SELECT CAST(r.i AS INT) AS bin, coalesce(h.n, 0) AS n FROM range(256) r(i) LEFT JOIN h ON h.bin = r.i")
def agg_histogram256(spark, d):
    return G.histogram(g1(spark, d))


@query("agg_hist_observed_range", f"WITH {G1}, {PROBE}, q AS (SELECT g.v FROM p JOIN g1 g ON p.x = g.x AND p.y = g.y AND p.z = g.z), s AS (SELECT min(v) AS lo, max(v) AS hi FROM q), h AS (SELECT CAST(least(floor(least(greatest((v - lo) / greatest(hi - lo, 1e-20), 0), 1) * 64), 63) AS INT) AS bin, count(*) AS n FROM q, s GROUP BY 1) SELECT CAST(r.i AS INT) AS bin, coalesce(h.n, 0) AS n FROM range(64) r(i) LEFT JOIN h ON h.bin = r.i")
def agg_hist_observed_range(spark, d):
    return G.histogram(L.read_values(_probes(spark, d), G.leaves(g1(spark, d))), 64)


@query("agg_node_counts", f"WITH {G1} SELECT count(DISTINCT (x >> 3, y >> 3, z >> 3)) AS leaf, count(DISTINCT (x >> 7, y >> 7, z >> 7)) AS lower, count(DISTINCT (x >> 12, y >> 12, z >> 12)) AS upper FROM g1")
def agg_node_counts(spark, d):
    return G.node_counts(G.leaves(g1(spark, d)))


@query("agg_inspect_memory", f"WITH {G1}, c AS (SELECT count(DISTINCT (x >> 3, y >> 3, z >> 3)) AS leaf, count(DISTINCT (x >> 7, y >> 7, z >> 7)) AS lower, count(DISTINCT (x >> 12, y >> 12, z >> 12)) AS upper, count(*) AS voxel_count FROM g1) SELECT leaf, lower, upper, leaf * 2144 AS leaf_bytes, voxel_count, 672 AS grid_bytes, 64 AS tree_bytes, 64 + upper * 32 AS root_bytes, upper * 270400 AS upper_bytes, lower * 33856 AS lower_bytes, 672 + 64 + 64 + upper * 32 + upper * 270400 + lower * 33856 + leaf * 2144 AS total_bytes FROM c")
def agg_inspect_memory(spark, d):
    return G.inspect(G.leaves(g1(spark, d)))


@query("agg_memory_shares", f"WITH {G1}, c AS (SELECT count(DISTINCT (x >> 3, y >> 3, z >> 3)) * 2144 AS leaf, count(DISTINCT (x >> 7, y >> 7, z >> 7)) * 33856 AS lower, count(DISTINCT (x >> 12, y >> 12, z >> 12)) * 270400 AS upper FROM g1), u AS (SELECT 'leaf_bytes' AS part, leaf AS amount FROM c UNION ALL SELECT 'lower_bytes', lower FROM c UNION ALL SELECT 'upper_bytes', upper FROM c) SELECT part, amount, round(amount / sum(amount) OVER (), 9) AS share FROM u")
def agg_memory_shares(spark, d):
    return G.shares(G.inspect(G.leaves(g1(spark, d))), ["leaf_bytes", "lower_bytes", "upper_bytes"]).withColumn("share", F.round("share", 9))


@query("agg_leaf_minmax_all", f"WITH {G1} SELECT {LEAF1}, CASE WHEN count(*) < 512 THEN least(min(v), 0) ELSE min(v) END AS lo, max(v) AS hi FROM g1 GROUP BY 1, 2, 3")
def agg_leaf_minmax_all(spark, d):
    lo, hi = C.limits(F.col("values"))
    return G.leaves(g1(spark, d)).select("ox", "oy", "oz", lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


@query("agg_grid_stats_tiles", f"WITH {G1} SELECT count(*) + 512 + 4096 * 4096::BIGINT * 4096 AS active_count, least(min(v), 5.5) AS vmin, greatest(max(v), 7.5) AS vmax FROM g1")
def agg_grid_stats_tiles(spark, d):
    return G.grid_stats(g1(spark, d), _tiles(spark)).select("active_count", "vmin", "vmax")


@query("agg_grid_stats_region", f"WITH {G2} SELECT count(*) AS active_count, min(v) AS vmin, max(v) AS vmax, round(sum(v) / count(*), 6) AS mean, min(v) >= 0 AS used_fast_path FROM g2 WHERE x BETWEEN -10 AND 10 AND y BETWEEN -5 AND 20 AND z BETWEEN -3 AND 3")
def agg_grid_stats_region(spark, d):
    return G.grid_stats(g2(spark, d), low=(-10, -5, -3), high=(10, 20, 3)).withColumn("mean", F.round("mean", 6))


@query("agg_frames_differ", f"WITH {G3}, h AS (SELECT frame, string_agg(x || ',' || y || ',' || v, ';' ORDER BY x, y) AS h FROM g3 GROUP BY 1) SELECT count(DISTINCT h) > 1 AS differ, count(*) AS frames FROM h")
def agg_frames_differ(spark, d):
    return S.frames_differ(G.with_active(g3(spark, d)))


@query("agg_stats_per_grid", f"WITH {G1}, {G2}, u AS (SELECT 'a' AS grid, * FROM g1 UNION ALL SELECT 'b', * FROM g2) SELECT grid, {AT['lower']}, {STATS} FROM u GROUP BY 1, 2, 3, 4")
def agg_stats_per_grid(spark, d):
    both = g1(spark, d).withColumn("grid", F.lit("a")).unionByName(g2(spark, d).withColumn("grid", F.lit("b")))
    return G.node_stats(both, "lower", ["grid"])


@query("agg_slice_range", f"WITH {G2} SELECT min(v) AS lo, max(v) AS hi, count(*) > 0 AS non_empty FROM g2 WHERE z = 1")
def agg_slice_range(spark, d):
    rows = L.slice_z(spark, G.leaves(g2(spark, d)), 1, LOW2, HIGH2).where("active")
    return rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), (F.count("*") > 0).alias("non_empty"))


@query("agg_child_counts", f"WITH {G1} SELECT 'lower' AS level, {AT['lower']}, count(DISTINCT (x >> 3, y >> 3, z >> 3)) AS children FROM g1 GROUP BY 2, 3, 4 UNION ALL SELECT 'upper', {AT['upper']}, count(DISTINCT (x >> 7, y >> 7, z >> 7)) FROM g1 GROUP BY 2, 3, 4")
def agg_child_counts(spark, d):
    return G.child_counts(G.leaves(g1(spark, d)))


# --- Layout -----------------------------------------------------------------------------------------------------------

ORDER = "(x >> 12), (y >> 12), (z >> 12), ((x & 4095) >> 7) * 1024 + ((y & 4095) >> 7) * 32 + ((z & 4095) >> 7), ((x & 127) >> 3) * 256 + ((y & 127) >> 3) * 16 + ((z & 127) >> 3)"
RANKED = f"l AS (SELECT (x >> 3) * 8 AS x, (y >> 3) * 8 AS y, (z >> 3) * 8 AS z, count(*) AS n FROM g1 GROUP BY 1, 2, 3), r AS (SELECT x AS ox, y AS oy, z AS oz, n, row_number() OVER (ORDER BY {ORDER}) - 1 AS mem_index FROM l)"


@query("win_mem_index", f"WITH {G1}, {RANKED} SELECT ox, oy, oz, mem_index FROM r")
def win_mem_index(spark, d):
    return G.mem_index(G.leaves(g1(spark, d))).select("ox", "oy", "oz", "mem_index")


@query("win_leaf_offset", f"WITH {G1}, {RANKED} SELECT ox, oy, oz, mem_index, CAST(coalesce(sum(96 + 64 * (1 + n % 3)) OVER (ORDER BY mem_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS leaf_offset FROM r")
def win_leaf_offset(spark, d):
    ranked = G.mem_index(G.leaves(g1(spark, d)))
    return G.with_offsets(ranked, 96 + 64 * (1 + F.col("active_count") % 3)).select("ox", "oy", "oz", "mem_index", "leaf_offset")


@query("win_block_offsets", f"WITH {G1}, c AS (SELECT count(DISTINCT (x >> 7, y >> 7, z >> 7)) AS lower, count(DISTINCT (x >> 12, y >> 12, z >> 12)) AS upper FROM g1) SELECT 672 AS tree_at, 736 AS root_at, 800 + 32 * upper AS upper_at, 800 + 32 * upper + 270400 * upper AS lower_at, 800 + 32 * upper + 270400 * upper + 33856 * lower AS leaf_at FROM c")
def win_block_offsets(spark, d):
    return G.block_offsets(G.inspect(G.leaves(g1(spark, d)))).select("tree_at", "root_at", "upper_at", "lower_at", "leaf_at")


@query("win_slice_stride", f"WITH {G2}, c AS (SELECT CAST(a.i * 4 - 30 AS INT) AS x, CAST(b.j * 4 - 24 AS INT) AS y FROM range(15) a(i) CROSS JOIN range(13) b(j)) SELECT c.x, c.y, coalesce(g.v, 0) AS value, g.v IS NOT NULL AS active FROM c LEFT JOIN g2 g ON g.x = c.x AND g.y = c.y AND g.z = -2")
def win_slice_stride(spark, d):
    return L.slice_z(spark, G.leaves(g2(spark, d)), -2, LOW2, HIGH2, most=16).select("x", "y", "value", "active")


@query("win_first_k_leaves", f"WITH {G1}, {RANKED} SELECT ox, oy, oz, mem_index, (SELECT count(*) FROM r) AS total FROM r WHERE mem_index < 50")
def win_first_k_leaves(spark, d):
    return G.first_leaves(G.mem_index(G.leaves(g1(spark, d))), 50).select("ox", "oy", "oz", "mem_index", "total")


@query("win_first_active_samples", f"WITH {G1} SELECT x, y, z, v AS value FROM g1 WHERE (x + 256) % 4 = 0 AND (z + 128) % 4 = 0 ORDER BY x, y, z LIMIT 20")
def win_first_active_samples(spark, d):
    rows = g1(spark, d).where((F.pmod(F.col("x") + 256, F.lit(4)) == 0) & (F.pmod(F.col("z") + 128, F.lit(4)) == 0))
    return rows.orderBy(*K.AXES).limit(20).select(*K.AXES, "value")


STEPS = "s AS (SELECT l_orderkey AS ray_id, l_linenumber AS step, 1 - exp(-max(l_quantity) / 50 * 0.5) AS a, max(l_tax) + 0.1 AS lit FROM lineitem GROUP BY 1, 2)"


@query("win_compositing", f"WITH {STEPS}, t AS (SELECT ray_id, step, a, lit, coalesce(exp(sum(ln(1 - a)) OVER (PARTITION BY ray_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS t FROM s) SELECT ray_id, round(sum(t * a * lit), 6) AS colour FROM t WHERE t >= 0.003 GROUP BY 1")
def win_compositing(spark, d):
    s = _lineitem(spark, d).groupBy(F.col("l_orderkey").alias("ray_id"), F.col("l_linenumber").alias("step")).agg((1 - F.exp(-F.max("l_quantity") / 50 * 0.5)).alias("a"), (F.max("l_tax") + 0.1).alias("lit"))
    return R.composite(s).select("ray_id", F.round("colour", 6).alias("colour"))


# --- Sets and codecs --------------------------------------------------------------------------------------------------


@query("set_tiles_union_leaves", f"WITH {G1} SELECT {LEAF1}, count(*) AS active_count FROM g1 GROUP BY 1, 2, 3 UNION ALL SELECT -304, -32, -128, 512 UNION ALL SELECT CAST(1024 + (k >> 8 & 15) * 8 AS INT), CAST((k >> 4 & 15) * 8 AS INT), CAST(-128 + (k & 15) * 8 AS INT), 512 FROM range(4096) r(k)")
def set_tiles_union_leaves(spark, d):
    tiles = _tiles(spark).where("level = 1").unionByName(spark.createDataFrame([(2, 1024, 0, -128, 2.0, True)], "level int, ox int, oy int, oz int, value double, active boolean"))
    return G.all_leaves(G.leaves(g1(spark, d)), tiles).select("ox", "oy", "oz", "active_count")


@query("set_collapse_constant", f"WITH {G2} SELECT (x >> 3) * 8 AS ox, (y >> 3) * 8 AS oy, (z >> 3) * 8 AS oz FROM g2 GROUP BY 1, 2, 3 HAVING count(*) = 512 AND min(least(v, 0)) = max(least(v, 0))")
def set_collapse_constant(spark, d):
    return G.constant_leaves(G.leaves(g2(spark, d).withColumn("value", F.least(F.col("value"), F.lit(0.0))))).select("ox", "oy", "oz")


@query("set_merge_max", f"WITH {G1}, {G2} SELECT coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(a.z, b.z) AS z, greatest(coalesce(a.v, b.v), coalesce(b.v, a.v)) AS value FROM g1 a FULL JOIN g2 b ON a.x = b.x AND a.y = b.y AND a.z = b.z")
def set_merge_max(spark, d):
    return G.merge_grids(g1(spark, d), g2(spark, d)).select(*K.AXES, "value")


FULL = f"WITH {G2}, f AS (SELECT l.ox, l.oy, l.oz, CAST(coalesce(g.v, 0) AS FLOAT) AS v FROM (SELECT DISTINCT (x >> 3) * 8 AS ox, (y >> 3) * 8 AS oy, (z >> 3) * 8 AS oz FROM g2) l CROSS JOIN range(512) s(k) LEFT JOIN g2 g ON g.x = l.ox + (k >> 6 & 7) AND g.y = l.oy + (k >> 3 & 7) AND g.z = l.oz + (k & 7)), m AS (SELECT ox, oy, oz, min(v) AS lo, max(v) AS hi FROM f GROUP BY 1, 2, 3)"
FL = "CAST({} AS FLOAT)".format


@query("cod_fp8_codes", f"{FULL} SELECT f.ox, f.oy, f.oz, CAST(sum(CAST(least(greatest(floor(CAST(CAST(CASE WHEN hi > lo THEN CAST(CAST(255 AS DOUBLE) / CAST(CAST(hi - lo AS FLOAT) AS DOUBLE) AS FLOAT) ELSE CAST(0 AS FLOAT) END * CAST(v - lo AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT) AS FLOAT)), 0), 255) AS BIGINT)) AS BIGINT) AS code_sum FROM f JOIN m USING (ox, oy, oz) GROUP BY 1, 2, 3")
def cod_fp8_codes(spark, d):
    coded = C.quantize(G.leaves(g2(spark, d)), "fp8")
    return coded.select("ox", "oy", "oz", F.aggregate("codes", F.lit(0).cast("long"), lambda s, c: s + c).alias("code_sum"))


@query("cod_fp8_roundtrip_error", f"{FULL} SELECT ox, oy, oz, true AS within FROM m")
def cod_fp8_roundtrip_error(spark, d):
    leaf = G.leaves(g2(spark, d))
    back = C.dequantize(C.quantize(leaf, "fp8")).withColumnRenamed("values", "decoded")
    both = leaf.select("ox", "oy", "oz", "values").join(back.select("ox", "oy", "oz", "decoded", "quantum"), ["ox", "oy", "oz"])
    err = F.array_max(F.zip_with("values", "decoded", lambda a, b: F.abs(a.cast("double") - b)))
    return both.select("ox", "oy", "oz", (err <= 0.5 * F.col("quantum") + 1e-5).alias("within"))


def _fits(bits: int) -> str:
    top = (1 << bits) - 1
    scale = FL(f"CAST({top} AS DOUBLE) / CAST(CAST(hi - lo AS FLOAT) AS DOUBLE)")
    quantum = FL(f"CAST(CAST(hi - lo AS FLOAT) AS DOUBLE) / {top}")
    code = FL(f"floor(CAST(CAST({scale} * CAST(v - lo AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT) AS FLOAT))")
    return f"bool_and(abs(CAST(v - CAST(CAST({code} * {quantum} AS FLOAT) + lo AS FLOAT) AS FLOAT)) <= CAST(0.01 AS FLOAT))"


@query("cod_fpn_bitwidth_hist", f"{FULL}, w AS (SELECT f.ox, f.oy, f.oz, CASE WHEN min(lo) = max(hi) THEN 1 {' '.join(f'WHEN {_fits(b)} THEN {b}' for b in (1, 2, 4, 8))} ELSE 16 END AS bits FROM f JOIN m USING (ox, oy, oz) GROUP BY 1, 2, 3) SELECT bits, count(*) AS n FROM w GROUP BY 1")
def cod_fpn_bitwidth_hist(spark, d):
    return C.quantize(G.leaves(g2(spark, d)), "fpn", 0.01).groupBy("bits").agg(F.count("*").alias("n"))


@query("cod_fpn_codes", f"{FULL}, w AS (SELECT f.ox, f.oy, f.oz, CASE WHEN min(lo) = max(hi) THEN 1 {' '.join(f'WHEN {_fits(b)} THEN {b}' for b in (1, 2, 4, 8))} ELSE 16 END AS bits FROM f JOIN m USING (ox, oy, oz) GROUP BY 1, 2, 3), t AS (SELECT f.*, lo, bits, (1 << bits) - 1 AS top, CASE WHEN hi > lo THEN CAST((1 << bits) - 1 AS DOUBLE) / CAST(CAST(hi - lo AS FLOAT) AS DOUBLE) ELSE 0 END AS scale FROM f JOIN m USING (ox, oy, oz) JOIN w USING (ox, oy, oz)), k AS (SELECT ox, oy, oz, bits, CAST(least(greatest(CASE WHEN bits = 16 THEN floor(scale * (CAST(v AS DOUBLE) - CAST(lo AS DOUBLE)) + 0.5) ELSE floor(CAST(CAST(CAST(scale AS FLOAT) * CAST(v - lo AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT) AS FLOAT)) END, 0), top) AS BIGINT) AS code FROM t) SELECT ox, oy, oz, bits, CAST(sum(code) AS BIGINT) AS code_sum FROM k GROUP BY 1, 2, 3, 4")
def cod_fpn_codes(spark, d):
    coded = C.quantize(G.leaves(g2(spark, d)), "fpn", 0.01)
    return coded.select("ox", "oy", "oz", "bits", F.aggregate("codes", F.lit(0).cast("long"), lambda s, c: s + c).alias("code_sum"))


@query("cod_stat_u16", f"WITH {G1} SELECT {LEAF1}, CAST(least(greatest(floor((sum(v) / count(*) - min(v)) * (1 / 0.25::DOUBLE) + 0.5), 0), 65535) AS INT) AS average_u16 FROM g1 GROUP BY 1, 2, 3")
def cod_stat_u16(spark, d):
    s = G.with_moments(G.node_stats(g1(spark, d)))
    return s.select("ox", "oy", "oz", C.stat_u16(F.col("average"), F.col("vmin"), F.lit(0.25)).alias("average_u16"))


@query("cod_effective_background", "SELECT 6.5::DOUBLE AS background")
def cod_effective_background(spark, d):
    return G.effective_background(_tiles(spark), 0.0)


@query("cod_build_from_dense", "SELECT CAST(sum(8 * ceil(n / 8.0)) AS BIGINT) AS voxels, CAST(sum(a) AS BIGINT) AS active FROM (SELECT l_orderkey // 4 AS b, count(*) AS n, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS a FROM lineitem GROUP BY 1)")
def cod_build_from_dense(spark, d):
    """Every line item is a voxel of a dense block of 2 x 2 x 2; the last block of four orders is filled up with background."""
    w = W.partitionBy("b").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = _lineitem(spark, d).withColumn("b", F.expr("l_orderkey div 4")).select("b", "l_quantity", (F.row_number().over(w) - 1).alias("r"))
    blocks = rows.groupBy("b", F.expr("r div 8").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "l_quantity"))), lambda s: s["l_quantity"]).alias("some"))
    blocks = blocks.select("b", F.concat("some", F.array_repeat(F.lit(0.0), 8 - F.size("some"))).alias("values"), F.array(*[F.lit(2)] * 3).alias("dims"), F.array(*[F.lit(-1)] * 3).alias("origin"))
    v = G.from_dense(blocks).withColumn("active", F.col("value") > 25)
    return v.agg(F.count("*").alias("voxels"), F.count_if("active").alias("active"))


# --- Rays -------------------------------------------------------------------------------------------------------------


def _rays(spark, d):
    """A ray along y for every order; those beside the box miss it."""
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(k.alias("ray_id"), ((k % 80) - 40 + 0.5).alias("ox"), (F.lit(-60.0) - k % 7).alias("oy"), ((k % 11) - 5 + 0.25).alias("oz"), F.lit(0.0).alias("dx"), F.lit(2.0).alias("dy"), F.lit(0.0).alias("dz"))


HIT = "h AS (SELECT o_orderkey AS ray_id, 36.0::DOUBLE + o_orderkey % 7 AS t0, 86.0::DOUBLE + o_orderkey % 7 AS t1 FROM orders WHERE o_orderkey % 80 BETWEEN 10 AND 69)"


@query("ray_clip_bbox", f"WITH {HIT} SELECT ray_id, t0, t1 FROM h")
def ray_clip_bbox(spark, d):
    return R.clip(_rays(spark, d), LOW2, HIGH2).select("ray_id", "t0", "t1")


@query("ray_march_steps", f"WITH {HIT} SELECT ray_id, count(*) AS steps, max(t0 + s * 0.75::DOUBLE) AS last_t FROM h CROSS JOIN range(0, 67) r(s) GROUP BY 1")
def ray_march_steps(spark, d):
    return R.march(R.clip(_rays(spark, d), LOW2, HIGH2), 0.75, 512).groupBy("ray_id").agg(F.count("*").alias("steps"), F.max("t").alias("last_t"))


def _camera(spark, d):
    """A ray along y for every column (x, z) that G2 holds, as a camera has one for every pixel."""
    at = g2(spark, d).select("x", "z").distinct()
    return at.select(((F.col("x") + 30) * 11 + F.col("z") + 5).cast("long").alias("ray_id"), (F.col("x") + 0.5).alias("ox"), F.lit(-60.0).alias("oy"), (F.col("z") + 0.25).alias("oz"), F.lit(0.0).alias("dx"), F.lit(2.0).alias("dy"), F.lit(0.0).alias("dz"))


def _march(spark, d):
    """(probe_id, ray_id, step, t, x, y, z) of the camera's rays."""
    rows = R.march(R.clip(_camera(spark, d), LOW2, HIGH2), 0.75, 512)
    return rows.select((F.col("ray_id") * 1000 + F.col("step")).alias("probe_id"), "ray_id", "step", "t", *K.AXES)


CAMERA = "c AS (SELECT ray_id * 1000 + i AS probe_id, ray_id, CAST(i AS INT) AS step, 36 + i * 0.75::DOUBLE AS t, px AS x, -24 + i * 0.75::DOUBLE AS y, pz AS z FROM (SELECT DISTINCT CAST((x + 30) * 11 + z + 5 AS BIGINT) AS ray_id, x + 0.5::DOUBLE AS px, z + 0.25::DOUBLE AS pz FROM g2) CROSS JOIN range(67) r(i))"


def _sampled(out: str, points: str) -> str:
    """SQL of the table `out`: points (probe_id, x, y, z, ...) with the trilinear value of G2."""
    mix = "({0} + ({1} - {0}) * {2})".format
    low, high = (mix(mix(f"v{k}", f"v{k + 1}", "fx"), mix(f"v{k + 2}", f"v{k + 3}", "fx"), "fy") for k in (0, 4))
    taps = ", ".join(f"max(gv) FILTER (WHERE k = {k}) AS v{k}" for k in range(8))
    near = " AND ".join(f"g.{a} = CAST(floor(p.{a}) AS INT) + CAST(k >> {i} & 1 AS INT)" for i, a in enumerate(K.AXES))
    part = ", ".join(f"{a} - floor({a}) AS f{a}" for a in K.AXES)
    return f"{out}_taps AS (SELECT probe_id, {taps} FROM (SELECT p.probe_id, k, coalesce(g.v, 0) AS gv FROM {points} p CROSS JOIN range(8) r(k) LEFT JOIN g2 g ON {near}) GROUP BY 1), {out} AS (SELECT *, {mix(low, high, 'fz')} AS value FROM (SELECT *, {part} FROM {points}) JOIN {out}_taps USING (probe_id))"


@query("ray_render", f"WITH {G2}, {CAMERA}, {_sampled('v', 'c')}, l AS (SELECT probe_id * 8 + k AS probe_id, probe_id AS step_id, x, y + k * 0.75::DOUBLE AS y, z FROM v CROSS JOIN range(1, 5) r(k) WHERE value > 0), {_sampled('w', 'l')}, d AS (SELECT step_id, exp(-sum(greatest(value, 0) * 0.002 * 0.8 * 0.75)) AS light FROM w GROUP BY 1), s AS (SELECT ray_id, step, 1 - exp(-value * 0.002 * 0.75) AS a, 0.15 + 3 * light * 0.91 / (4 * pi() * power(0.49, 1.5)) AS lit FROM v JOIN d ON v.probe_id = d.step_id WHERE value > 0), t AS (SELECT *, coalesce(exp(sum(ln(1 - a)) OVER (PARTITION BY ray_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS t FROM s) SELECT ray_id, round(sum(t * a * lit), 6) AS colour, CAST(count(*) AS INT) AS used FROM t WHERE t >= 0.003 GROUP BY 1")
def ray_render(spark, d):
    return R.render(_camera(spark, d), G.leaves(g2(spark, d)), LOW2, HIGH2, O.Material(density_scale=0.002, shadow_density=0.8, shadow_steps=4)).select("ray_id", F.round("colour", 6).alias("colour"), "used")


@query("ray_zero_crossing", f"WITH {G2}, {CAMERA}, {_sampled('v', 'c')}, s AS (SELECT ray_id, step, t, value, sign(value - 25) <> lag(sign(value - 25)) OVER (PARTITION BY ray_id ORDER BY step) AS hit FROM v) SELECT ray_id, min(step) AS step, min(t) AS t_hit, arg_min(value, step) AS v_hit FROM s WHERE hit GROUP BY 1")
def ray_zero_crossing(spark, d):
    read = L.sample_trilinear(_march(spark, d), G.leaves(g2(spark, d)))
    return R.first_crossing(read, 25.0)


@query("ray_skip_empty", f"WITH {G2}, {CAMERA}, b AS (SELECT DISTINCT x >> 3 AS bx, y >> 3 AS by_, z >> 3 AS bz FROM g2 WHERE v > 49) SELECT ray_id, count(DISTINCT probe_id) AS kept FROM c JOIN b ON CAST(floor(c.x) AS INT) >> 3 BETWEEN bx - 1 AND bx AND CAST(floor(c.y) AS INT) >> 3 BETWEEN by_ - 1 AND by_ AND CAST(floor(c.z) AS INT) >> 3 BETWEEN bz - 1 AND bz GROUP BY 1")
def ray_skip_empty(spark, d):
    leaf = G.leaves(g2(spark, d).where("value > 49"))
    return R.near_leaves(_march(spark, d), leaf).groupBy("ray_id").agg(F.count("*").alias("kept"))


@query("ray_hg_phase", "SELECT l_orderkey, l_linenumber, round((1 - 0.09) / (4 * pi() * power(greatest(1.09 - 0.6 * (l_discount * 20 - 1), 1e-4), 1.5)), 6) AS phase, round(1 - exp(-greatest(l_tax, 0) * 40 * 0.75), 6) AS a FROM lineitem")
def ray_hg_phase(spark, d):
    cos = F.col("l_discount") * 20 - 1
    return _lineitem(spark, d).select("l_orderkey", "l_linenumber", F.round(O.henyey_greenstein(cos, 0.3), 6).alias("phase"), F.round(O.opacity(F.col("l_tax"), 40.0, 0.75), 6).alias("a"))


@query("ray_atlas_nearest", f"WITH {G2}, c AS (SELECT i, j, k, CAST(floor(-30 + (i + 0.5) / 20 * 60 + 0.5) AS INT) AS x, CAST(floor(-24 + (j + 0.5) / 20 * 50 + 0.5) AS INT) AS y, CAST(floor(-5 + (k + 0.5) / 11 * 11 + 0.5) AS INT) AS z FROM range(20) a(i) CROSS JOIN range(20) b(j) CROSS JOIN range(11) e(k)) SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y, CAST(k AS INT) AS z, CAST(floor(least(greatest(coalesce(g.v, 0) / 50, 0), 1) * 255 + 0.5) AS INT) AS value FROM c LEFT JOIN g2 g ON g.x = c.x AND g.y = c.y AND g.z = c.z")
def ray_atlas_nearest(spark, d):
    return L.atlas(spark, G.leaves(g2(spark, d)), LOW2, HIGH2, most=20, filter="nearest", span=(0.0, 50.0))


CELL = "CAST(floor({lo} + ({i} + 0.5::DOUBLE) / {n} * {size} + 0.5) AS INT)".format


@query("ray_atlas_u8", f"WITH {G2}, c AS (SELECT i + 32 * j + 1024 * k AS probe_id, -30 + (i + 0.5::DOUBLE) / 32 * 60 AS x, -24 + (j + 0.5::DOUBLE) / 32 * 50 AS y, -5 + (k + 0.5::DOUBLE) / 11 * 11 AS z FROM range(32) a(i) CROSS JOIN range(32) b(j) CROSS JOIN range(11) e(k)), {_sampled('v', 'c')} SELECT CAST(probe_id % 32 AS INT) AS x, CAST(probe_id // 32 % 32 AS INT) AS y, CAST(probe_id // 1024 AS INT) AS z, CAST(floor(least(greatest(value / 50, 0), 1) * 255 + 0.5) AS INT) AS value FROM v")
def ray_atlas_u8(spark, d):
    return L.atlas(spark, G.leaves(g2(spark, d)), LOW2, HIGH2, most=32, span=(0.0, 50.0))


_UVW = {"i": ("x", 30, 60, 16), "j": ("y", 24, 50, 16), "k": ("z", 5, 11, 11)}
_POS = ", ".join(f"least(greatest((p.{a} + {o}) / {s}, 0), 1) * {n} - 0.5::DOUBLE AS {i}" for i, (a, o, s, n) in _UVW.items())
_TAP = ", ".join(f"least(greatest(CAST(floor({i}) AS INT) + CAST(tap >> {b} & 1 AS INT), 0), {n - 1}) AS c{i}" for b, (i, (_, _, _, n)) in enumerate(_UVW.items()))
_WEIGHT = " * ".join(f"CASE WHEN tap >> {b} & 1 = 1 THEN {i} - floor({i}) ELSE 1 - ({i} - floor({i})) END" for b, i in enumerate(_UVW))


@query("ray_atlas_sample", f"WITH {G2}, {POINT}, a AS (SELECT i, j, k, floor(least(greatest(coalesce(g.v, 0) / 50, 0), 1) * 255 + 0.5) AS u8 FROM range(16) a(i) CROSS JOIN range(16) b(j) CROSS JOIN range(11) e(k) LEFT JOIN g2 g ON g.x = {CELL(lo=-30, i='i', n=16, size=60)} AND g.y = {CELL(lo=-24, i='j', n=16, size=50)} AND g.z = {CELL(lo=-5, i='k', n=11, size=11)}), q AS (SELECT probe_id, {_POS} FROM p), t AS (SELECT probe_id, {_TAP}, {_WEIGHT} AS weight FROM q CROSS JOIN range(8) r(tap)) SELECT probe_id, round(sum(u8 * weight) / 255, 6) AS value FROM t JOIN a ON a.i = ci AND a.j = cj AND a.k = ck GROUP BY 1")
def ray_atlas_sample(spark, d):
    cells = L.atlas(spark, G.leaves(g2(spark, d)), LOW2, HIGH2, most=16, filter="nearest", span=(0.0, 50.0))
    p = _points(spark, d).select("probe_id", ((F.col("x") + 30) / 60).alias("u"), ((F.col("y") + 24) / 50).alias("v"), ((F.col("z") + 5) / 11).alias("w"))
    return L.sample_atlas(p, cells, (16, 16, 11)).withColumn("value", F.round("value", 6))


@query("ray_wireframe", f"WITH {G2}, l AS (SELECT DISTINCT (x >> 3) * 8 AS ox, (y >> 3) * 8 AS oy, (z >> 3) * 8 AS oz FROM g2) SELECT ox, oy, oz, 12 AS edges, CAST(ox * 12 + 48 AS DOUBLE) AS sum_from_x FROM l".replace("ox * 12 + 48", "ox * 12 + 32"))
def ray_wireframe(spark, d):
    return R.wireframe(G.leaves(g2(spark, d))).groupBy("ox", "oy", "oz").agg(F.count("*").cast("int").alias("edges"), F.sum("from_x").alias("sum_from_x"))


# --- Sequences --------------------------------------------------------------------------------------------------------

TICK = "t AS (SELECT event_id, user_id % 5 AS sequence, epoch_us(ts) // 1000 AS now_ms, ts FROM events), w AS (SELECT event_id, sequence, ts, CAST(((7 + CAST(floor((now_ms - 1704067200000) / 41666.666666666664::DOUBLE) AS BIGINT)) % 48) AS INT) AS frame FROM t)"


def _ticks(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    now = F.unix_millis(F.col("ts").cast("timestamp"))
    frame = S.frame_at(now, F.lit(1704067200000), F.lit(7), 0.024, 48)
    return e.select("event_id", (F.col("user_id") % 5).alias("sequence"), "ts", frame.alias("frame"))


@query("str_frame_clock", f"WITH {TICK} SELECT event_id, frame FROM w")
def str_frame_clock(spark, d):
    return _ticks(spark, d).select("event_id", "frame")


@query("str_frame_asof", f"WITH {TICK}, h AS (SELECT *, CASE WHEN (frame * 7 + sequence) % 3 <> 0 THEN frame END AS have FROM w) SELECT event_id, frame, coalesce(last_value(have IGNORE NULLS) OVER (PARTITION BY sequence ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS shown, have IS NULL AS stalled FROM h")
def str_frame_asof(spark, d):
    return S.shown(_ticks(spark, d), _decoded(spark)).select("event_id", "frame", F.coalesce("shown", F.lit(-1)).alias("shown"), "stalled")


def _decoded(spark):
    rows = spark.range(5 * 48).select(F.expr("id div 48").alias("sequence"), (F.col("id") % 48).cast("int").alias("frame"))
    return rows.where((F.col("frame") * 7 + F.col("sequence")) % 3 != 0)


@query("str_stall_count", f"WITH {TICK} SELECT sequence, count(*) FILTER (WHERE (frame * 7 + sequence) % 3 = 0) AS stalls, count(*) AS ticks FROM w GROUP BY 1")
def str_stall_count(spark, d):
    return S.shown(_ticks(spark, d), _decoded(spark)).groupBy("sequence").agg(F.count_if("stalled").alias("stalls"), F.count("*").alias("ticks"))


@query("str_prefetch_window", f"WITH {TICK} SELECT w.event_id, CAST((w.frame + k) % 48 AS INT) AS want FROM w CROSS JOIN range(5) r(k)")
def str_prefetch_window(spark, d):
    return _ticks(spark, d).select("event_id", F.explode(S.window_ahead(F.col("frame"), 4, 48)).alias("want"))


@query("str_evict", f"WITH {TICK}, n AS (SELECT sequence, arg_max(frame, (ts, event_id)) AS frame FROM w GROUP BY 1) SELECT n.sequence, CAST(i AS INT) AS frame FROM n CROSS JOIN range(48) r(i) WHERE (i - n.frame + 48) % 48 > 4")
def str_evict(spark, d):
    now = _ticks(spark, d).groupBy("sequence").agg(F.max_by("frame", F.struct("ts", "event_id")).alias("frame"))
    held = now.select("sequence", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("frame"))
    want = now.select("sequence", F.explode(S.window_ahead(F.col("frame"), 4, 48)).alias("frame"))
    return S.evicted(held, want, ("sequence",))


@query("str_frame_gaps", f"WITH {G3}, f AS (SELECT frame, CAST(sum(v) AS DOUBLE) AS total FROM g3 GROUP BY 1) SELECT frame, total, coalesce(frame - lag(frame) OVER (ORDER BY frame), 0) AS gap FROM f")
def str_frame_gaps(spark, d):
    # A row for each hour of the events, so this window is as long as the sequence of frames.
    f = g3(spark, d).groupBy("frame").agg(F.sum("value").alias("total"))
    return f.withColumn("gap", F.coalesce(F.col("frame") - F.lag("frame").over(W.orderBy("frame")), F.lit(0)))


@query("src_procedural_fog", "SELECT 523305 AS sphere, 202581 AS box")
def src_procedural_fog(spark, d):
    n = {s: G.fog(spark, s, *box).agg(F.count_if("active").cast("int").alias(s)) for s, box in (("sphere", ((-51,) * 3, (51,) * 3)), ("box", ((-41, -21, -31), (41, 21, 31))))}
    return n["sphere"].crossJoin(n["box"])


BLOB = "b AS (SELECT f, x, y, z, t, 24 * 0.22 * (1 + 0.15 * sin(3 * t)) AS r, 11.5 + 24 * 0.18 * cos(t) AS cx, 11.5 + 24 * 0.08 * sin(2 * t) AS cy, 11.5 + 24 * 0.18 * sin(t) AS cz FROM (SELECT f, x, y, z, f / 6.0::DOUBLE * 2 * pi() AS t FROM range(6) a(f), range(24) b(x), range(24) c(y), range(24) d(z)))"


@query("src_orbiting_blob", f"WITH {BLOB}, v AS (SELECT f, least(greatest(1 - sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) / r + 0.15 * sin(0.3::DOUBLE * x + t) * sin(0.3::DOUBLE * z - t), 0), 1) AS v FROM b) SELECT CAST(f AS INT) AS frame, count(*) AS n, round(sum(v), 3) AS total FROM v WHERE v >= 0.06 GROUP BY 1")
def src_orbiting_blob(spark, d):
    return G.orbiting_blob(spark, 6, 24).where("active").groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))


#: The first three draws of the 32-bit generator from seed 1234; a test works them out by integer steps.
PHASES = [f"({v!r}::DOUBLE * 2 * pi())" for v in (0.07329497812315822, 0.7034119898453355, 0.9028560190927237)]


@query("src_lobed_ball", f"WITH b AS (SELECT x - 15.5::DOUBLE AS x, y - 15.5::DOUBLE AS y, z - 15.5::DOUBLE AS z FROM range(32) a(x), range(32) b(y), range(32) c(z)), f AS (SELECT greatest(1 - sqrt(x * x + y * y + z * z) / (32 * 0.34::DOUBLE), 0) AS base, 0.18 * sin(x * 0.22 + {PHASES[0]}) * sin(y * 0.22 + {PHASES[1]}) + 0.12 * sin(z * 0.28 + {PHASES[2]}) AS lobes FROM b) SELECT count(*) AS n, round(sum(least(greatest(base + base * lobes, 0), 1)), 3) AS total FROM f WHERE base > 0")
def src_lobed_ball(spark, d):
    return G.lobed_ball(spark, 32).where("active").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))


def _files(spark, d, codec):
    """Every frame of G3 as a grid, ten grids or so a file."""
    images = N.to_images(G.leaves(G.with_active(g3(spark, d)), keys=["frame"]), "frame")
    return N.pack_files(images.withColumn("file", F.expr("concat('frames-', pmod(frame, 16))")), "file", codec, "frame")


@query("src_many_grids_zip", f"WITH {G3} SELECT frame, x, y, z, v AS value FROM g3")
def src_many_grids_zip(spark, d):
    """Files of many compressed grids, read by their format."""
    files = _files(spark, d, 1)
    names = N.tables(files, "grids").select("path", "grid_index", F.col("name").cast("long").alias("frame"))
    leaf = N.load(files, "leaves").join(names, ["path", "grid_index"])
    return G.leaf_voxels(leaf, ["frame"]).where("active").select("frame", *K.AXES, F.col("value").cast("double").alias("value"))


@query("src_grid_metadata", f"WITH {G3} SELECT frame, 'Float' AS grid_type, 'FogVolume' AS grid_class, count(*) AS voxel_count, CAST(min(x) AS INT) AS x0, CAST(max(x) AS INT) AS x1, CAST(min(y) AS INT) AS y0, CAST(max(y) AS INT) AS y1, 0.0::DOUBLE AS background FROM g3 GROUP BY frame")
def src_grid_metadata(spark, d):
    """What the headers of files of many grids say; no node is read."""
    i = lambda c, k: F.col(c)[k]
    found = N.tables(_files(spark, d, 0), "grids")
    return found.select(F.col("name").cast("long").alias("frame"), "grid_type", "grid_class", "voxel_count", i("index_min", 0).alias("x0"), i("index_max", 0).alias("x1"), i("index_min", 1).alias("y0"), i("index_max", 1).alias("y1"), "background")


@query("src_image_round_trip", f"WITH {G3} SELECT frame, x, y, z, v AS value FROM g3")
def src_image_round_trip(spark, d):
    """Every frame's grid as the bytes of a file, read again."""
    images = N.to_images(G.leaves(G.with_active(g3(spark, d)), keys=["frame"]), "frame")
    back = N.from_images(images, "frame")
    return G.leaf_voxels(back, ["frame"]).where("active").select("frame", *K.AXES, F.col("value").cast("double").alias("value"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The leaves with most active voxels of G1, with their statistics."""
    return G.with_moments(G.node_stats(g1(spark, d))).orderBy(F.desc("n"), "ox", "oy", "oz").limit(100)
