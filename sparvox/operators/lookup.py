"""Point lookups and samples: joins of probes with leaves, then tiles by level, then the background.

Probes meet leaves by block key, an equi-join that Spark broadcasts or shuffles as the sizes say. All eight taps of a
sample go through one join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import AXES, LEAF, align, leaf_slot
from ..functions.masks import test_bit
from ..functions.optics import lerp
from .grids import EDGE, ORIGIN


def read_values(probes: DataFrame, leaf: DataFrame, background: float = 0.0, tiles: DataFrame | None = None, keys: Sequence[str] = (), levels: bool = True) -> DataFrame:
    """probes (..., x, y, z) get value, active and level, that of the node whose slot answers: 0 a leaf, 1 a lower node, 2 an upper
    node, 3 a root tile, 4 nothing. Nodes are those above leaves and tiles; a slot of one that has no tile is inactive background.
    levels: False leaves out the nodes that only tell where such a slot is, and its level is 4; value and active stay the same."""
    xyz = [F.col(a) for a in AXES]
    at = probes.withColumns({o: align(c, LEAF) for o, c in zip(ORIGIN, xyz, strict=True)})
    found = at.join(leaf.select(*keys, *ORIGIN, F.col("values").alias("__values"), F.col("mask").alias("__mask")), [*keys, *ORIGIN], "left").drop(*ORIGIN)
    slot = leaf_slot(*xyz)
    found = found.withColumn("__0", F.when(F.col("__values").isNotNull(), F.struct(F.get("__values", slot).cast("double").alias("value"), test_bit(F.col("__mask"), slot).alias("active"), F.lit(0).alias("level")))).drop("__values", "__mask")
    names = ["__0"]
    for level, edge in EDGE.items():
        if tiles is not None:
            one = tiles.where(F.col("level") == level).select(*keys, *[F.col(o).alias(f"__{o}") for o in ORIGIN], F.struct(F.col("value").cast("double").alias("value"), F.col("active"), F.lit(level).alias("level")).alias(f"__{level}"))
            here = found.withColumns({f"__{o}": align(c, edge) for o, c in zip(ORIGIN, xyz, strict=True)})
            found = here.join(one, [*keys, *[f"__{o}" for o in ORIGIN]], "left").drop(*[f"__{o}" for o in ORIGIN])
            names.append(f"__{level}")
        if levels and level < 3:
            found = _inside(found, leaf, tiles, keys, level, float(background))
            names.append(f"__in{level}")
    none = F.struct(F.lit(float(background)).alias("value"), F.lit(False).alias("active"), F.lit(4).alias("level"))
    return found.withColumn("__r", F.coalesce(*names, none)).select(*probes.columns, "__r.value", "__r.active", "__r.level")


def _inside(probes: DataFrame, leaf: DataFrame, tiles: DataFrame | None, keys: Sequence[str], level: int, background: float) -> DataFrame:
    """Mark the probes within nodes of a level (1 lower, 2 upper): those hold leaves, or tiles of this level or below."""
    edge = EDGE[level + 1]
    held = [leaf.select(*keys, *ORIGIN)] + ([tiles.where(F.col("level") <= level).select(*keys, *ORIGIN)] if tiles is not None else [])
    names = [f"__n{o}" for o in ORIGIN]
    nodes = [x.select(*keys, *[align(F.col(o), edge).alias(n) for o, n in zip(ORIGIN, names, strict=True)]) for x in held]
    nodes = (nodes[0].unionByName(nodes[1]) if len(nodes) > 1 else nodes[0]).distinct()
    here = F.struct(F.lit(background).alias("value"), F.lit(False).alias("active"), F.lit(level).alias("level"))
    at = probes.withColumns({n: align(F.col(a), edge) for n, a in zip(names, AXES, strict=True)})
    return at.join(nodes.withColumn(f"__in{level}", here), [*keys, *names], "left").drop(*names)


def sample_trilinear(points: DataFrame, leaf: DataFrame, background: float = 0.0, tiles: DataFrame | None = None, key: str = "probe_id") -> DataFrame:
    """points (key, x, y, z) get value: eight taps, mixed along x, then y, then z. Inactive taps count with their values. key is unique."""
    base = points.withColumns({f"b{a}": F.floor(a).cast("int") for a in AXES})
    taps = F.array(*[F.struct(F.lit(t).alias("tap"), *[(F.col(f"b{a}") + (t >> s & 1)).alias(a) for s, a in enumerate(AXES)]) for t in range(8)])
    rest = [c for c in points.columns if c != key]
    fan = base.select(key, F.struct(*rest).alias("__p"), F.inline(taps))  # points go along with their taps, so they are not read again
    read = read_values(fan, leaf, background, tiles, levels=False)
    eight = read.groupBy(key).agg(F.first("__p").alias("__p"), *[F.max(F.when(F.col("tap") == t, F.col("value"))).alias(f"v{t}") for t in range(8)])
    eight = eight.select(key, "__p.*", *[F.col(f"v{t}").alias(f"__v{t}") for t in range(8)])
    v = [F.col(f"__v{t}") for t in range(8)]
    fx, fy, fz = (F.col(a) - F.floor(a) for a in AXES)
    low = lerp(lerp(v[0], v[1], fx), lerp(v[2], v[3], fx), fy)
    high = lerp(lerp(v[4], v[5], fx), lerp(v[6], v[7], fx), fy)
    return eight.select(*points.columns, lerp(low, high, fz).alias("value"))


def sample_nearest(points: DataFrame, leaf: DataFrame, background: float = 0.0, tiles: DataFrame | None = None) -> DataFrame:
    """The voxel whose coordinates are floor(p + 0.5)."""
    rest = [c for c in points.columns if c not in AXES]
    at = points.select(*rest, *[F.col(a).alias(f"p{a}") for a in AXES], *[F.floor(F.col(a) + 0.5).cast("int").alias(a) for a in AXES])
    found = read_values(at, leaf, background, tiles, levels=False)
    return found.select(*rest, *[F.col(f"p{a}").alias(a) for a in AXES], "value", "active")


def sample_atlas(points: DataFrame, atlas: DataFrame, dims: Sequence[int], key: str = "probe_id") -> DataFrame:
    """points (key, u, v, w in 0..1) of a dense atlas (x, y, z, value 0..255): clamped at the edges, the sum of eight weighed taps over 255."""
    pos = {a: F.least(F.greatest(F.col(u), F.lit(0.0)), F.lit(1.0)) * d - 0.5 for a, u, d in zip(AXES, "uvw", dims, strict=True)}
    base = points.withColumns({f"p{a}": p for a, p in pos.items()})
    taps = []
    for t in range(8):
        cells, weight = [], F.lit(1.0)
        for s, (a, d) in enumerate(zip(AXES, dims, strict=True)):
            i, frac = F.floor(f"p{a}"), F.col(f"p{a}") - F.floor(f"p{a}")
            cells.append(F.least(F.greatest(i + (t >> s & 1), F.lit(0)), F.lit(d - 1)).cast("int").alias(a))
            weight = weight * (frac if t >> s & 1 else 1 - frac)
        taps.append(F.struct(*cells, weight.alias("weight")))
    fan = base.select(key, F.inline(F.array(*taps)))
    return fan.join(atlas, list(AXES)).groupBy(key).agg((F.sum(F.col("value") * F.col("weight")) / 255).alias("value"))


def compare(expected: DataFrame, got: DataFrame, eps: float = 1e-5, key: str = "probe_id") -> DataFrame:
    """One row: probes, mismatches of value or activity, and the largest error."""
    both = expected.alias("e").join(got.alias("g"), key)
    err = F.abs(F.col("e.value") - F.col("g.value"))
    return both.agg(F.count("*").alias("n"), F.count_if((err > eps) | (F.col("e.active") != F.col("g.active"))).alias("mismatches"), F.max(err).alias("max_error"))


def slice_z(spark, leaf: DataFrame, z: int, low: Sequence[int], high: Sequence[int], background: float = 0.0, most: int = 256) -> DataFrame:
    """(x, y, value, active, gray) of a horizontal slice, every stride-th voxel, gray 0..255 over its active values."""
    w, h = high[0] - low[0] + 1, high[1] - low[1] + 1
    stride = max(1, -(-max(w, h) // most))
    nx, ny = -(-w // stride), -(-h // stride)
    cells = spark.range(nx * ny).select((F.expr(f"cast(id div {ny} as int)") * stride + low[0]).alias("x"), ((F.col("id") % ny).cast("int") * stride + low[1]).alias("y"), F.lit(z).alias("z"))
    rows = read_values(cells, leaf, background)
    span = rows.where("active").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    gray = F.floor((F.col("value") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0)) * 255 + 0.5)
    return rows.crossJoin(F.broadcast(span)).select("x", "y", "value", "active", F.when(F.col("active"), gray).otherwise(F.lit(0)).cast("int").alias("gray"))


def atlas(spark, leaf: DataFrame, low: Sequence[int], high: Sequence[int], background: float = 0.0, most: int = 256, filter: str = "trilinear", fmt: str = "uint8", span: tuple[float, float] | None = None) -> DataFrame:
    """Dense samples at cell centres of the box, at most `most` a side: (x, y, z, value), u8 over span if given, clamped otherwise."""
    from ..functions.optics import clamp_u8, to_u8

    if filter not in ("trilinear", "nearest") or fmt not in ("uint8", "float32"):
        raise ValueError("filter is trilinear or nearest, fmt uint8 or float32")
    size = [b - a + 1 for a, b in zip(low, high, strict=True)]
    dims = [min(s, most) for s in size]
    cells = spark.range(dims[0] * dims[1] * dims[2]).select("id", (F.col("id") % dims[0]).alias("i0"), F.expr(f"(id div {dims[0]}) % {dims[1]}").alias("i1"), F.expr(f"id div {dims[0] * dims[1]}").alias("i2"))
    points = cells.select(F.col("id").alias("probe_id"), *[(F.lit(float(low[k])) + (F.col(f"i{k}") + 0.5) / dims[k] * size[k]).alias(a) for k, a in enumerate(AXES)])
    found = sample_trilinear(points, leaf, background) if filter == "trilinear" else sample_nearest(points, leaf, background)
    value = F.col("value")
    if fmt == "uint8":
        value = to_u8(value, F.lit(float(span[0])), F.lit(float(span[1]))) if span else clamp_u8(value)
    i = F.col("probe_id")
    return found.select((i % dims[0]).cast("int").alias("x"), F.expr(f"cast((probe_id div {dims[0]}) % {dims[1]} as int)").alias("y"), F.expr(f"cast(probe_id div {dims[0] * dims[1]} as int)").alias("z"), value.alias("value"))
