"""Fixed-step ray marching: rays clipped to the box, steps as rows, samples by join, and front-to-back compositing per ray.

Steps and shadow points that no leaf is near are dropped before sampling: the background is empty. A ray's steps are folded in order, so
that light left over is a product in the order of the march."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import AXES, LEAF, align
from ..functions.optics import Material, henyey_greenstein, opacity, slab
from .lookup import sample_trilinear


def clip(rays: DataFrame, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """rays (ray_id, ox, oy, oz, dx, dy, dz) that meet the box, with t0 and t1."""
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    rows = rays.withColumn("__n", size).withColumns({f"d{a}": F.col(f"d{a}") / F.col("__n") for a in AXES}).drop("__n")
    near, far = slab([F.col(f"o{a}") for a in AXES], [F.col(f"d{a}") for a in AXES], [F.lit(float(v)) for v in low], [F.lit(float(v)) for v in high])
    return rows.withColumn("t0", near).withColumn("t1", far).where("t1 > t0")


def march(clipped: DataFrame, step: float, max_steps: int) -> DataFrame:
    """A row for each step of each ray, with its position."""
    if not 0 < max_steps <= 1024:
        raise ValueError("max_steps is 1 to 1024")
    n = F.least(F.floor((F.col("t1") - F.col("t0")) / step) + 1, F.lit(max_steps)).cast("int")
    rows = clipped.withColumn("step", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("t", F.col("t0") + F.col("step") * step)
    return rows.withColumns({a: F.col(f"o{a}") + F.col("t") * F.col(f"d{a}") for a in AXES})


def first_crossing(steps: DataFrame, iso: float = 0.0) -> DataFrame:
    """steps (ray_id, step, t, value) to (ray_id, step, t_hit, v_hit): the first step whose side of iso is not that of the step before."""
    side = F.signum(F.col("value") - iso)
    order = W.partitionBy("ray_id").orderBy("step")  # at most 1024 steps a ray
    hits = steps.withColumn("__hit", side != F.lag(side).over(order)).where("__hit")
    first = F.min(F.struct("step", "t", "value"))
    return hits.groupBy("ray_id").agg(first.alias("f")).select("ray_id", F.col("f.step").alias("step"), F.col("f.t").alias("t_hit"), F.col("f.value").alias("v_hit"))


def near_leaves(points: DataFrame, leaf: DataFrame) -> DataFrame:
    """The points of which a tap of the eight can lie in a leaf; the others would only read the background."""
    shifts = F.array(*[F.struct(*[(F.col(f"o{a}") - LEAF * (k >> i & 1)).alias(f"b{a}") for i, a in enumerate(AXES)]) for k in range(8)])
    blocks = leaf.select(F.inline(shifts)).distinct()
    at = points.withColumns({f"b{a}": align(F.floor(a).cast("int"), LEAF) for a in AXES})
    return at.join(blocks, [f"b{a}" for a in AXES], "left_semi").select(*points.columns)


def shadow(steps: DataFrame, leaf: DataFrame, sun: Sequence[float], m: Material) -> DataFrame:
    """(key, light): how much of the sun reaches each step: exp of minus the scaled density summed towards it. Points that no leaf is
    near have no density, so they are dropped before they are sampled."""
    n = F.sequence(F.lit(1), F.lit(min(m.shadow_steps, 128)))
    fan = steps.select("key", *AXES, F.explode(n).alias("k")).select("key", F.concat_ws(":", "key", "k").alias("probe_id"), *[(F.col(a) + F.col("k") * float(s) * m.step).alias(a) for a, s in zip(AXES, sun, strict=True)])
    read = sample_trilinear(near_leaves(fan, leaf), leaf)
    light = F.exp(-F.sum(F.greatest("value", F.lit(0.0)) * m.density_scale * m.shadow_density * m.step)).alias("__light")
    return steps.select("key").join(read.groupBy("key").agg(light), "key", "left").select("key", F.coalesce("__light", F.lit(1.0)).alias("light"))


def composite(steps: DataFrame, least: float = 0.003) -> DataFrame:
    """steps (ray_id, step, a, lit) to (ray_id, colour, transmittance, used): folded in order, ending when too little light is left."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(1.0).alias("t"), F.lit(0).alias("n"))

    def add(s, x):
        live = s["t"] >= least
        c = F.when(live, s["c"] + s["t"] * x["a"] * x["lit"]).otherwise(s["c"])
        return F.struct(c.alias("c"), F.when(live, s["t"] * (1 - x["a"])).otherwise(s["t"]).alias("t"), (s["n"] + F.when(live, 1).otherwise(0)).alias("n"))

    ordered = F.array_sort(F.collect_list(F.struct("step", "a", "lit")))
    rows = steps.groupBy("ray_id").agg(ordered.alias("s"))  # at most 1024 steps a ray
    return rows.select("ray_id", F.aggregate("s", start, add).alias("r")).select("ray_id", F.col("r.c").alias("colour"), F.col("r.t").alias("transmittance"), F.col("r.n").alias("used"))


def render(rays: DataFrame, leaf: DataFrame, low: Sequence[int], high: Sequence[int], m: Material | None = None, sun: Sequence[float] = (0.0, 1.0, 0.0), shadows: bool = True) -> DataFrame:
    m = m or Material()
    rows = march(clip(rays, low, high), m.step, m.max_steps).withColumn("key", F.concat_ws("/", "ray_id", "step"))
    points = rows.select(F.col("key").alias("probe_id"), *AXES, "ray_id", "step", "dx", "dy", "dz")
    read = sample_trilinear(near_leaves(points, leaf), leaf).where("value > 0").withColumnRenamed("probe_id", "key")
    read = read.join(shadow(read, leaf, sun, m), "key") if shadows else read.withColumn("light", F.lit(1.0))
    cos = sum((F.col(f"d{a}") * float(s) for a, s in zip(AXES, sun, strict=True)), F.lit(0.0))
    lit = F.lit(m.ambient) + m.sun * henyey_greenstein(cos, m.g) * F.col("light")
    return composite(read.select("ray_id", "step", opacity(F.col("value"), m.density_scale, m.step).alias("a"), lit.alias("lit")))


def wireframe(leaf: DataFrame, voxel_size: float = 1.0, shift: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Twelve edges of each leaf in world space: from and to corners."""
    corners = [(i & 1, i >> 1 & 1, i >> 2 & 1) for i in range(8)]
    edges = [(a, a | 1 << k) for a in range(8) for k in range(3) if not a >> k & 1]
    place = lambda c, end: [((F.col(f"o{a}") + 8 * c[i]) * voxel_size + float(shift[i])).alias(f"{end}_{a}") for i, a in enumerate(AXES)]
    made = F.array(*[F.struct(F.lit(n).alias("edge"), *place(corners[a], "from"), *place(corners[b], "to")) for n, (a, b) in enumerate(edges)])
    return leaf.select("ox", "oy", "oz", F.inline(made))
