"""Grids as tables: voxels (x, y, z, value, active), leaves (ox, oy, oz, values of 512 slots, mask), tiles and nodes.

Every function takes and returns DataFrames keyed by the columns in `keys` (a grid id, a frame) besides coordinates, so
that many grids are built in one pass; blocks of voxels, not grids, are what work is dealt out by.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import masks
from ..functions.keys import AXES, LEAF, LOWER, UPPER, align, leaf_slot, lower_slot, mulberry32, upper_slot

ORIGIN = ("ox", "oy", "oz")


def _xyz():
    return [F.col(a) for a in AXES]


def is_active(value: Column, background: Column, threshold: float | None = None) -> Column:
    """Exact: differs from the background, NaN included. With a threshold: further from it than that, NaN excluded."""
    if threshold is None:
        return F.isnan(value) | F.isnan(background) | (value != background)
    return ~F.isnan(value) & (F.abs(value - background) > threshold)


def with_active(voxels: DataFrame, background: float = 0.0, threshold: float | None = None) -> DataFrame:
    return voxels.withColumn("active", is_active(F.col("value"), F.lit(float(background)), threshold))


def with_block(df: DataFrame, edge: int = LEAF, names: Sequence[str] = ORIGIN) -> DataFrame:
    return df.withColumns({n: align(F.col(a), edge) for n, a in zip(names, AXES, strict=True)})


def from_dense(blocks: DataFrame, background: float = 0.0, threshold: float | None = None) -> DataFrame:
    """blocks (..., dims array of 3, origin array of 3, values in x-major order) to voxels; voxels that equal the background in blocks without activity fall away later."""
    rows = blocks.select("*", F.posexplode("values").alias("i", "value")).drop("values")
    d, o = (lambda i: F.col("dims")[i]), (lambda i: F.col("origin")[i])
    at = [F.expr("i div (dims[1] * dims[2])"), F.expr("(i div dims[2]) % dims[1]"), F.col("i") % d(2)]
    rows = rows.withColumns({a: (at[k] + o(k)).cast("int") for k, a in enumerate(AXES)}).drop("i", "dims", "origin")
    return with_active(rows, background, threshold)


def check_dense(dims: Sequence[int], n_values: int, name: str = "") -> None:
    if len(dims) != 3 or any(int(d) != d or d <= 0 for d in dims):
        raise ValueError(f"dims must be three positive integers, not {list(dims)}")
    if n_values != dims[0] * dims[1] * dims[2]:
        raise ValueError(f"{n_values} values do not fill {list(dims)}")
    if len(name.encode()) >= 256:
        raise ValueError("a grid's name must be shorter than 256 bytes")


def leaves(voxels: DataFrame, background: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """A row for each 8 x 8 x 8 block with an active voxel. Inactive voxels in such a block keep their values."""
    rows = with_block(voxels).withColumn("slot", leaf_slot(*_xyz()))
    some = rows.groupBy(*keys, *ORIGIN).agg(
        F.array_sort(F.collect_list(F.struct("slot", F.col("value").cast("float").alias("value")))).alias("__v"),
        masks.build(F.col("slot"), F.col("active")).alias("mask"),
        F.count_if("active").alias("active_count"),
    )
    some = some.where("active_count > 0")
    v, fill = F.col("__v"), F.lit(float(background)).cast("float")

    # Each voxel with the slot before it; the last pair has no voxel and fills up the rest.
    def with_gap(s: Column, before: Column) -> Column:
        gap = F.concat(F.array_repeat(fill, s["slot"] - before - 1), F.array(s["value"]))
        return F.when(s.isNull(), F.array_repeat(fill, F.lit(511) - before)).otherwise(gap)

    filled = F.flatten(F.zip_with(v, F.concat(F.array(F.lit(-1)), v["slot"]), with_gap))
    some = some.withColumn("values", F.when(F.size(v) == 512, F.col("__v.value")).otherwise(filled)).drop("__v")
    whole = F.when(F.size("values") == 512, F.col("values")).otherwise(F.raise_error(F.lit("a voxel occurs twice")).cast("array<float>"))
    return some.withColumn("values", whole)


def leaf_voxels(leaf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All 512 voxels of every leaf."""
    rows = leaf.select(*keys, *ORIGIN, "mask", "values", F.explode(F.sequence(F.lit(0), F.lit(511))).alias("slot"))  # no filter on values is inferred from this
    rows = rows.withColumn("value", F.get("values", "slot"))
    at = [F.shiftright("slot", s).bitwiseAND(F.lit(7)) for s in (6, 3, 0)]
    rows = rows.withColumns({a: (F.col(o) + at[i]).cast("int") for i, (a, o) in enumerate(zip(AXES, ORIGIN, strict=True))})
    return rows.select(*keys, *AXES, "value", masks.test_bit(F.col("mask"), F.col("slot")).alias("active"))


#: Sums that merge: everything else about a node's statistics derives from them.
def partial_stats(value: str = "value") -> list[Column]:
    v = F.col(value)
    boxes = [f(a).alias(f"{n}{a}") for a in AXES for f, n in ((F.min, "min_"), (F.max, "max_"))]
    return [F.count("*").alias("n"), F.sum(v).alias("vsum"), F.sum(v * v).alias("vsq"), F.min(v).alias("vmin"), F.max(v).alias("vmax"), *boxes]


def merged_stats() -> list[Column]:
    sums = [F.sum(c).alias(c) for c in ("n", "vsum", "vsq")]
    low = [F.min(c).alias(c) for c in ("vmin", *[f"min_{a}" for a in AXES])]
    high = [F.max(c).alias(c) for c in ("vmax", *[f"max_{a}" for a in AXES])]
    return [sums[0], sums[1], sums[2], low[0], high[0], *[x for pair in zip(low[1:], high[1:], strict=True) for x in pair]]


def with_moments(stats: DataFrame) -> DataFrame:
    """Average and population deviation; 0 where there is nothing."""
    mean = F.when(F.col("n") > 0, F.col("vsum") / F.col("n")).otherwise(F.lit(0.0))
    var = F.when(F.col("n") > 0, F.col("vsq") / F.col("n") - mean * mean).otherwise(F.lit(0.0))
    return stats.withColumn("average", mean).withColumn("std_dev", F.sqrt(F.greatest(var, F.lit(0.0))))


def node_stats(voxels: DataFrame, level: str = "leaf", keys: Sequence[str] = ()) -> DataFrame:
    """Statistics over the active voxels of each node of a level. Upper levels re-aggregate the rows of the level below."""
    out = with_block(voxels.where("active")).groupBy(*keys, *ORIGIN).agg(*partial_stats())
    for name, edge in (("leaf", LEAF), ("lower", LOWER), ("upper", UPPER)):
        if name != "leaf":
            out = out.withColumns({o: align(F.col(o), edge) for o in ORIGIN}).groupBy(*keys, *ORIGIN).agg(*merged_stats())
        if name == level:
            return out
    return out.groupBy(*keys).agg(*merged_stats())


def hierarchy_stats(voxels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Statistics of all levels in one table with a column level: each level from the one below."""
    levels, out = [("leaf", LEAF), ("lower", LOWER), ("upper", UPPER)], None
    rows = with_block(voxels.where("active")).groupBy(*keys, *ORIGIN).agg(*partial_stats())
    for name, edge in levels:
        if name != "leaf":
            rows = rows.withColumns({o: align(F.col(o), edge) for o in ORIGIN}).groupBy(*keys, *ORIGIN).agg(*merged_stats())
        one = rows.withColumn("level", F.lit(name))
        out = one if out is None else out.unionByName(one)
    root = rows.groupBy(*keys).agg(*merged_stats()).withColumns({o: F.lit(None).cast("int") for o in ORIGIN}).withColumn("level", F.lit("root"))
    return out.unionByName(root)


def node_counts(leaf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    at = lambda edge: F.struct(*[align(F.col(o), edge) for o in ORIGIN])
    return leaf.groupBy(*keys).agg(F.count("*").alias("leaf"), F.count_distinct(at(LOWER)).alias("lower"), F.count_distinct(at(UPPER)).alias("upper"))


def mem_index(leaf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Leaves in breadth-first order: by upper node, slot in it, slot in the lower node.

    Ranks are dealt out by upper node, then shifted by the leaves of earlier ones, so a large grid is not ranked by one task."""
    o = [F.col(c) for c in ORIGIN]
    rows = leaf.withColumns({f"u{a}": align(c, UPPER) for a, c in zip(AXES, o, strict=True)}).withColumn("upper_slot", upper_slot(*o)).withColumn("lower_slot", lower_slot(*o))
    upper = [f"u{a}" for a in AXES]
    before = W.partitionBy(*keys).orderBy(*upper).rowsBetween(W.unboundedPreceding, -1)
    lead = rows.groupBy(*keys, *upper).agg(F.count("*").alias("n")).withColumn("lead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    nth = F.row_number().over(W.partitionBy(*keys, *upper).orderBy("upper_slot", "lower_slot")) - 1
    return rows.withColumn("nth", nth).join(lead, [*keys, *upper]).withColumn("mem_index", (F.col("lead") + F.col("nth")).cast("long")).drop("nth", "lead")


#: Sizes in bytes of the blocks of a grid image.
SIZES = {"grid": 672, "tree": 64, "root": 64, "tile": 32, "upper": 270400, "lower": 33856, "float": 2144, "fp8": 608}


def leaf_bytes(codec: str = "float", bits: Column | None = None) -> Column:
    return 96 + bits * 64 if codec == "fpn" else F.lit(SIZES[codec])


def with_offsets(ranked: DataFrame, size: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Byte offset of each leaf in the leaf block: what lies before it, by upper node like the ranks."""
    upper = [f"u{a}" for a in AXES]
    rows = ranked.withColumn("bytes", size.cast("long"))
    before = W.partitionBy(*keys).orderBy(*upper).rowsBetween(W.unboundedPreceding, -1)
    lead = rows.groupBy(*keys, *upper).agg(F.sum("bytes").alias("n")).withColumn("lead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    run = F.sum("bytes").over(W.partitionBy(*keys, *upper).orderBy("mem_index").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("bytes")
    return rows.withColumn("run", run).join(lead, [*keys, *upper]).withColumn("leaf_offset", F.col("lead") + F.col("run")).drop("run", "lead")


def inspect(leaf: DataFrame, size: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Node counts and the bytes of each block."""
    counts = node_counts(leaf, keys)
    sizes = leaf.groupBy(*keys).agg(F.coalesce(F.sum(size if size is not None else F.lit(SIZES["float"])), F.lit(0)).alias("leaf_bytes"), F.coalesce(F.sum("active_count"), F.lit(0)).alias("voxel_count"))
    both = counts.join(sizes, list(keys)) if keys else counts.crossJoin(sizes)  # a single row each
    both = both.withColumns({"grid_bytes": F.lit(SIZES["grid"]), "tree_bytes": F.lit(SIZES["tree"]), "root_bytes": F.lit(SIZES["root"]) + F.col("upper") * SIZES["tile"], "upper_bytes": F.col("upper") * SIZES["upper"], "lower_bytes": F.col("lower") * SIZES["lower"]})
    return both.withColumn("total_bytes", sum((F.col(f"{c}_bytes") for c in ("tree", "root", "upper", "lower", "leaf")), F.col("grid_bytes")))


def block_offsets(sizes: DataFrame) -> DataFrame:
    """Where each block of a grid image begins, from the sizes that inspect() gives."""
    at, out = F.lit(0).cast("long"), {}
    for before, part in zip(("grid", "tree", "root", "upper", "lower"), ("tree", "root", "upper", "lower", "leaf"), strict=True):
        at = at + F.col(f"{before}_bytes")
        out[f"{part}_at"] = at
    return sizes.withColumns(out)


def child_counts(leaf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(level, ox, oy, oz, children) of every lower and upper node; lower nodes come from leaves, upper ones from lower ones."""
    up = lambda df, edge: df.groupBy(*keys, *[align(F.col(o), edge).alias(o) for o in ORIGIN]).agg(F.count("*").alias("children"))
    lower = up(leaf, LOWER)
    named = lambda df, level: df.select(*keys, F.lit(level).alias("level"), *ORIGIN, "children")
    return named(lower, "lower").unionByName(named(up(lower, UPPER), "upper"))


def shares(sizes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each part with its share of all, as the report panels show them."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    rows = F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).cast("long").alias("amount"), (F.col(c) / total).alias("share")) for c in columns])
    return sizes.select(F.inline(rows))


# Tiles: constant regions above the leaves (level 1: 8 a side, 2: 128, 3: 4096).

EDGE = {1: LEAF, 2: LOWER, 3: UPPER}


def check_root_tiles(tiles: DataFrame) -> DataFrame:
    """Active root tiles are too large to expand: the query fails when it meets one."""
    bad = F.col("active") & (F.col("level") == 3)
    return tiles.where(F.when(bad, F.raise_error(F.lit("an active root tile cannot be expanded"))).otherwise(F.lit(True)))


def tile_leaves(tiles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Active tiles of levels 1 and 2 as full leaves of one value."""
    rows = check_root_tiles(tiles).where("active AND level < 3")
    steps = F.when(F.col("level") == 2, F.sequence(F.lit(0), F.lit(4095))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("k", F.explode(steps))
    at = [F.shiftright("k", s).bitwiseAND(F.lit(15)) * 8 for s in (8, 4, 0)]
    rows = rows.withColumns({o: (F.col(o) + at[i]).cast("int") for i, o in enumerate(ORIGIN)})
    return rows.select(*keys, *ORIGIN, F.array(*[F.lit(-1).cast("long")] * 8).alias("mask"), F.lit(512).cast("long").alias("active_count"), F.array_repeat(F.col("value").cast("float"), 512).alias("values"))


def all_leaves(leaf: DataFrame, tiles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return leaf.unionByName(tile_leaves(tiles, keys))


def constant_leaves(leaf: DataFrame) -> DataFrame:
    """Leaves that a tile could replace: full masks and one value."""
    return leaf.where((F.col("active_count") == 512) & (F.array_min("values") == F.array_max("values")))


def assert_no_active_tiles(slots: DataFrame) -> DataFrame:
    """slots (child, active): fails on an active slot without a child."""
    return slots.where(F.when(~F.col("child") & F.col("active"), F.raise_error(F.lit("active tiles are not supported"))).otherwise(F.lit(True)))


def effective_background(tiles: DataFrame, background: float, keys: Sequence[str] = ()) -> DataFrame:
    """The value of the first inactive lower tile in storage order, else of the first inactive upper tile, else the background."""
    rank = F.struct(F.when(F.col("level") == 1, 0).otherwise(1).alias("a"), *[align(F.col(o), UPPER).alias(f"u{o}") for o in ORIGIN], upper_slot(*[F.col(o) for o in ORIGIN]).alias("s"), lower_slot(*[F.col(o) for o in ORIGIN]).alias("t"))
    found = tiles.where("NOT active AND level < 3").groupBy(*keys).agg(F.min_by("value", rank).alias("background"))
    return found.withColumn("background", F.coalesce("background", F.lit(float(background))))


# Edits.

PRESETS: dict[str, Callable[[Column], Column]] = {
    "double": lambda v: v * 2,
    "half": lambda v: v * 0.5,
    "negate": lambda v: -v,
    "clamp01": lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)),
}


def edit_values(voxels: DataFrame, how: str | Callable[[Column], Column]) -> DataFrame:
    """Edit every stored voxel, active or not; tiles are another table and stay. how: a preset, a SQL expression of value, or a function."""
    if callable(how):
        made = how(F.col("value"))
    else:
        made = PRESETS[how](F.col("value")) if how in PRESETS else F.expr(how)
    return voxels.withColumn("value", made)


def region(df: DataFrame, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """Voxels in an inclusive box; the comparisons reach the scan."""
    cond = F.lit(True)
    for a, lo, hi in zip(AXES, low, high, strict=True):
        cond = cond & F.col(a).between(lo, hi)
    return df.where(cond)


def uniform_scale(matrix: Sequence[float]) -> tuple[float, tuple[float, float, float]]:
    """Scale and translation of a 4 x 4 matrix (row by row, translation last); fails unless it scales all axes alike."""
    m = [list(matrix[4 * i : 4 * i + 4]) for i in range(4)]
    s = m[0][0]
    eps = 1e-6 * max(1.0, abs(s))
    off = [m[i][j] for i in range(3) for j in range(3) if i != j]
    if s <= 0 or abs(m[1][1] - s) > eps or abs(m[2][2] - s) > eps or any(abs(v) > eps for v in off):
        raise ValueError("only a uniform scale and a translation are supported")
    return s, tuple(m[3][:3])


def transform_grids(grids: DataFrame, voxel_size: float | None = None, world_origin: Sequence[float] = (0.0, 0.0, 0.0), matrix: Sequence[float] | None = None) -> DataFrame:
    """Metadata only: a new voxel size and translation, and the world box that follows (columns min_x.., max_x.. are the index box)."""
    if matrix is not None:
        voxel_size, world_origin = uniform_scale(matrix)
    if not voxel_size or voxel_size <= 0:
        raise ValueError("voxel_size must be positive")
    out = grids.withColumn("voxel_size", F.lit(float(voxel_size)))
    for a, t in zip(AXES, world_origin, strict=True):
        out = out.withColumn(f"world_min_{a}", F.col(f"min_{a}") * F.lit(float(voxel_size)) + F.lit(float(t))).withColumn(f"world_max_{a}", (F.col(f"max_{a}") + 1) * F.lit(float(voxel_size)) + F.lit(float(t)))
    return out


# Histograms.


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    t = (value - low) / F.greatest(high - low, F.lit(1e-20))
    return F.least(F.floor(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * bins), F.lit(bins - 1)).cast("int")


def histogram(voxels: DataFrame, bins: int = 256) -> DataFrame:
    """(bin, n) over the range of all active values, empty bins included. The range is one row, so it is broadcast."""
    if bins <= 0 or int(bins) != bins:
        raise ValueError("bins must be a positive integer")
    rows = voxels.where("active")
    span = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    found = rows.crossJoin(F.broadcast(span)).groupBy(bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def grid_stats(voxels: DataFrame, tiles: DataFrame | None = None, low: Sequence[int] | None = None, high: Sequence[int] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Count, minimum, maximum and mean of active values in a box, tiles weighed by the volume that lies in it instead of expanded; zeros if there are none."""
    rows = voxels.where("active") if low is None else region(voxels.where("active"), low, high)
    rows = rows.select(*keys, "value", F.lit(1).cast("long").alias("w"))
    if tiles is not None:
        edge = F.element_at(F.create_map(*[F.lit(x) for kv in EDGE.items() for x in kv]), F.col("level").cast("int"))
        volume = F.lit(1).cast("long")
        for i, o in enumerate(ORIGIN):
            a = F.col(o) if low is None else F.greatest(F.col(o), F.lit(low[i]))
            b = F.col(o) + edge - 1 if high is None else F.least(F.col(o) + edge - 1, F.lit(high[i]))
            volume = volume * F.greatest(b - a + 1, F.lit(0))
        rows = rows.unionByName(tiles.where("active").select(*keys, "value", volume.alias("w")).where("w > 0"))
    z = F.lit(0.0)
    out = rows.groupBy(*keys).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("active_count"), F.coalesce(F.min("value"), z).alias("vmin"), F.coalesce(F.max("value"), z).alias("vmax"), F.coalesce(F.sum(F.col("value") * F.col("w")) / F.sum("w"), z).alias("mean"))
    return out.withColumn("used_fast_path", F.col("vmin") >= 0)


def first_leaves(ranked: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """The first k leaves in breadth-first order, and how many there are."""
    total = ranked.groupBy(*keys).agg(F.count("*").alias("total"))
    first = ranked.where(F.col("mem_index") < k)
    return first.join(F.broadcast(total), list(keys)) if keys else first.crossJoin(F.broadcast(total))


# Generators.


def fog(spark: SparkSession, shape: str, low: Sequence[int], high: Sequence[int], half_width: float = 3.0) -> DataFrame:
    """Voxels of a sphere (radius 50), torus (60, 25) or box (half sides 40, 20, 30) of fog in a box of coordinates."""
    n = [b - a + 1 for a, b in zip(low, high, strict=True)]
    rows = spark.range(n[0] * n[1] * n[2]).select(
        (F.expr(f"id div {n[1] * n[2]}") + low[0]).cast("int").alias("x"), (F.expr(f"(id div {n[2]}) % {n[1]}") + low[1]).cast("int").alias("y"), (F.col("id") % n[2] + low[2]).cast("int").alias("z")
    )
    x, y, z = (F.col(a).cast("double") for a in AXES)
    if shape == "sphere":
        d = F.sqrt(x * x + y * y + z * z) - 50
    elif shape == "torus":
        r = F.sqrt(x * x + z * z) - 60
        d = F.sqrt(r * r + y * y) - 25
    elif shape == "box":
        q = [F.abs(c) - h for c, h in ((x, 40), (y, 20), (z, 30))]
        out = [F.greatest(c, F.lit(0.0)) for c in q]
        d = F.sqrt(out[0] * out[0] + out[1] * out[1] + out[2] * out[2]) + F.least(F.greatest(*q), F.lit(0.0))
    else:
        raise ValueError(f"unknown shape {shape}")
    value = F.when(d <= 0, F.least(F.greatest(-d / half_width, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return rows.select(*AXES, value.cast("float").alias("value"), (d <= 0).alias("active"))


def _dense(spark: SparkSession, n: int, frames: int = 1) -> DataFrame:
    return spark.range(frames * n**3).select((F.expr(f"id div {n**3}")).cast("int").alias("frame"), *[F.expr(f"cast((id div {n ** (2 - i)}) % {n} as int)").alias(a) for i, a in enumerate(AXES)])


def orbiting_blob(spark: SparkSession, frames: int = 24, n: int = 64, floor: float = 0.06) -> DataFrame:
    """Animated frames in a box of n voxels a side: a soft ball circles the middle, bobs and pulses, with a swirl in it; what is fainter than floor is 0."""
    rows = _dense(spark, n, frames)
    x, y, z = (F.col(a).cast("double") for a in AXES)
    turn = F.col("frame") / F.lit(float(frames)) * (2 * math.pi)
    middle = (n - 1) / 2
    centre = (middle + n * 0.18 * F.cos(turn), middle + n * 0.08 * F.sin(turn * 2), middle + n * 0.18 * F.sin(turn))
    radius = n * 0.22 * (1 + 0.15 * F.sin(turn * 3))
    r = F.sqrt(sum(((a - c) * (a - c) for a, c in zip((x, y, z), centre, strict=True)), F.lit(0.0)))
    v = 1 - r / radius + 0.15 * F.sin(x * 0.3 + turn) * F.sin(z * 0.3 - turn)
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return with_active(rows.withColumn("value", F.when(v < floor, 0.0).otherwise(v).cast("float")))


def lobed_ball(spark: SparkSession, n: int = 96, seed: int = 1234) -> DataFrame:
    """A ball that fades outwards, modulated by two products of sines whose phases are drawn from the seed."""
    p = [float(v) * 2 * math.pi for v in mulberry32(seed, np.arange(1, 4))]
    x, y, z = (F.col(a) - (n - 1) / 2 for a in AXES)
    base = F.greatest(1 - F.sqrt(x * x + y * y + z * z) / (n * 0.34), F.lit(0.0))
    lobes = 0.18 * F.sin(x * 0.22 + p[0]) * F.sin(y * 0.22 + p[1]) + 0.12 * F.sin(z * 0.28 + p[2])
    v = F.least(F.greatest(base + base * lobes, F.lit(0.0)), F.lit(1.0))
    return with_active(_dense(spark, n).drop("frame").withColumn("value", v.cast("float")))


def merge_grids(a: DataFrame, b: DataFrame, how: str = "max") -> DataFrame:
    """Extension: combine two grids voxel by voxel: max, add, or over (a hides b)."""
    both = a.select(*AXES, F.col("value").alias("va"), F.col("active").alias("aa")).join(b.select(*AXES, F.col("value").alias("vb"), F.col("active").alias("ab")), list(AXES), "full")
    v = {"max": F.greatest("va", "vb"), "add": F.coalesce("va", F.lit(0.0)) + F.coalesce("vb", F.lit(0.0)), "over": F.when(F.coalesce("aa", F.lit(False)), F.col("va")).otherwise(F.coalesce("vb", "va"))}[how]
    return both.select(*AXES, v.alias("value"), (F.coalesce("aa", F.lit(False)) | F.coalesce("ab", F.lit(False))).alias("active"))
