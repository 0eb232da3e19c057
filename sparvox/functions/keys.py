"""Coordinates, slots and keys of the voxel hierarchy as Column expressions (INT inputs; shifts and masks handle negatives)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAF, LOWER, UPPER = 8, 128, 4096  # edge of the region that a node of each level covers
AXES = ("x", "y", "z")


def shr(c: Column, n: int) -> Column:
    return F.shiftright(c, n)


def align(c: Column, edge: int) -> Column:
    """The start of the block of `edge` (a power of two) that holds c."""
    n = edge.bit_length() - 1
    return F.shiftleft(F.shiftright(c, n), n)


def root_key(x: Column, y: Column, z: Column) -> Column:
    part = lambda c: F.shiftrightunsigned(c.cast("int"), 12).cast("long")
    return part(z).bitwiseOR(F.shiftleft(part(y), 21)).bitwiseOR(F.shiftleft(part(x), 42))


def _slot(x: Column, y: Column, z: Column, mask: int, down: int, bits: int) -> Column:
    part = lambda c: F.shiftright(c.bitwiseAND(F.lit(mask)), down)
    return F.shiftleft(part(x), 2 * bits).bitwiseOR(F.shiftleft(part(y), bits)).bitwiseOR(part(z))


def upper_slot(x: Column, y: Column, z: Column) -> Column:
    return _slot(x, y, z, UPPER - 1, 7, 5)


def lower_slot(x: Column, y: Column, z: Column) -> Column:
    return _slot(x, y, z, LOWER - 1, 3, 4)


def leaf_slot(x: Column, y: Column, z: Column) -> Column:
    return _slot(x, y, z, LEAF - 1, 0, 3)


def slot_offset(slot: Column, bits: int, step: int) -> list[Column]:
    """Local coordinates of a slot: bits a side (3, 4, 5) and step voxels a slot (1, 8, 128)."""
    mask = (1 << bits) - 1
    return [F.shiftright(slot, s).bitwiseAND(F.lit(mask)) * step for s in (2 * bits, bits, 0)]


def bbox_size(low: Column, high: Column) -> Column:
    return high - low + 1


def atlas_dims(size: Column, most: int) -> Column:
    return F.least(size, F.lit(most))


def index_to_world(i: Column, voxel_size: Column, world_min: Column, index_min: Column) -> Column:
    return i * voxel_size + (world_min - index_min * voxel_size)


def world_to_index(w: Column, voxel_size: Column, world_min: Column, index_min: Column) -> Column:
    return (w - (world_min - index_min * voxel_size)) / voxel_size


def world_bbox(index_min: Column, index_max: Column, voxel_size: Column, shift: Column) -> tuple[Column, Column]:
    return index_min * voxel_size + shift, (index_max + 1) * voxel_size + shift


def map_point(matrix: list[float], vector: list[float], p: list[Column]) -> list[Column]:
    """A 3 x 3 matrix (row by row) and a vector applied to a point."""
    return [sum((p[j] * F.lit(float(matrix[3 * i + j])) for j in range(3)), F.lit(float(vector[i]))) for i in range(3)]


def scale_matrix(scale: list[float], translation: list[float] | None = None) -> list[float]:
    """3 x 3, or with a translation 4 x 4 row by row, points as rows (translation last)."""
    x, y, z = map(float, scale)
    if translation is None:
        return [x, 0.0, 0.0, 0.0, y, 0.0, 0.0, 0.0, z]
    return [x, 0.0, 0.0, 0.0, 0.0, y, 0.0, 0.0, 0.0, 0.0, z, 0.0, *map(float, translation), 1.0]


def pack_version(major: Column, minor: Column, patch: Column) -> Column:
    return F.shiftleft(major, 21).bitwiseOR(F.shiftleft(minor, 10)).bitwiseOR(patch)


def unpack_version(v: Column) -> list[Column]:
    return [F.shiftrightunsigned(v, 21), F.shiftrightunsigned(v, 10).bitwiseAND(F.lit(1023)), v.bitwiseAND(F.lit(1023))]


#: The names of grid types and classes by id.
GRID_TYPES = ("Unknown", "Float", "Double", "Int16", "Int32", "Int64", "Vec3f", "Vec3d", "Mask", "Half", "UInt32", "Boolean", "RGBA8", "Fp4", "Fp8", "Fp16", "FpN", "Vec4f", "Vec4d", "Index", "OnIndex", "Retired21", "Retired22", "PointIndex", "Vec3u8", "Vec3u16", "UInt8", "End")
GRID_CLASSES = ("Unknown", "LevelSet", "FogVolume", "Staggered", "PointIndex", "PointData", "Topology", "VoxelVolume", "IndexGrid", "TensorGrid", "VoxelBVH", "End")


def name_of(id_: Column, names: tuple[str, ...], kind: str) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), id_), F.concat(F.lit(f"{kind}("), id_.cast("string"), F.lit(")")))


def c_string(raw: Column) -> Column:
    return F.split(F.decode(raw, "UTF-8"), "\\x00")[0]


def grid_name(unique: Column) -> Column:
    return F.split(unique, "\\x1e")[0]


def value_type(grid_type: Column) -> Column:
    return F.regexp_extract(F.replace(grid_type, F.lit("_HalfFloat"), F.lit("")), r"^Tree_([a-zA-Z0-9]+)_(\d+)_(\d+)_(\d+)$", 1)


def next_pow2(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long"))


def required_limit(n: Column, adapter: int, least: int = 128 << 20) -> Column:
    return F.least(F.lit(adapter), F.greatest(F.lit(least), next_pow2(n)))


#: The increment and multipliers of splitmix64.
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def splitmix64(seed: int, draws: np.ndarray) -> np.ndarray:
    """Draw k (from 1) of the generator, for each k: its state is seed + k * increment, so draws need no order."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed & (1 << 64) - 1) + draws.astype(np.uint64) * np.uint64(SPLITMIX[0])
        z = (z ^ (z >> np.uint64(30))) * np.uint64(SPLITMIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SPLITMIX[2])
        return z ^ (z >> np.uint64(31))


#: The increments and multipliers of splitmix32, and the increment and constants of mulberry32.
SPLITMIX32, MULBERRY32 = (0x9E3779B9, 0x21F0AAAD, 0x735A2D97), (0x6D2B79F5, 1, 61)


def splitmix32(seed: int, draws: np.ndarray) -> np.ndarray:
    """A 32-bit generator of the same form; uniform in [0, 1)."""
    u = np.uint32
    with np.errstate(over="ignore"):
        z = u(seed) + draws.astype(u) * u(SPLITMIX32[0])
        z = (z ^ (z >> u(16))) * u(SPLITMIX32[1])
        z = (z ^ (z >> u(15))) * u(SPLITMIX32[2])
        return (z ^ (z >> u(15))) / 4294967296.0


def mulberry32(seed: int, draws: np.ndarray) -> np.ndarray:
    """Draw k (from 1) of a small 32-bit generator, for each k; uniform in [0, 1)."""
    u = np.uint32
    with np.errstate(over="ignore"):
        a = u(seed) + draws.astype(u) * u(MULBERRY32[0])
        t = (a ^ (a >> u(15))) * (a | u(MULBERRY32[1]))
        t = (t + (t ^ (t >> u(7))) * (t | u(MULBERRY32[2]))) ^ t
        return (t ^ (t >> u(14))) / 4294967296.0


def probes(spark, n: int, seed: int, low: tuple, high: tuple, dilate: int = 4, quarter: bool = False):
    """(probe_id, x, y, z): n seeded coordinates in the dilated box, or points on quarter steps. Rows draw for themselves."""
    import pandas as pd

    def run(frames):
        for f in frames:
            k = f["id"].to_numpy(np.int64)
            out = {"probe_id": k}
            for a, axis in enumerate(AXES):
                lo, hi = low[a] - dilate, high[a] + dilate
                scale = 4 if quarter else 1
                span = np.uint64(scale * (hi - lo) + 1)
                v = (splitmix64(seed, 3 * k + a + 1) % span).astype(np.int64)
                out[axis] = lo + v / scale if quarter else (lo + v).astype(np.int32)
            yield pd.DataFrame(out)

    kind = "double" if quarter else "int"
    return spark.range(n).mapInPandas(run, f"probe_id long, x {kind}, y {kind}, z {kind}")
