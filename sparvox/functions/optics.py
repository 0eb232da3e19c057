"""Light and sampling formulas as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Material:
    """The renderer's default parameters."""

    density_scale: float = 40.0
    step: float = 0.75
    max_steps: int = 512
    sun: float = 3.0
    g: float = 0.3
    shadow_steps: int = 12
    shadow_density: float = 1.0
    ambient: float = 0.15


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def opacity(value: Column, scale: float, step: float) -> Column:
    return 1 - F.exp(-F.greatest(value, F.lit(0.0)) * scale * step)


def henyey_greenstein(cos: Column, g: float) -> Column:
    return F.lit(1 - g * g) / (4 * math.pi * F.pow(F.greatest(F.lit(1 + g * g) - 2 * g * cos, F.lit(1e-4)), F.lit(1.5)))


def fract(x: Column) -> Column:
    return x - F.floor(x)


def hash12(x: Column, y: Column) -> Column:
    """A jitter in [0, 1) from two numbers."""
    a, b, c = fract(x * 0.1031), fract(y * 0.1031), fract(x * 0.1031)
    d = a * (b + 33.33) + b * (c + 33.33) + c * (a + 33.33)
    return fract((a + d + b + d) * (c + d))


def to_u8(v: Column, low: Column, high: Column) -> Column:
    """Normalise to 0..255, halves up."""
    t = (v - low) / F.greatest(high - low, F.lit(1e-20))
    return F.floor(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")


def clamp_u8(v: Column) -> Column:
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")


def slab(origin: list[Column], direction: list[Column], low: list[Column], high: list[Column]) -> tuple[Column, Column]:
    """Where a ray enters and leaves a box of voxels; the far face is one past the last voxel."""
    near, far = [], []
    for o, d, a, b in zip(origin, direction, low, high, strict=True):
        safe = F.when(F.abs(d) < 1e-12, F.lit(1e-12)).otherwise(d)
        t0, t1 = (a - o) / safe, (b + 1 - o) / safe
        near.append(F.least(t0, t1))
        far.append(F.greatest(t0, t1))
    return F.greatest(*near, F.lit(0.0)), F.least(*far)
