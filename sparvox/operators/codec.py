"""Leaf codecs as Column expressions: 8-bit, and the narrowest of 1, 2, 4, 8 or 16 bits that keeps within a tolerance.

Every intermediate value that is a 32-bit float in the format is cast to FLOAT here, as dividing floats gives a double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTHS = (1, 2, 4, 8, 16)


def f32(c: Column) -> Column:
    return c.cast("float")


def limits(values: Column) -> tuple[Column, Column]:
    return F.array_min(values), F.array_max(values)


def quantum(low: Column, high: Column, top: int) -> Column:
    return f32(f32(high - low) / F.lit(float(top)))


def code(v: Column, low: Column, high: Column, bits: int) -> Column:
    top, span = (1 << bits) - 1, f32(high - low)
    if bits == 16:  # in double
        raw = F.floor(F.when(span > 0, F.lit(float(top)) / span.cast("double")).otherwise(F.lit(0.0)) * (v.cast("double") - low.cast("double")) + 0.5)
    else:
        scale = F.when(span > 0, f32(F.lit(float(top)) / span)).otherwise(f32(F.lit(0.0)))
        raw = F.floor(f32(f32(scale * f32(v - low)) + f32(F.lit(0.5))))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(top)).cast("int")


def decode(codes: Column, q: Column, low: Column) -> Column:
    """Values in double, with no rounding to 32 bits."""
    return F.transform(codes, lambda c: c * q.cast("double") + low.cast("double"))


def fits(values: Column, low: Column, high: Column, bits: int, tolerance: float) -> Column:
    """Whether every value comes back within the tolerance, in 32-bit steps."""
    top, span = (1 << bits) - 1, f32(high - low)
    scale = F.when(span > 0, f32(F.lit(float(top)) / span)).otherwise(f32(F.lit(0.0)))
    q = f32(span / F.lit(float(top)))

    def near(v: Column) -> Column:
        c = F.floor(f32(f32(scale * f32(v - low)) + f32(F.lit(0.5)))).cast("float")
        return F.abs(f32(v - f32(f32(c * q) + low))) <= f32(F.lit(tolerance))

    return F.forall(values, near)


def width(values: Column, low: Column, high: Column, tolerance: float) -> Column:
    tried = [F.when(fits(values, low, high, b, tolerance), F.lit(b)) for b in WIDTHS[:-1]]
    return F.when(low == high, F.lit(1)).otherwise(F.coalesce(*tried, F.lit(16)))


def _codes(low: Column, high: Column, bits: int) -> Column:
    return F.transform("values", lambda v: code(v, low, high, bits))


def quantize(leaf: DataFrame, codec: str = "fp8", tolerance: float = 0.01) -> DataFrame:
    """Leaves get minimum, quantum, bits and codes in place of values."""
    if codec not in ("fp8", "fpn"):
        raise ValueError("codec is fp8 or fpn")
    rows = leaf.withColumn("minimum", F.array_min("values")).withColumn("__max", F.array_max("values"))
    low, high = F.col("minimum"), F.col("__max")
    rows = rows.withColumn("bits", F.lit(8) if codec == "fp8" else width(F.col("values"), low, high, tolerance))
    kinds = (8,) if codec == "fp8" else WIDTHS
    q, codes = None, None
    for b in kinds:
        one = _codes(low, high, b)
        q = F.when(F.col("bits") == b, quantum(low, high, (1 << b) - 1)) if q is None else q.when(F.col("bits") == b, quantum(low, high, (1 << b) - 1))
        codes = F.when(F.col("bits") == b, one) if codes is None else codes.when(F.col("bits") == b, one)
    return rows.withColumn("quantum", q).withColumn("codes", codes).drop("__max", "values")


def dequantize(coded: DataFrame) -> DataFrame:
    return coded.withColumn("values", decode(F.col("codes"), F.col("quantum"), F.col("minimum"))).drop("codes")


def stat_u16(stat: Column, low: Column, q: Column) -> Column:
    """A statistic as the 16-bit code of the leaf header (subtract nothing from a deviation: pass low 0)."""
    scaled = F.when(q > 0, (stat - low) * (F.lit(1.0) / q.cast("double"))).otherwise(F.lit(0.0))
    return F.least(F.greatest(F.floor(scaled + 0.5), F.lit(0)), F.lit(65535)).cast("int")
