"""Bit masks of 512 slots as arrays of eight BIGINTs, least bit first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 8


def count_bits(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda n, w: n + F.bit_count(w))


def count_zero_bits(mask: Column, size: int = 512) -> Column:
    return F.lit(size) - count_bits(mask)


def test_bit(mask: Column, n: Column) -> Column:
    return F.getbit(F.get(mask, F.shiftright(n, 6)), n.bitwiseAND(F.lit(63))) == 1


def ones(mask: Column, size: int = 512) -> Column:
    """The set slots, in order."""
    return F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda n: test_bit(mask, n))


def build(slot: Column, active: Column) -> Column:
    """Aggregate: the mask of a group's active slots."""
    one = F.lit(1).cast("long")
    word = lambda w: F.coalesce(F.bit_or(F.when(active & (F.shiftright(slot, 6) == w), F.call_function("shiftleft", one, slot.bitwiseAND(F.lit(63))))), F.lit(0).cast("long"))
    return F.array(*[word(w) for w in range(WORDS)])
