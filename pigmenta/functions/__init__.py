"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the integer hash that breaks ties.
HASH_MULTIPLIER = 0x45D9F3B
#: Fixed value: vertices of this degree or more are coloured before all others.
LARGE_DEGREE = 32


def int_hash(value: Column) -> Column:
    """32-bit integer hash of a non-negative id, as BIGINT in [0, 2**32)."""

    def spread(x: Column) -> Column:
        return (F.shiftrightunsigned(x, 16).bitwiseXOR(x) * F.lit(HASH_MULTIPLIER)).bitwiseAND(F.lit(0xFFFFFFFF))

    mixed = spread(spread(value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.shiftrightunsigned(mixed, 16).bitwiseXOR(mixed)


def signed32(value: Column) -> Column:
    """A 32-bit word read as a signed number."""
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def mex(colors: Column) -> Column:
    """Smallest non-negative integer that is not in the array."""
    return F.array_min(F.array_except(F.sequence(F.lit(0), F.size(colors)), colors))


def is_large(degree: Column) -> Column:
    return (degree >= LARGE_DEGREE).cast("int")
