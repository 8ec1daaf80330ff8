"""Merge policies as Column expressions: what three versions of a value become.

NULL is a value like any other here, so everything compares with the null-safe ``<=>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_63, _TWO_64 = "9223372036854775808", "18446744073709551616"


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def scalar(base: Column, ours: Column, theirs: Column) -> Column:
    """The side that changed; the base where both changed differently."""
    return F.when(same(ours, theirs) | same(theirs, base), ours).when(same(ours, base), theirs).otherwise(base)


def scalar_clash(base: Column, ours: Column, theirs: Column) -> Column:
    """Whether both sides changed a value, differently."""
    return ~(same(ours, theirs) | same(ours, base) | same(theirs, base))


def counter(base: Column, ours: Column, theirs: Column) -> Column:
    """Both sides' changes added to the base, wrapped to 64 bits: equal changes count twice."""
    wide = lambda c: c.cast("decimal(38,0)")
    total = wide(ours) + wide(theirs) - wide(base)
    half, whole = F.lit(_TWO_63).cast("decimal(38,0)"), F.lit(_TWO_64).cast("decimal(38,0)")
    return (F.pmod(total + half, whole) - half).cast("bigint")
