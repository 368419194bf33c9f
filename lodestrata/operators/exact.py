"""Sums that don't depend on the order of the rows.

A sum of doubles changes in its last bits with the partitioning. Here each number is split into two whole
numbers, its multiple of 2^-24 and what is left in multiples of 2^-60; whole numbers add up exactly in
decimals, in any order, by Spark's own partial sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, LOW = 24, 36


def exact_sum(value: Column | str) -> Column:
    """The sum of finite doubles below 2^38, each rounded to a multiple of 2^-60: equal to the bit however the
    rows are dealt. Null where there are no rows, as sum() is."""
    v = F.col(value) if isinstance(value, str) else value
    scaled = v * float(1 << HIGH)
    high = F.rint(scaled)
    low = F.rint((scaled - high) * float(1 << LOW))
    total = F.sum(high.cast("decimal(20,0)")) * F.lit(1 << LOW).cast("decimal(11,0)") + F.sum(low.cast("decimal(20,0)"))
    return total.cast("double") / F.lit(float(1 << (HIGH + LOW)))
