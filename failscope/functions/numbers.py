"""Number formatting that rounds the exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_text(value: Column) -> Column:
    """``{value:.0f}``: a half is exact in binary, so ties-to-even on the number is exact."""
    return F.bround(value, 0).cast("bigint").cast("string")


def tenths_text(value: Column) -> Column:
    """``{value:.1f}``: compares 20 * value with an odd integer, including the rounding
    error of the product, so that values like 57.45 go the way their binary value lies."""
    a, b = value * F.lit(16.0), value * F.lit(4.0)
    total = a + b
    back = total - a
    error = (a - (total - back)) + (b - back)
    low = F.floor(total / 2)
    side = total - (low * 2 + 1).cast("double")
    up = (side > 0) | ((side == 0) & (error > 0))
    tie = (side == 0) & (error == 0)
    tenths = F.when(up | (tie & (F.pmod(low, F.lit(2)) == 1)), low + 1).otherwise(low)
    return F.format_string("%.1f", tenths.cast("double") / F.lit(10.0))


def percent_text(share: Column) -> Column:
    return F.concat(tenths_text(share * F.lit(100.0)), F.lit("%"))
