"""Rounding and number text, following round-half-even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def real(c: Column) -> Column:
    """NaN as null, so that sums, means and comparisons skip it."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def half_even(c: Column) -> Column:
    return F.bround(c.cast("double"), 0).cast("bigint")


def fixed0(c: Column) -> Column:
    """Text with no decimals."""
    return half_even(c).cast("string")


def fixed1(c: Column) -> Column:
    """Text with one decimal, rounding the exact binary value half to even.

    ``8x`` and ``2x`` are exact, so ``p + e`` below is exactly ``10x``; ``e``
    settles the cases where the rounded product ``p`` only looks like a tie.
    """
    x = c.cast("double")
    a, b = x * 8.0, x * 2.0
    p = a + b
    bb = p - a
    e = (a - (p - bb)) + (b - bb)
    whole = F.floor(p)
    frac = p - whole
    up = (
        F.when(frac < 0.5, 0)
        .when(frac > 0.5, 1)
        .when(e < 0, 0)
        .when(e > 0, 1)
        .otherwise(F.pmod(whole, F.lit(2)))
    )
    return F.format_string("%.1f", (whole + up).cast("double") / 10.0)


def signed(c: Column) -> Column:
    """Integer text that always carries its sign."""
    return F.format_string("%+d", c.cast("bigint"))


def scaled_sum(c: Column, digits: int) -> Column:
    """Sum of a fixed-decimal measure, added up as whole units of its last digit.

    Long addition does not depend on the order of rows, so reruns and retried
    tasks give the same bits; plain double sums do not. ``floor`` of the shifted
    value stays a primitive operation, where ``round`` goes through decimals.
    """
    return scaled_total(c, digits).cast("double") / float(10**digits)


def scaled_total(c: Column, digits: int) -> Column:
    """The sum in whole units of the last digit."""
    return F.sum(F.floor(c * float(10**digits) + 0.5))


def sum_of(c: Column, digits: int | None = None) -> Column:
    """Sum, 0 over nothing; order-independent when ``digits`` is given."""
    return F.coalesce(F.sum(c) if digits is None else scaled_sum(c, digits), F.lit(0.0))


def mean_of(c: Column, digits: int | None = None) -> Column:
    """Mean, null over nothing; order-independent when ``digits`` is given."""
    if digits is None:
        return F.avg(c)
    return F.try_divide(scaled_sum(c, digits), F.count(c))
