"""Exact sums and the three rounding rules the results need.

Sums are kept as two 64-bit integers (whole units and parts of a unit; a
millionth unless ``places`` says otherwise).  They are as fast as a double sum,
do not depend on task order, and stay exact where a double would have run out of
digits.  They turn into a decimal only once per group, after the aggregation.

NaN counts as missing, like null: sums pass over it, means do not count it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

#: Decimal places of a measure that sums keep.
PLACES = 6

#: Splits a double into two halves of 26 bits, whose products are exact.
SPLITTER = float(2**27 + 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """The value as a double; NaN is null."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def whole_part(c: Column | str) -> Column:
    return F.floor(known(c))


def small_part(c: Column | str, places: int = PLACES) -> Column:
    """What is beyond the whole units, in units of the last place kept."""
    x = known(c)
    return F.floor((x - F.floor(x)) * 10**places + 0.5)


def _as_decimal(whole: Column, small: Column, places: int) -> Column:
    unit = F.lit(Decimal(1).scaleb(-places))
    return whole.cast("decimal(20,0)") + small.cast("decimal(20,0)") * unit


def exact_sum(c: Column | str, places: int = PLACES) -> Column:
    """Sum of a double measure as a decimal with exact places."""
    return _as_decimal(F.sum(whole_part(c)), F.sum(small_part(c, places)), places)


def partial_sums(c: Column | str, name: str, places: int = PLACES) -> list[Column]:
    """First half of ``exact_sum``, for aggregating before a join."""
    return [
        F.sum(whole_part(c)).alias(f"{name}__whole"),
        F.sum(small_part(c, places)).alias(f"{name}__small"),
    ]


def merged_sum(name: str, places: int = PLACES) -> Column:
    """Second half of ``exact_sum`` over the columns of ``partial_sums``."""
    return _as_decimal(F.sum(f"{name}__whole"), F.sum(f"{name}__small"), places)


def exact_mean(c: Column | str, places: int = PLACES) -> Column:
    return exact_sum(c, places).cast("double") / F.count(known(c))


def rounded(decimal_total: Column, digits: int = 2) -> Column:
    """Half away from zero on an exact decimal, handed out as a double."""
    return F.round(decimal_total, digits).cast("double")


def half_away(x: Column, digits: int) -> Column:
    """SQL ``ROUND`` on a double."""
    scale = 10**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def half_up(x: Column, digits: int = 0) -> Column:
    """Ties go up, as in browser number formatting."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def half_even(x: Column, digits: int) -> Column:
    """Python's ``round``: the nearest decimal to the binary value, ties to even.

    0.35 is a little below 35/100, but 0.35 * 10 comes out as 3.5.  Where the
    product ends in one half, what its rounding lost says on which side it was.
    """
    scale = 10**digits
    product = x * scale
    below = F.floor(product)
    high = x * SPLITTER - (x * SPLITTER - x)
    lost = (high * scale - product) + (x - high) * scale
    tie = (product - below) == 0.5
    nearest = (
        F.when(tie & (lost < 0), below.cast("double"))
        .when(tie & (lost > 0), (below + 1).cast("double"))
        .otherwise(F.rint(product))
    )
    return nearest / scale
