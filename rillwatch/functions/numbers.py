"""Rounding as the published texts use it."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column) -> Column:
    """Nearest integer, halves towards positive infinity (also for negative values)."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def one_decimal(value: Column) -> Column:
    """DECIMAL with one place, without an exponent: the exact value of the DOUBLE rounded, ties to even.

    The shortest text of a number may end in a 5 that its exact value lies below or above, so it can't be
    rounded by that text.
    """
    size = F.abs(value)
    whole = F.floor(size)
    # the fraction in units of 2**-57, cut off only where it is far below a twentieth
    twentieths = ((size - whole) * F.lit(2.0**57)).cast("bigint") * 20
    steps = F.shiftright(twentieths, 57)
    down = (steps % 4 == 1) & (twentieths.bitwiseAND(F.lit(2**57 - 1)) == 0)
    tenths = whole * 10 + F.shiftright(steps + 1, 1) - F.when(down, 1).otherwise(0)
    exact = F.when(value < 0, -tenths).otherwise(tenths).cast("decimal(20,0)") * F.lit(Decimal("0.1"))
    # no mean of timestamps reaches this size
    return F.when(size < 2.0**59, exact.cast("decimal(20,1)")).otherwise(F.bround(value, 1).cast("decimal(20,1)"))


def _minus_zero(value: Column) -> Column:
    """Whether a number is printed as -0.0, which no DECIMAL holds."""
    return (value < 0) & (one_decimal(value) == 0)


def one_decimal_text(value: Column) -> Column:
    """The text of :func:`one_decimal`, with the sign of a negative number that rounds to zero."""
    sign = F.when(_minus_zero(value), "-").otherwise("")
    return F.concat(sign, one_decimal(value).cast("string"))


def signed_zero(json: Column, name: str, value: Column) -> Column:
    """JSON text that has the :func:`one_decimal` of ``value`` as its field ``name``, signed as printed."""
    signed = F.regexp_replace(json, f'("{name}":)0\\.0', "$1-0.0")
    return F.when(_minus_zero(value), signed).otherwise(json)


def micros_between(first: Column, last: Column) -> Column:
    return F.unix_micros(last) - F.unix_micros(first)


def to_bigint(total: Column) -> Column:
    """A whole number of any size as BIGINT; beyond its range, its nearest end. NULL stays NULL."""
    inside = F.least(F.greatest(total, F.lit(-(2**63))), F.lit(2**63 - 1))
    return F.when(total.isNotNull(), inside.cast("bigint"))


def wide(value: Column) -> Column:
    """A BIGINT whose sums can't overflow."""
    return value.cast("decimal(28,0)")


def total(value: Column) -> Column:
    """Sum of a BIGINT that never fails: it is exact, and beyond the range the range's end."""
    return to_bigint(F.sum(wide(value)))
