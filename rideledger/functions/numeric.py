"""Numbers: exact rounding, shares, sums that do not depend on row order, minutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rideledger.fixed_values import NUMBER_TEXT

EXACT = "decimal(38,12)"


def half_even(value: Column, digits: int) -> Column:
    """Round a double to ``digits`` decimals, judging ties on its exact binary value.

    ``0.125`` becomes 0.12 and ``2.675`` (stored just below) becomes 2.67. The value
    is split into two parts whose products with the power of ten are exact, so the
    comparison with one half is exact too.
    """
    scale = float(10**digits)
    head = value.cast("float").cast("double")
    tail = value - head
    whole = F.floor(value * scale).cast("double")
    beyond_half = (head * scale - whole - F.lit(0.5)) + tail * scale
    is_odd = F.pmod(whole, F.lit(2.0)) != 0
    up = (beyond_half > 0) | ((beyond_half == 0) & is_odd)
    return F.when(up, whole + 1).otherwise(whole) / F.lit(scale)


def share(part: Column, whole: Column, digits: int) -> Column:
    """``part`` as a percentage of ``whole``; 0.0 when there is no whole."""
    ratio = F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.coalesce(half_even(ratio, digits), F.lit(0.0))


def number(text: Column) -> Column:
    """Number in a text, NULL when the text is none."""
    value = text.cast("string")
    return F.when(value.rlike(NUMBER_TEXT), value.try_cast("double"))


def exact_sum(value: Column) -> Column:
    """Sum of doubles. It does not depend on the order of rows as long as decimals can hold it.

    Values of up to 26 digits before and 12 after the point are summed as decimals, without any
    loss. Where a group has a value that is larger, finer, infinite or NaN, or its sum grows
    too large, the sum is the one of doubles: nothing is cut and nothing fails.
    """
    number = value.cast("double")
    exact = number.try_cast(EXACT)
    held = F.min(F.when(number.isNotNull(), F.coalesce(exact.cast("double") == number, F.lit(False))))
    return F.coalesce(F.when(held, F.try_sum(exact).cast("double")), F.sum(number))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of ``value`` weighted by ``weight`` over rows that have a value; NULL without weight."""
    has_value = value.isNotNull()
    product = exact_sum(F.when(has_value, value.cast("double") * weight.cast("double")))
    return product / F.nullif(exact_sum(F.when(has_value, weight)), F.lit(0.0))


def minutes_between(start_s: Column, end_s: Column) -> Column:
    """Minute boundaries crossed between two times of day in seconds (never wraps at midnight)."""
    return F.floor(end_s / 60) - F.floor(start_s / 60)


def elapsed_minutes(start_s: Column, end_s: Column) -> Column:
    """Elapsed whole minutes between two times of day, truncated toward zero."""
    return ((end_s - start_s) / 60).cast("int")
