"""Rounding, clamping and lenient number parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards +infinity (Spark's round goes away from zero)."""
    return F.floor(x + F.lit(0.5))


def half_up_to(x: Column, digits: int) -> Column:
    scale = 10.0**digits
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(num: Column, den: Column) -> Column:
    """num/den as double, NULL when the denominator is zero (ANSI mode would raise)."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def clamp_100(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))


def int_prefix(c: Column) -> Column:
    """Leading integer of a text, NULL when there is none."""
    digits = F.regexp_extract(F.trim(c.cast("string")), r"^\s*([+-]?\d+)", 1)
    return digits.try_cast("bigint")


def int_or_zero(c: Column) -> Column:
    return F.coalesce(int_prefix(c), F.lit(0).cast("bigint"))


def number(c: Column) -> Column:
    """Text or number as double; blank and unparsable text give NULL."""
    return F.trim(c.cast("string")).try_cast("double")
