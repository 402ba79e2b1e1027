"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high))).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """Unrounded percentage as double; null when the whole is zero."""
    return F.try_divide(part.cast("double") * 100, whole)


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def currency(cents: Column) -> Column:
    return cents / 100


def grouped_digits(value: Column) -> Column:
    """1234567 -> 1,234,567."""
    return F.format_number(value, 0)


def one_decimal(value: Column) -> Column:
    """45.25 -> 45.2 (half-even on the binary value, no thousands separator)."""
    return F.replace(F.format_number(value, 1), F.lit(","), F.lit(""))


def fixed_point_mean(value: Column, scale: int) -> Column:
    """Mean of doubles, added up as integers of 1/scale.

    Integer addition is associative, so the result does not depend on how rows are split
    over tasks.
    """
    return F.sum(F.round(value * scale).cast("bigint")) / F.lit(float(scale)) / F.count(value)
