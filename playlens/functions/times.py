"""Date and time expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F


def as_date(day: dt.date) -> Column:
    return F.lit(day).cast("date")


def moment_like(value: dt.datetime | str, df: DataFrame, column: str) -> Column:
    """A constant of the column's own type, so that a comparison with it reaches the scan."""
    return F.lit(str(value)).cast(df.schema[column].dataType)


def month_of(moment: Column) -> Column:
    return F.trunc(moment, "month")


def minutes_after(moment: Column, minutes: Column) -> Column:
    return moment + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def growth_phase(created: Column, start: dt.date) -> Column:
    """1 in the first two months of 30 days after `start`, 2 in the next two, then 3; null for null."""
    months = F.datediff(created, as_date(start)) / 30
    return F.when(months < 2, 1).when(months < 4, 2).when(months >= 4, 3).cast("int")


def activity_end(created: Column, last_login: Column, as_of: dt.date) -> Column:
    """End of a player's active span: at least one day after the first."""
    end = F.least(last_login, as_date(as_of))
    return F.when(end <= created, F.date_add(created, 1)).otherwise(end)


def local_time_text(moment: Column, offset: str, label: str) -> Column:
    """UTC moment as `yyyy-MM-dd HH:mm:ss LABEL` at a fixed offset."""
    shifted = F.convert_timezone(F.lit("UTC"), F.lit(offset), moment)
    return F.concat(F.date_format(shifted, "yyyy-MM-dd HH:mm:ss"), F.lit(f" {label}"))


def long_date_text(moment: Column) -> Column:
    """January 30, 2024 at 11:57 PM."""
    return F.date_format(moment, "MMMM dd, yyyy 'at' hh:mm a")
