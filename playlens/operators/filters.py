"""Row filters and their projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from playlens.functions import texts, times


def completed(sessions: DataFrame, status: str = "completed") -> DataFrame:
    return sessions.where(F.col("status") == status)


def positive(transactions: DataFrame) -> DataFrame:
    """Payments without refunds."""
    return transactions.where(F.col("amount") > 0)


def in_countries(players: DataFrame, countries: list[str]) -> DataFrame:
    return players.where(F.col("country").isin(*countries))


def churned(players: DataFrame, as_of: dt.date, days: int = 14) -> DataFrame:
    """Players not seen for `days` or more, longest absence first.

    The player id in the sort key keeps a frequent day count from filling one sort
    partition.
    """
    idle = times.days_between(times.as_date(as_of), F.col("last_login_date"))
    return (
        players.select(
            "player_id", "city", "country", "last_login_date", idle.alias("days_inactive")
        )
        .where(F.col("days_inactive") >= days)
        .orderBy(F.desc("days_inactive"), "player_id")
    )


def recently_active(players: DataFrame, as_of: dt.date, days: int = 14) -> DataFrame:
    """Strict complement of `churned`."""
    return players.where(F.col("last_login_date") > times.as_date(as_of - dt.timedelta(days=days)))


def nonblank(turns: DataFrame) -> DataFrame:
    """Chat turns with at least one visible character."""
    return turns.where(texts.has_text(F.col("content")))
