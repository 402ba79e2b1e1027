"""Row-wise derivations over the domain tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from playlens.functions import numbers, texts, times


def clamp_minutes(sessions: DataFrame, column: str, low: int = 3, high: int = 120) -> DataFrame:
    return sessions.withColumn("time_played_minutes", numbers.clamp(F.col(column), low, high))


def end_times(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn(
        "end_time", times.minutes_after(F.col("start_time"), F.col("time_played_minutes"))
    )


def session_window_of(players: DataFrame, as_of: dt.date) -> DataFrame:
    """Days between which each player's sessions can lie."""
    end = times.activity_end(F.col("create_date"), F.col("last_login_date"), as_of)
    return players.select(
        "player_id", F.col("create_date").alias("window_start"), end.alias("window_end")
    ).withColumn("window_days", times.days_between(F.col("window_end"), F.col("window_start")))


def name_islands(islands: DataFrame) -> DataFrame:
    return islands.withColumn("island_name", texts.island_label(F.col("category"), F.col("island_id")))


def local_times(sessions: DataFrame, offset: str = "-05:00", label: str = "EST") -> DataFrame:
    return sessions.withColumn(
        "local_time", times.local_time_text(F.col("start_time"), offset, label)
    )


def long_dates(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("long_date", times.long_date_text(F.col("start_time")))


def growth_phases(players: DataFrame, start: dt.date, weights: DataFrame) -> DataFrame:
    """Growth phase at sign-up and the region share expected in it; null without a weight.

    `weights` is the (phase, region, expected_weight) table.
    """
    phase = times.growth_phase(F.col("create_date"), start)
    return players.withColumn("phase", phase).join(weights, ["phase", "region"], "left")
