"""Cohort membership, final player attributes and draw weights."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from playlens.functions import times
from playlens.operators.joins import lifetime_spend, payer_ids


def assign_cohorts(
    players: DataFrame, transactions: DataFrame, as_of: dt.date, region: str
) -> DataFrame:
    """One (player, cohort) row per rule that holds.

    Veteran and new exclude each other, as do binge and casual; the rest are independent.
    """
    spenders = payer_ids(transactions).withColumn("has_paid", F.lit(True))
    today = times.as_date(as_of)
    age = times.days_between(today, F.col("create_date"))
    idle = times.days_between(today, F.col("last_login_date"))
    played = F.col("total_time_played")
    rules = F.array(
        F.when(F.col("player_level") >= 20, 1).when(age < 30, 2),
        F.when(F.col("has_paid"), 3),
        F.when(F.col("device_type") == "mobile", 4),
        F.when(F.col("region") == region, 5),
        F.when(idle >= 14, 6),
        F.when(played > 500, 7).when(played < 100, 8),
    )
    return players.join(spenders, "player_id", "left").select(
        "player_id", F.explode(F.array_compact(rules).cast("array<bigint>")).alias("cohort_id")
    )


def finalize_players(players: DataFrame, transactions: DataFrame) -> DataFrame:
    """Players with lifetime spend and without the helper column region."""
    return lifetime_spend(players, transactions).drop("region")


def session_weights(
    players: DataFrame, as_of: dt.date, factor: int = 5, days: int = 14
) -> DataFrame:
    """Draw weight per player, `factor` for recent ones, and its share of the total."""
    recent = F.col("last_login_date") > times.as_date(as_of - dt.timedelta(days=days))
    weighted = players.select(
        "player_id", F.when(recent, float(factor)).otherwise(1.0).alias("weight")
    )
    total = weighted.agg(F.sum("weight")).scalar()
    return weighted.withColumn("probability", F.col("weight") / total)
