"""Grouped and global aggregates.

Totals that a percentage needs come from a scalar subquery: no one-row join and no window
over everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playlens.functions import numbers, times
from playlens.operators.filters import in_countries, positive


def _rows(alias: str):
    return F.count(F.lit(1)).alias(alias)


def monthly_new(players: DataFrame, countries: list[str]) -> DataFrame:
    """New players per month and country."""
    return (
        in_countries(players, countries)
        .groupBy(times.month_of(F.col("create_date")).alias("month"), "country")
        .agg(_rows("new_players"))
        .orderBy("month", F.desc("new_players"), "country")
    )


def by_device(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("device_type").agg(
        _rows("sessions"), F.avg("time_played_minutes").alias("avg_minutes")
    )


def revenue_by_country(transactions: DataFrame, players: DataFrame) -> DataFrame:
    """Distinct payers and revenue per country, highest revenue first.

    Payments are totalled per player before the join, so the payer count is a row count.
    """
    spend = positive(transactions).groupBy("player_id").agg(F.sum("amount").alias("cents"))
    return (
        spend.join(players.select("player_id", "country"), "player_id")
        .groupBy("country")
        .agg(_rows("paying_players"), numbers.currency(F.sum("cents")).alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "country")
    )


def with_percent(some: DataFrame, part: str, counts: DataFrame) -> DataFrame:
    """Add `pct`: the share of `part` in its sum over `counts`, of which `some` are rows.

    The sum is over groups, whose exchange is computed once for both.
    """
    total = counts.agg(F.sum(part)).scalar()
    return some.withColumn("pct", numbers.percent(F.col(part), total))


def by_country(players: DataFrame, n: int = 10) -> DataFrame:
    """The n countries with most players and their share of all players."""
    counts = players.groupBy("country").agg(_rows("players"))
    top = counts.orderBy(F.desc("players"), "country").limit(n)
    return with_percent(top, "players", counts).orderBy(F.desc("players"), "country")


def device_distribution(players: DataFrame) -> DataFrame:
    counts = players.groupBy("device_type").agg(_rows("players"))
    return with_percent(counts, "players", counts).orderBy(F.desc("players"), "device_type")


def total_revenue(transactions: DataFrame) -> DataFrame:
    return positive(transactions).agg(
        numbers.currency(F.coalesce(F.sum("amount"), F.lit(0))).alias("total_revenue")
    )


def paying_share(transactions: DataFrame, players: DataFrame) -> DataFrame:
    """Players with any transaction, all players and the percentage."""
    payers = transactions.agg(F.countDistinct("player_id").alias("paying_players"))
    everyone = players.agg(_rows("players")).scalar()
    return payers.withColumn("players", everyone).withColumn(
        "pct", numbers.percent(F.col("paying_players"), F.col("players"))
    )


def cohort_sizes(player_cohorts: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Members per cohort, by name."""
    sizes = player_cohorts.groupBy("cohort_id").agg(_rows("size"))
    names = cohorts.select("cohort_id", "name")
    return sizes.join(names, "cohort_id").select("cohort_id", "name", "size").orderBy("cohort_id")


def monthly_revenue(transactions: DataFrame) -> DataFrame:
    return (
        positive(transactions)
        .groupBy(times.month_of(F.col("timestamp")).alias("month"))
        .agg(numbers.currency(F.sum("amount")).alias("revenue"))
        .orderBy("month")
    )
