"""Equi-joins, lookups and membership tests.

Wherever a join feeds on facts only to total them, the facts are aggregated on the join key
first, so both sides are unique on it and a hot key is combined on the map side. Row-level
joins keep one row per fact; AQE splits a skewed partition of those by map output. No side
is hinted as broadcast: Spark decides by size, which it knows for the constant tables and
measures for the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playlens.operators.filters import completed, positive


def with_location(sessions: DataFrame, players: DataFrame, status: str = "completed") -> DataFrame:
    """Sessions in one status with their player's place."""
    places = players.select("player_id", "city", "country", "latitude", "longitude")
    return completed(sessions, status).join(places, "player_id")


def payments(transactions: DataFrame, players: DataFrame) -> DataFrame:
    """Positive transactions with their player's country."""
    return positive(transactions).join(players.select("player_id", "country"), "player_id")


def total_plays(islands: DataFrame, sessions: DataFrame) -> DataFrame:
    """Islands with their number of sessions; 0 without any."""
    plays = sessions.groupBy("island_id").agg(F.count(F.lit(1)).alias("plays"))
    return (
        islands.drop("total_plays")
        .join(plays, "island_id", "left")
        .withColumn("total_plays", F.coalesce("plays", F.lit(0)).cast("bigint"))
        .drop("plays")
    )


def lifetime_spend(players: DataFrame, transactions: DataFrame) -> DataFrame:
    """Players with their positive spend in cents; 0 without any."""
    spend = positive(transactions).groupBy("player_id").agg(F.sum("amount").alias("spend"))
    return (
        players.join(spend, "player_id", "left")
        .withColumn("lifetime_spend", F.coalesce("spend", F.lit(0)).cast("bigint"))
        .drop("spend")
    )


def payer_ids(transactions: DataFrame, kind: str | None = None) -> DataFrame:
    """Players with any transaction, refunds included, or with one of a kind."""
    if kind is not None:
        transactions = transactions.where(F.col("type") == kind)
    return transactions.select("player_id").distinct()


def paying(
    players: DataFrame, transactions: DataFrame, anti: bool = False, kind: str | None = None
) -> DataFrame:
    """Players with a transaction (of a kind), or with none when `anti`."""
    return players.join(payer_ids(transactions, kind), "player_id", "left_anti" if anti else "left_semi")


def named_members(player_cohorts: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Memberships with cohort names."""
    return player_cohorts.join(cohorts.select("cohort_id", "name"), "cohort_id")


def reference_time(players: DataFrame, transactions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Payers with their newest session start, or their sign-up date without a session."""
    latest = sessions.groupBy("player_id").agg(F.max("start_time").alias("latest"))
    signed_up = F.col("create_date").cast(sessions.schema["start_time"].dataType)
    return (
        paying(players, transactions)
        .join(latest, "player_id", "left")
        .select(
            "player_id",
            F.coalesce("latest", signed_up).alias("reference_time"),
        )
    )


def player_region(players: DataFrame, countries: DataFrame, regions: DataFrame) -> DataFrame:
    """Players with the region of their country; unknown countries stay, without one.

    `countries` has (country, region_id), `regions` (region_id, region). They are looked up one after
    the other: Spark knows the size of each, but would take their join for as large as
    the product and shuffle all players by country.
    """
    return players.drop("region").join(countries, "country", "left").join(regions, "region_id", "left").drop("region_id")
