"""Island, creator and player panels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from playlens.functions import numbers, times
from playlens.operators.joins import total_plays


def cards(islands: DataFrame, sessions: DataFrame) -> DataFrame:
    """Plays, rating and mean session minutes per island."""
    per_island = sessions.groupBy("island_id").agg(
        F.count(F.lit(1)).alias("plays"), F.avg("time_played_minutes").alias("minutes")
    )
    return islands.join(per_island, "island_id", "left").select(
        "island_id",
        "island_name",
        F.coalesce("plays", F.lit(0)).cast("bigint").alias("total_plays"),
        "avg_rating",
        F.round("minutes", 1).alias("avg_minutes"),
    )


def active_7d(islands: DataFrame, sessions: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Distinct players per island in the `days` up to `as_of`; 0 without any."""
    since = times.moment_like(as_of - dt.timedelta(days=days), sessions, "start_time")
    until = times.moment_like(as_of, sessions, "start_time")
    active = (
        sessions.where((F.col("start_time") > since) & (F.col("start_time") <= until))
        .groupBy("island_id")
        .agg(F.countDistinct("player_id").alias("players"))
    )
    return islands.join(active, "island_id", "left").select(
        "island_id", F.coalesce("players", F.lit(0)).cast("bigint").alias("active_players")
    )


def _roll_up(spans: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Merge (net, top) of consecutive spans into those of the enclosing one.

    net is the change over a span, top the highest level reached inside it, both counted
    from the level at its start.
    """
    earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum("net").over(earlier), F.lit(0))
    return (
        spans.withColumn("level", level)
        .groupBy(*keys)
        .agg(F.sum("net").alias("net"), F.max(F.col("level") + F.col("top")).alias("top"))
    )


def peak_concurrency(sessions: DataFrame) -> DataFrame:
    """Most sessions open at once per island, over half-open [start, end).

    Starts and ends are dealt once by island and minute, so that a hot island is spread over its
    minutes. Netting and the running sum within a minute need no other exchange; one
    row per minute goes on to the day (1,440 of them at most), and one per day to the island.
    """
    edges = sessions.select(
        "island_id",
        F.inline(
            F.array(
                F.struct(F.col("start_time").alias("at"), F.lit(1).alias("net")),
                F.struct(F.col("end_time").alias("at"), F.lit(-1).alias("net")),
            )
        ),
    ).withColumn("minute", F.date_trunc("minute", "at"))
    instants = (
        edges.repartition("island_id", "minute")
        .groupBy("island_id", "minute", "at")
        .agg(F.sum("net").alias("net"))
        .withColumn("top", F.col("net"))
    )
    minutes = _roll_up(instants, ["island_id", "minute"], "at").withColumn("day", F.col("minute").cast("date"))
    days = _roll_up(minutes, ["island_id", "day"], "minute")
    return _roll_up(days, ["island_id"], "day").select(
        "island_id", F.greatest("top", F.lit(0)).cast("bigint").alias("peak_concurrent")
    )


def portfolio(islands: DataFrame, sessions: DataFrame) -> DataFrame:
    """Plays, unweighted mean rating and distinct players over each creator's islands.

    Sessions shrink to one row per island and player before they meet the islands.
    """
    visits = sessions.groupBy("island_id", "player_id").agg(F.count(F.lit(1)).alias("plays"))
    fans = (
        visits.join(islands.select("island_id", "creator_player_id"), "island_id")
        .groupBy("creator_player_id", "player_id")
        .agg(F.sum("plays").alias("plays"))
    )
    played = fans.groupBy("creator_player_id").agg(
        F.sum("plays").alias("plays"), F.count("player_id").alias("players")
    )
    rated = islands.groupBy("creator_player_id").agg(
        numbers.fixed_point_mean(F.col("avg_rating"), 100).alias("avg_rating")
    )
    return rated.join(played, "creator_player_id", "left").select(
        "creator_player_id",
        F.coalesce("plays", F.lit(0)).cast("bigint").alias("total_plays"),
        "avg_rating",
        F.coalesce("players", F.lit(0)).cast("bigint").alias("unique_players"),
    )


def island_rollup(sessions: DataFrame) -> DataFrame:
    """Plays and minutes per island and in total.

    The rollup runs over the per-island rows: expanding the sessions would double them.
    """
    per_island = sessions.groupBy("island_id").agg(
        F.count(F.lit(1)).alias("plays"), F.sum("time_played_minutes").alias("minutes")
    )
    return (
        per_island.rollup("island_id")
        .agg(
            F.grouping("island_id").cast("int").alias("is_total"),
            F.sum("plays").alias("plays"),
            F.sum("minutes").alias("minutes"),
        )
    )


def leaderboard(sessions: DataFrame, n: int = 6) -> DataFrame:
    """The n players with most sessions, ranked."""
    best = (
        sessions.groupBy("player_id")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            (F.sum("time_played_minutes") / 60).alias("total_hours"),
            F.avg((F.col("status") == "completed").cast("int")).alias("completion_rate"),
        )
        .orderBy(F.desc("sessions"), "player_id")
        .limit(n)
    )
    # n rows by now, so one window partition is as large as the report.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("sessions"), "player_id")
    return best.select(F.row_number().over(order).alias("rank"), "*")


def favorite(sessions: DataFrame) -> DataFrame:
    """Each player's most played island, the smaller id on a tie."""
    plays = sessions.groupBy("player_id", "island_id").agg(F.count(F.lit(1)).alias("plays"))
    best = F.max(F.struct(F.col("plays"), (-F.col("island_id")).alias("negated"))).alias("best")
    return plays.groupBy("player_id").agg(best).select(
        "player_id", (-F.col("best.negated")).alias("island_id"), "best.plays"
    )


def best_rated(islands: DataFrame) -> DataFrame:
    return (
        islands.select("island_id", "island_name", "avg_rating")
        .orderBy(F.desc("avg_rating"), "island_id")
        .limit(1)
    )


def top_islands(islands: DataFrame, sessions: DataFrame, n: int = 10) -> DataFrame:
    """The n most played islands."""
    return (
        total_plays(islands, sessions)
        .orderBy(F.desc("total_plays"), "island_id")
        .limit(n)
        .select("island_name", "category", "total_plays", "avg_rating")
    )


def minimums(islands: DataFrame, sessions: DataFrame) -> DataFrame:
    """Fewest plays and lowest rating over all islands."""
    return total_plays(islands, sessions).agg(
        F.min("total_plays").alias("min_plays"), F.min("avg_rating").alias("min_rating")
    )


def region_share(players: DataFrame, start: dt.date, weights: DataFrame) -> DataFrame:
    """Measured share of each region per growth phase next to the expected one.

    The window runs over one row per phase and region.
    """
    phase = times.growth_phase(F.col("create_date"), start).alias("phase")
    counts = players.groupBy(phase, "region").agg(F.count(F.lit(1)).alias("players"))
    total = F.sum("players").over(Window.partitionBy("phase"))
    return (
        counts.withColumn("share", numbers.ratio(F.col("players"), total))
        .join(weights, ["phase", "region"], "left")
        .orderBy("phase", "region")
    )


def peak_hours(sessions: DataFrame, players: DataFrame) -> DataFrame:
    """Sessions per region and hour of day.

    A player's sessions shrink to 24 rows at most before the join.
    """
    hours = sessions.groupBy("player_id", F.hour("start_time").alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        hours.join(players.select("player_id", "region"), "player_id")
        .groupBy("region", "hour")
        .agg(F.sum("n").alias("sessions"))
        .orderBy("region", "hour")
    )


def churn_rate(players: DataFrame, as_of: dt.date, days: int = 14) -> DataFrame:
    gone = times.days_between(times.as_date(as_of), F.col("last_login_date")) >= days
    return (
        players.groupBy("country")
        .agg(
            F.count(F.lit(1)).alias("players"),
            F.coalesce(F.sum(gone.cast("bigint")), F.lit(0)).cast("bigint").alias("churned"),
        )
        .withColumn("churn_rate", numbers.ratio(F.col("churned"), F.col("players")))
        .orderBy("country")
    )
