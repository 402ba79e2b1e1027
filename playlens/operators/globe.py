"""The location feed: newest completed sessions per place, sizes, labels and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playlens.functions import numbers, texts
from playlens.operators.filters import completed

PLACE = ["latitude", "longitude", "city", "country"]
#: Rows that may be broadcast, of five columns each.
CANDIDATES = 100_000
#: No status; less than any, so that row groups are skipped by it.
NO_STATUS = ""


def _newest_first() -> list[Column]:
    return [F.desc("start_time"), F.desc("session_id")]


class _Held:
    """The newest n rows of a frame as one scalar of the plan, an array of n rows at most.

    Every look at it is the same subquery: the rows are found once, however often the plan
    uses them or asks how many there are.
    """

    def __init__(self, df: DataFrame, n: int, status: str):
        self.n, self.spark, self.status = n, df.sparkSession, status
        self.array = newest_of(df, n).agg(F.collect_list(F.struct("*"))).scalar()
        # The status to look for in all sessions: one that none has, when the rows suffice.
        self.wanted = self._by_need(status, NO_STATUS, 0)

    def _by_need(self, if_few: object, else_: object, row: int) -> Column:
        """A scalar, one of two values by whether there are fewer than n rows.

        Each is taken from a one-row range of its own (`row`). Spark would merge subqueries over the same
        rows into a struct, whose fields do not reach a scan as filters.
        """
        value = F.when(F.size(self.array) < self.n, F.lit(if_few)).otherwise(F.lit(else_))
        return self.spark.range(row, row + 1).select(value).scalar()

    def needed(self, sessions: DataFrame) -> DataFrame:
        """Sessions in the status if too few rows are held, otherwise none: the scan skips every row group."""
        return sessions.where((F.col("status") == self.wanted) & (self.wanted == self.status))

    def needed_players(self, players: DataFrame) -> DataFrame:
        """All players, likewise. All ids are at least the one number, and next to none the other."""
        if dict(players.dtypes)["player_id"] != "bigint":
            return players
        return players.where(F.col("player_id") >= self._by_need(-2**63, 2**63 - 1, 1))

    def rows_or(self, everything: DataFrame) -> DataFrame:
        """The rows if there are n, otherwise the newest n of `everything`."""
        rows = self.spark.range(1).select(F.inline(self.array)).where(self.wanted != self.status)
        return rows.unionByName(newest_of(everything, self.n))


def latest(
    sessions: DataFrame, n: int = 500, status: str = "completed", since: Column | None = None
) -> DataFrame:
    """The newest n sessions in one status; each task keeps n rows at most.

    `since` is a time from which there should be n sessions (`tables.newest_since`). Only if there
    are fewer, which the plan finds out, are older sessions read; the result is the same.
    """
    done = completed(sessions, status)
    if since is None:
        return newest_of(done, n)
    held = _Held(done.where(F.col("start_time") >= since), n, status)
    return held.rows_or(held.needed(sessions))


def latest_located(
    sessions: DataFrame,
    players: DataFrame,
    n: int = 500,
    status: str = "completed",
    margin: int = 4,
    since: Column | None = None,
) -> DataFrame:
    """The newest n sessions that have a player, with the player's place.

    Joining all sessions to all players only to keep n rows would shuffle both. The newest
    margin*n sessions, a set small enough to broadcast by construction, are looked up in one
    pass over the players. Only if fewer than n of them have a player are all sessions
    joined. The plan holds both branches and decides by a scalar count of the first; the
    second reads no row unless it is needed. The result is the same. Sessions without a start
    time come last, as in `latest`. `since` is a time from which there should be margin*n sessions.
    """
    if n * margin > CANDIDATES:
        raise ValueError(f"n * margin may be {CANDIDATES} at most, the rows that are broadcast")
    columns = ["session_id", "player_id", "start_time", "time_played_minutes"]
    places = players.select("player_id", *PLACE)
    near = completed(sessions, status)
    if since is not None:
        near = near.where(F.col("start_time") >= since)
    candidates = newest_of(near.select(*columns), margin * n)
    held = _Held(places.join(F.broadcast(candidates), "player_id"), n, status)
    return held.rows_or(held.needed(sessions).select(*columns).join(held.needed_players(places), "player_id"))


def newest_of(located: DataFrame, n: int) -> DataFrame:
    """The newest n of sessions that carry a place already."""
    return located.orderBy(*_newest_first()).limit(n)


def count_places(located: DataFrame) -> DataFrame:
    """Sessions per place; player count and duration as first published.

    There, the player count repeats the session count and the duration is the constant 45.0.
    `measure_places` gives the measured values.
    """
    return (
        located.groupBy(*PLACE)
        .agg(F.count(F.lit(1)).alias("active_sessions"))
        .withColumn("player_count", F.col("active_sessions"))
        .withColumn("avg_session_duration", F.lit(45.0).cast("decimal(3,1)"))
        .orderBy(F.desc("active_sessions"), "city", "country", "latitude", "longitude")
    )


def measure_places(located: DataFrame) -> DataFrame:
    """Sessions, distinct players and mean minutes per place."""
    return (
        located.groupBy(*PLACE)
        .agg(
            F.count(F.lit(1)).alias("active_sessions"),
            F.countDistinct("player_id").alias("player_count"),
            F.avg("time_played_minutes").alias("avg_session_duration"),
        )
        .orderBy(F.desc("active_sessions"), "city", "country", "latitude", "longitude")
    )


def globe(
    sessions: DataFrame, players: DataFrame, n: int = 500, status: str = "completed", since: Column | None = None
) -> DataFrame:
    """Places of the newest n sessions, as first published."""
    return count_places(latest_located(sessions, players, n, status, since=since))


def globe_measured(
    sessions: DataFrame, players: DataFrame, n: int = 500, status: str = "completed", since: Column | None = None
) -> DataFrame:
    """Places of the newest n sessions, measured."""
    return measure_places(latest_located(sessions, players, n, status, since=since))


def marker_size(places: DataFrame, column: str, base: int = 8, span: int = 35) -> DataFrame:
    """Scale `column` to a marker size between `base` and base + span.

    The limits are one scalar subquery over `places`; its last exchange is computed once.
    """
    limits = places.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    low, high = limits["low"], limits["high"]
    return places.withColumn(
        "marker_size", F.lit(base) + (F.col(column) - low) / (high - low + 1) * span
    )


def hover_text(places: DataFrame) -> DataFrame:
    return places.withColumn(
        "hover_text",
        texts.hover_label(
            F.col("city"), F.col("country"), F.col("active_sessions"),
            F.col("player_count"), F.col("avg_session_duration"),
        ),
    )


def kpis(places: DataFrame) -> DataFrame:
    """Sessions, places and the unweighted mean of the places' durations, with their texts."""
    return places.agg(
        F.coalesce(F.sum("active_sessions"), F.lit(0)).cast("bigint").alias("total_sessions"),
        F.count(F.lit(1)).alias("total_locations"),
        numbers.fixed_point_mean(F.col("avg_session_duration"), 1_000_000).alias("avg_duration"),
    ).select(
        "*",
        numbers.grouped_digits(F.col("total_sessions")).alias("total_sessions_text"),
        numbers.grouped_digits(F.col("total_locations")).alias("total_locations_text"),
        numbers.one_decimal(F.col("avg_duration")).alias("avg_duration_text"),
    )
