"""From raw domain frames to the six final tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from playlens.operators import cohorts, joins
from playlens.session import remove
from playlens.sources import tables
from playlens.sources.schemas import RAW_PLAYERS

CLUSTERING = {"sessions": ["start_time", "session_id"]}


def save_warehouse(
    spark: SparkSession, raw: dict[str, DataFrame], folder: str, as_of: dt.date, region: str
) -> dict[str, str]:
    """Save players, islands, sessions, transactions, cohorts and player_cohorts as one snapshot.

    Raw players, which carry the helper column region, and raw islands go to a staging
    folder first. Lifetime spend, plays and memberships are then derived from what is stored, so
    neither a lost executor nor a second derived table computes the raw frames again. Beside the
    tables lie the time bounds of the sessions. Staging is removed at the end; the snapshot counts
    only once it is whole. Returns name -> path.
    """
    stored = {name: tables.with_zone(df) for name, df in raw.items()}
    snapshot = tables.new_snapshot(folder)
    staging = f"{snapshot}-staging"
    try:
        tables.save_tables({name: stored[name] for name in ("players", "islands")}, staging)
        paths = tables.save_tables(
            {name: stored[name] for name in ("sessions", "transactions", "cohorts")}, snapshot, CLUSTERING
        )
        players = tables.scan(spark, staging, "players", RAW_PLAYERS)
        islands = tables.scan(spark, staging, "islands")
        sessions = tables.scan(spark, snapshot, "sessions")
        transactions = tables.scan(spark, snapshot, "transactions")
        derived = {
            "players": cohorts.finalize_players(players, transactions),
            "islands": joins.total_plays(islands, sessions),
            "player_cohorts": cohorts.assign_cohorts(players, transactions, as_of, region),
        }
        paths |= tables.save_tables(derived, snapshot)
        tables.save_time_bounds(sessions, snapshot)
    except BaseException:
        remove(spark, snapshot)
        raise
    finally:
        remove(spark, staging)
    tables.publish(spark, folder, snapshot)
    return paths
