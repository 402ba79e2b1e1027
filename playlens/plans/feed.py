"""The globe feed from sessions and players to the finished place rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playlens.operators import globe
from playlens.sources.tables import with_fallback

FEED_COLUMNS = [
    "country", "city", "latitude", "longitude",
    "active_sessions", "player_count", "avg_session_duration",
]


def places_or_sample(
    sessions: DataFrame, players: DataFrame, sample: DataFrame, status: str = "completed", n: int = 500
) -> DataFrame:
    """Measured places, or the sample ones when no session is in `status`."""
    measured = globe.globe_measured(sessions, players, n, status).select(*FEED_COLUMNS)
    return with_fallback(measured, sample.select(*FEED_COLUMNS))


def globe_feed(
    sessions: DataFrame, players: DataFrame, sample: DataFrame, status: str = "completed", n: int = 500
) -> DataFrame:
    """Place rows with marker size and hover text, busiest first."""
    places = places_or_sample(sessions, players, sample, status, n)
    return globe.hover_text(globe.marker_size(places, "active_sessions")).orderBy(
        F.desc("active_sessions"), "city", "country"
    )
