"""Registry: query name -> report over the tables in a data folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playlens.operators import (
    aggregates, chat, cohorts, derive, filters, globe, joins, panels, sampling,
)
from playlens.plans import feed, warehouse
from playlens.session import workspace
from playlens.sources import bindings, dimensions, tables
from playlens.sources.bindings import COHORT_REGION, COUNTRIES, END, KIND, SESSIONS_AS_OF, START, Bindings
from playlens.sources.schemas import DOMAIN
from playlens.streaming import activity

SEED = 42
SESSION_COLUMNS = [
    "session_id", "player_id", "start_time", "end_time", "ip_address", "island_id", "score",
    "objectives_completed", "deaths", "eliminations", "time_played_minutes", "status", "device_type",
]


def _saved(b: Bindings) -> str:
    """The six final tables, saved; returns their folder."""
    folder = workspace(b.spark, "tables")
    raw = {name: df for name, df in b.tables.items() if name != "player_cohorts"}
    warehouse.save_warehouse(b.spark, raw, folder, END, COHORT_REGION)
    return tables.current(b.spark, folder)


def _stored(b: Bindings) -> dict[str, DataFrame]:
    """The six final tables, saved and scanned."""
    folder = _saved(b)
    return {name: tables.scan(b.spark, folder, name) for name in DOMAIN}


def _stored_with_bounds(b: Bindings, rows: int) -> tuple[DataFrame, DataFrame, Column]:
    """Stored sessions and players, and a time since which there are so many completed sessions."""
    folder = _saved(b)
    bounds = b.spark.read.parquet(f"{folder}/time_bounds")
    return tables.scan(b.spark, folder, "sessions"), tables.scan(b.spark, folder, "players"), tables.newest_since(bounds, rows)


def _stored_latest(b: Bindings) -> DataFrame:
    sessions, _, since = _stored_with_bounds(b, 500)
    return globe.latest(sessions, 500, since=since).select("session_id", "player_id", F.col("start_time").cast("timestamp_ntz"))


def _stored_globe(b: Bindings) -> DataFrame:
    sessions, players, since = _stored_with_bounds(b, 2000)
    return globe.globe_measured(sessions, players, since=since)


def _catalog(b: Bindings) -> str:
    """The domain tables as managed tables of a new schema in the session's catalog, bucketed by player."""
    place = workspace(b.spark, "catalog")
    schema = "play_" + place[-32:]
    b.spark.sql(f"CREATE SCHEMA {schema} LOCATION '{place}'")
    by_player = {name: (8, "player_id") for name in ("players", "sessions", "transactions", "player_cohorts")}
    tables.save_catalog_tables({name: tables.with_zone(df) for name, df in b.tables.items()}, schema, by_player)
    return schema


def _catalog_join(b: Bindings) -> DataFrame:
    schema = _catalog(b)
    sessions, players = (tables.scan_catalog(b.spark, schema, name) for name in ("sessions", "players"))
    return joins.with_location(sessions, players).select(
        "session_id", "player_id", "city", "country", "latitude", "longitude"
    )


def _as_text(name: str, df: DataFrame) -> DataFrame:
    """(table_name, row_text): all columns of a table in one, times as microseconds."""
    columns = [F.unix_micros(c) if kind == "timestamp" else F.col(c) for c, kind in sorted(df.dtypes)]
    return df.select(F.lit(name).alias("table_name"), F.concat_ws("|", *(c.cast("string") for c in columns)).alias("row_text"))


def _stored_rows(b: Bindings) -> DataFrame:
    return reduce(DataFrame.unionByName, (_as_text(name, df) for name, df in _stored(b).items()))


def _stored_region_hours(b: Bindings) -> DataFrame:
    """Peak hours over tables as any user would scan them: stored players have no region."""
    stored = _stored(b)
    return panels.peak_hours(stored["sessions"], joins.player_region(stored["players"], b.countries, b.regions))


def _after_the_newest(b: Bindings) -> DataFrame:
    """Sessions that start after the newest one, i.e. none; only the data tell."""
    newest = b.sessions.agg(F.max("start_time")).scalar()
    return b.sessions.where(F.col("start_time") > newest)


def _events_stream(b: Bindings) -> tuple[SparkSession, DataFrame]:
    session = activity.utc_session(b.spark)
    # Braces make this a pattern, which a file stream takes for one file as well as a folder.
    events = activity.read_stream(session, f"{b.folder}/{{events}}.parquet", bindings.RAW["events"])
    return session, bindings.sessions_from_events(events)


def _stream_windows(b: Bindings) -> DataFrame:
    _, sessions = _events_stream(b)
    target = workspace(b.spark, "windows")
    counts = activity.active_sessions(sessions)
    activity.refresh_windows(counts, target, workspace(b.spark, "windows-state")).awaitTermination()
    return activity.running_result(b.spark, target)


def _stream_closed_windows(b: Bindings) -> DataFrame:
    _, sessions = _events_stream(b)
    target = workspace(b.spark, "closed-windows")
    counts = activity.active_sessions(sessions)
    activity.append_windows(counts, target, workspace(b.spark, "closed-windows-state")).awaitTermination()
    return b.spark.read.schema(counts.schema).parquet(target)


def _stream_locations(b: Bindings) -> DataFrame:
    session, sessions = _events_stream(b)
    target = workspace(b.spark, "locations")
    activity.refresh_location_counts(
        sessions, Bindings(session, b.folder).players, target, workspace(b.spark, "locations-state")
    ).awaitTermination()
    return activity.running_result(b.spark, target)


def _stream_globe(b: Bindings) -> DataFrame:
    session, sessions = _events_stream(b)
    target = workspace(b.spark, "newest")
    activity.refresh_newest(
        sessions, Bindings(session, b.folder).players, target, workspace(b.spark, "newest-state")
    ).awaitTermination()
    return globe.measure_places(activity.running_result(b.spark, target))


def _measured(b: Bindings) -> DataFrame:
    return globe.globe_measured(b.sessions, b.players)


REPORTS: dict[str, Callable[[Bindings], DataFrame]] = {
    # Sources and sinks
    "scan_sessions": lambda b: b.sessions.select(*SESSION_COLUMNS),
    "save_tables_roundtrip": lambda b: _stored(b)["player_cohorts"],
    "saved_tables": _stored_rows,
    "saved_peak_hours": _stored_region_hours,
    "table_row_counts": lambda b: tables.table_row_counts(_stored(b)),
    "stored_latest_sessions": _stored_latest,
    "stored_globe": _stored_globe,
    "catalog_row_counts": lambda b: tables.catalog_row_counts(b.spark, _catalog(b)),
    "catalog_sessions_with_location": _catalog_join,
    "globe_with_fallback": lambda b: feed.places_or_sample(
        _after_the_newest(b), b.players, dimensions.sample_locations(b.spark)
    ),
    # Filters
    "completed_sessions": lambda b: filters.completed(b.sessions).select(
        "session_id", "player_id", "start_time"
    ),
    "positive_transactions": lambda b: filters.positive(b.transactions).select(
        "transaction_id", "player_id", "amount"
    ),
    "players_in_countries": lambda b: filters.in_countries(b.players, COUNTRIES).select(
        "player_id", "country"
    ),
    "churned_players": lambda b: filters.churned(b.players, END),
    "recently_active_players": lambda b: filters.recently_active(b.players, END).select(
        "player_id", "last_login_date"
    ),
    "nonblank_messages": lambda b: filters.nonblank(b.turns).select("conv_id", "turn", "role"),
    # Derived columns
    "globe_marker_size": lambda b: globe.marker_size(
        globe.globe(b.sessions, b.players), "active_sessions"
    ).select("city", "active_sessions", "marker_size"),
    "globe_hover_text": lambda b: globe.hover_text(_measured(b)).select("city", "hover_text"),
    "clamped_durations": lambda b: derive.clamp_minutes(b.sessions, "raw_minutes").select(
        "session_id", "raw_minutes", "time_played_minutes"
    ),
    "session_end_times": lambda b: derive.end_times(b.sessions).select("session_id", "end_time"),
    "player_session_window": lambda b: derive.session_window_of(b.players, END),
    "island_names": lambda b: derive.name_islands(b.islands).select("island_id", "island_name"),
    "player_growth_phase": lambda b: derive.growth_phases(b.players, START, b.phase_weights).select(
        "player_id", "phase", "expected_weight"
    ),
    "session_local_time": lambda b: derive.local_times(b.sessions).select("session_id", "local_time"),
    "session_long_date": lambda b: derive.long_dates(b.sessions).select("session_id", "long_date"),
    "agent_response_text": lambda b: chat.response_text(b.responses, "status").select("conv_id", "turn", "answer"),
    "conversation_payload": lambda b: chat.conversation_payload(b.turns),
    # Joins
    "sessions_with_location": lambda b: joins.with_location(b.sessions, b.players).select(
        "session_id", "player_id", "city", "country", "latitude", "longitude"
    ),
    "payments_with_country": lambda b: joins.payments(b.transactions, b.players).select(
        "transaction_id", "player_id", "country", "amount"
    ),
    "island_total_plays": lambda b: joins.total_plays(b.islands, b.sessions).select(
        "island_id", "total_plays"
    ),
    "player_lifetime_spend": lambda b: joins.lifetime_spend(b.players, b.transactions).select(
        "player_id", "lifetime_spend"
    ),
    "paying_players": lambda b: joins.paying(b.players, b.transactions).select("player_id"),
    "nonpaying_players": lambda b: joins.paying(b.players, b.transactions, anti=True).select("player_id"),
    "players_without_kind": lambda b: joins.paying(b.players, b.transactions, anti=True, kind=KIND).select("player_id"),
    "cohort_members_named": lambda b: joins.named_members(b.player_cohorts, b.cohorts).select(
        "player_id", "cohort_id", "name"
    ),
    "payer_reference_time": lambda b: joins.reference_time(b.players, b.transactions, b.sessions),
    "player_region": lambda b: joins.player_region(b.players, b.countries, b.regions).select(
        "player_id", "country", "region"
    ),
    # Aggregates
    "active_players_globe": lambda b: globe.globe(b.sessions, b.players),
    "active_players_globe_measured": _measured,
    "globe_feed": lambda b: feed.globe_feed(
        b.sessions, b.players, dimensions.sample_locations(b.spark)
    ),
    "monthly_new_players_by_country": lambda b: aggregates.monthly_new(b.players, COUNTRIES),
    "session_metrics_by_device": lambda b: aggregates.by_device(b.sessions),
    "revenue_by_country": lambda b: aggregates.revenue_by_country(b.transactions, b.players),
    "players_by_country_top10": lambda b: aggregates.by_country(b.players),
    "device_distribution": lambda b: aggregates.device_distribution(b.players),
    "total_revenue": lambda b: aggregates.total_revenue(b.transactions),
    "paying_player_share": lambda b: aggregates.paying_share(b.transactions, b.players),
    "cohort_sizes": lambda b: aggregates.cohort_sizes(b.player_cohorts, b.cohorts),
    "kpi_strip": lambda b: globe.kpis(_measured(b)),
    # Panels
    "island_cards": lambda b: panels.cards(b.islands, b.sessions),
    "island_active_players_7d": lambda b: panels.active_7d(b.islands, b.sessions, SESSIONS_AS_OF),
    "island_peak_concurrency": lambda b: panels.peak_concurrency(b.sessions),
    "portfolio_summary": lambda b: panels.portfolio(b.islands, b.sessions),
    "island_rollup": lambda b: panels.island_rollup(b.sessions),
    "top_players": lambda b: panels.leaderboard(b.sessions),
    "favorite_island": lambda b: panels.favorite(b.sessions),
    "best_rated_island": lambda b: panels.best_rated(b.islands),
    "island_minimums": lambda b: panels.minimums(b.islands, b.sessions),
    "region_share_by_phase": lambda b: panels.region_share(b.players, START, b.phase_weights),
    "peak_hours_by_region": lambda b: panels.peak_hours(b.sessions, b.players),
    "churn_rate_by_country": lambda b: panels.churn_rate(b.players, END),
    "monthly_revenue": lambda b: aggregates.monthly_revenue(b.transactions),
    # Cohorts and derived tables
    "player_cohorts": lambda b: cohorts.assign_cohorts(b.players, b.transactions, END, COHORT_REGION),
    "players_final": lambda b: cohorts.finalize_players(b.players, b.transactions),
    "session_weights": lambda b: cohorts.session_weights(b.players, END),
    # Top-k
    "latest_completed_sessions": lambda b: globe.latest(b.sessions).select(
        "session_id", "player_id", "start_time"
    ),
    "top_islands": lambda b: panels.top_islands(b.islands, b.sessions),
    # Sampling
    "sample_players_40pct": lambda b: sampling.sample_fraction(
        b.players.select("player_id"), "player_id", 0.4, SEED
    ),
    "one_session_per_payer": lambda b: sampling.one_per_player(b.sessions, b.transactions, SEED),
    # Streaming
    "stream_active_sessions_5min": _stream_windows,
    "stream_closed_windows": _stream_closed_windows,
    "active_sessions_5min": lambda b: activity.active_sessions(b.sessions),
    "stream_location_counts": _stream_locations,
    "stream_globe": _stream_globe,
}


def build(name: str) -> Callable[[SparkSession, str], DataFrame]:
    report = REPORTS[name]
    return lambda spark, folder: report(Bindings(spark, folder))
