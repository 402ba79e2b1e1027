"""Declared schemas of the domain tables, as Spark DDL. Nothing is inferred.

Stored times are `timestamp` in UTC: Parquet scans skip row groups by it, which they cannot do
by `timestamp_ntz`. The operators take either.
"""

from __future__ import annotations

RAW_PLAYERS = (
    "player_id bigint, ip_address bigint, create_date date, city string, state string, "
    "country string, region string, latitude double, longitude double, player_level bigint, "
    "device_type string, total_time_played bigint, last_login_date date"
)

#: As stored: with lifetime spend, without the helper column region (`joins.player_region` adds it).
PLAYERS = (
    "player_id bigint, ip_address bigint, create_date date, city string, state string, "
    "country string, latitude double, longitude double, player_level bigint, "
    "device_type string, total_time_played bigint, last_login_date date, lifetime_spend bigint"
)

ISLANDS = (
    "island_id bigint, creator_player_id bigint, island_name string, category string, "
    "create_date date, total_plays bigint, avg_rating double"
)

SESSIONS = (
    "session_id bigint, player_id bigint, start_time timestamp, end_time timestamp, "
    "ip_address bigint, island_id bigint, score bigint, objectives_completed bigint, "
    "deaths bigint, eliminations bigint, time_played_minutes bigint, status string, "
    "device_type string"
)

TRANSACTIONS = (
    "transaction_id bigint, player_id bigint, type string, timestamp timestamp, "
    "amount bigint, credit_card_last4 bigint"
)

COHORTS = "cohort_id bigint, name string, create_date date"

PLAYER_COHORTS = "player_id bigint, cohort_id bigint"

TURNS = "conv_id bigint, turn bigint, role string, content string"

RESPONSES = "conv_id bigint, turn bigint, body string"

DOMAIN = {
    "players": PLAYERS,
    "islands": ISLANDS,
    "sessions": SESSIONS,
    "transactions": TRANSACTIONS,
    "cohorts": COHORTS,
    "player_cohorts": PLAYER_COHORTS,
}
