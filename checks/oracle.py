"""DuckDB SQL for every query, written against the raw tables and apart from the Spark code.

Only the constant tables are shared with it.
"""

from __future__ import annotations

from playlens.sources import dimensions
from playlens.sources.bindings import PHASE_WEIGHTS

_PLAYERS = """
last_order AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY o_custkey),
raw_players AS (
  SELECT c_custkey AS player_id,
    16777216 + (c_custkey * 7919) % 3741319168 AS ip_address,
    DATE '2001-01-29' + CAST(c_custkey * 7 % 185 AS INT) AS create_date,
    'CITY_' || n_nationkey AS city, 'ST_' || n_nationkey AS state, n_name AS country, r_name AS region,
    CAST(n_nationkey * 6 - 72 AS DOUBLE) AS latitude, CAST(n_nationkey * 14 - 168 AS DOUBLE) AS longitude,
    CAST(greatest(1, floor(c_acctbal / 200)) AS BIGINT) AS player_level,
    CASE WHEN c_custkey % 20 < 11 THEN 'mobile' WHEN c_custkey % 20 < 17 THEN 'pc' ELSE 'console' END AS device_type,
    d AS last_order
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN last_order ON c_custkey = o_custkey),
players AS (
  SELECT * EXCLUDE (last_order), player_level * (20 + player_id % 41) AS total_time_played,
    CASE WHEN last_order IS NULL OR last_order < create_date THEN create_date ELSE last_order END AS last_login_date
  FROM raw_players)"""

_SESSIONS = """
sessions AS (
  SELECT event_id AS session_id, user_id AS player_id, ts AS start_time,
    ts + to_minutes(CAST(greatest(3, least(120, floor(value))) AS INT)) AS end_time,
    16777216 + (user_id * 7919) % 3741319168 AS ip_address,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS island_id,
    CAST(floor(value) AS BIGINT) * 20 + event_id % 20 AS score,
    event_id % 11 AS objectives_completed, event_id % 16 AS deaths, event_id % 21 AS eliminations,
    CAST(floor(value) AS BIGINT) AS raw_minutes,
    CAST(greatest(3, least(120, floor(value))) AS BIGINT) AS time_played_minutes,
    CASE WHEN event_type NOT IN ('error', 'view') THEN 'completed' WHEN event_type = 'view' THEN 'abandoned' ELSE 'crashed' END AS status,
    CASE WHEN user_id % 20 < 11 THEN 'mobile' WHEN user_id % 20 < 17 THEN 'pc' ELSE 'console' END AS device_type
  FROM events)"""

_TRANSACTIONS = """
transactions AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS player_id, o_orderdate AS "timestamp",
    CASE WHEN o_orderpriority = '5-LOW' THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'purchase_skin' WHEN '2-HIGH' THEN 'purchase_emote'
      WHEN '3-MEDIUM' THEN 'purchase_bundle' WHEN '4-NOT SPECIFIED' THEN 'purchase_battle_pass' ELSE 'refund' END AS type,
    1000 + o_orderkey % 9000 AS credit_card_last4
  FROM orders)"""

_ISLANDS = """
islands AS (
  SELECT p_partkey AS island_id, p_partkey % 37 + 1 AS creator_player_id,
    p_type || ' Arena ' || p_partkey AS island_name, p_type AS category,
    (35 + p_size % 16) / 10.0 AS avg_rating_exact,
    CAST(35 + p_size % 16 AS DOUBLE) / 10 AS avg_rating
  FROM part)"""

_COHORTS = """
cohort_names(cohort_id, name) AS (VALUES (1::BIGINT, 'veteran_player'), (2, 'new_player'), (3, 'spenders'),
  (4, 'mobile_players'), (5, 'latam_players'), (6, 'churned_players'), (7, 'binge_players'), (8, 'casual_players'))"""

_MEMBERS = """
members AS (
  SELECT player_id, 1::BIGINT AS cohort_id FROM players WHERE player_level >= 20
  UNION ALL SELECT player_id, 2 FROM players WHERE player_level < 20 AND DATE '2001-08-01' - create_date < 30
  UNION ALL SELECT player_id, 3 FROM players WHERE player_id IN (SELECT player_id FROM transactions)
  UNION ALL SELECT player_id, 4 FROM players WHERE device_type = 'mobile'
  UNION ALL SELECT player_id, 5 FROM players WHERE region = 'AMERICA'
  UNION ALL SELECT player_id, 6 FROM players WHERE DATE '2001-08-01' - last_login_date >= 14
  UNION ALL SELECT player_id, 7 FROM players WHERE total_time_played > 500
  UNION ALL SELECT player_id, 8 FROM players WHERE total_time_played < 100)"""

_WEIGHTS = "weights(phase, region, expected_weight) AS (VALUES " + ", ".join(
    f"({phase}, '{region}', {share}::DOUBLE)" for region, shares in PHASE_WEIGHTS.items() for phase, share in enumerate(shares, 1)
) + ")"

_PHASE = """
phased AS (
  SELECT *, CASE WHEN create_date - DATE '2001-01-29' < 60 THEN 1
                 WHEN create_date - DATE '2001-01-29' < 120 THEN 2 ELSE 3 END AS phase
  FROM players)"""

_GLOBE = """
newest AS (
  SELECT s.player_id, time_played_minutes, latitude, longitude, city, country
  FROM sessions s JOIN players p ON s.player_id = p.player_id
  WHERE s.status = 'completed' ORDER BY s.start_time DESC, s.session_id DESC LIMIT 500),
globe AS (
  SELECT latitude, longitude, city, country, count(*) AS active_sessions,
    count(DISTINCT player_id) AS player_count,
    CAST(sum(time_played_minutes) AS DOUBLE) / count(*) AS avg_session_duration
  FROM newest GROUP BY latitude, longitude, city, country)"""

_PLAYS = """
island_plays AS (
  SELECT island_id, island_name, category, creator_player_id, avg_rating, avg_rating_exact,
    count(session_id) AS total_plays, CAST(sum(time_played_minutes) AS BIGINT) AS minutes
  FROM islands LEFT JOIN sessions USING (island_id)
  GROUP BY ALL)"""

_HOVER = (
    "city || ', ' || country || '<br>🎮 Active Sessions: ' || active_sessions || '<br>👥 Players: ' || "
    "player_count || '<br>⏱ Avg Duration: ' || "
    "CAST(CAST(round_even(avg_session_duration, 1) AS DECIMAL(18,1)) AS VARCHAR) || ' min'"
)


def _literal(value) -> str:
    return "'" + value + "'" if isinstance(value, str) else repr(value)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)


def _draw(key: str, seed: str) -> str:
    return f"CAST('0x' || substr(md5({key} || ':{seed}'), 1, 15) AS BIGINT)"


def _sample_rows() -> str:
    return (
        "SELECT country, city, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, "
        "CAST(active_sessions AS BIGINT) AS active_sessions, CAST(player_count AS BIGINT) AS player_count, "
        "CAST(avg_session_duration AS DOUBLE) AS avg_session_duration "
        f"FROM (VALUES {_values(dimensions.SAMPLE_LOCATIONS)}) "
        "t(country, city, latitude, longitude, active_sessions, player_count, avg_session_duration)"
    )


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


_WINDOWS = _with(_SESSIONS) + """
SELECT time_bucket(INTERVAL 5 MINUTE, start_time) AS window_start,
  time_bucket(INTERVAL 5 MINUTE, start_time) + INTERVAL 5 MINUTE AS window_end, count(*) AS active_sessions
FROM sessions WHERE status = 'completed' GROUP BY 1, 2"""

ORACLES: dict[str, str] = {
    "scan_sessions": _with(_SESSIONS) + "SELECT * EXCLUDE (raw_minutes) FROM sessions",
    "save_tables_roundtrip": _with(_PLAYERS, _TRANSACTIONS, _MEMBERS) + "SELECT * FROM members",
    "saved_peak_hours": _with(_PLAYERS, _SESSIONS) + """
SELECT region, CAST(hour(start_time) AS INT) AS hour, count(*) AS sessions
FROM sessions s JOIN players p ON s.player_id = p.player_id GROUP BY 1, 2""",
    "saved_tables": _with(_PLAYERS, _SESSIONS, _TRANSACTIONS, _ISLANDS, _PLAYS, _COHORTS, _MEMBERS) + """
SELECT 'players' AS table_name, concat_ws('|', city, country, create_date, device_type, ip_address, last_login_date, latitude,
    (SELECT coalesce(CAST(sum(amount) AS BIGINT), 0) FROM transactions t WHERE t.player_id = p.player_id AND amount > 0),
    longitude, player_id, player_level, state, total_time_played) AS row_text FROM players p
UNION ALL SELECT 'islands', concat_ws('|', avg_rating, category, DATE '2001-01-29' + CAST(island_id % 31 AS INT), creator_player_id,
    island_id, island_name, total_plays) FROM island_plays
UNION ALL SELECT 'sessions', concat_ws('|', deaths, device_type, eliminations, epoch_us(end_time), ip_address, island_id,
    objectives_completed, player_id, score, session_id, epoch_us(start_time), status, time_played_minutes) FROM sessions
UNION ALL SELECT 'transactions', concat_ws('|', amount, credit_card_last4, player_id, epoch_us("timestamp"), transaction_id, type)
  FROM transactions
UNION ALL SELECT 'cohorts', concat_ws('|', cohort_id, CASE WHEN cohort_id = 5 THEN DATE '2001-03-30' ELSE DATE '2001-01-29' END, name)
  FROM cohort_names
UNION ALL SELECT 'player_cohorts', concat_ws('|', cohort_id, player_id) FROM members""",
    "table_row_counts": _with(_PLAYERS, _TRANSACTIONS, _MEMBERS) + """
SELECT 'players' AS table_name, count(*) AS cnt FROM players
UNION ALL SELECT 'islands', count(*) FROM part
UNION ALL SELECT 'sessions', count(*) FROM events
UNION ALL SELECT 'transactions', count(*) FROM transactions
UNION ALL SELECT 'cohorts', 8
UNION ALL SELECT 'player_cohorts', count(*) FROM members""",
    "globe_with_fallback": _with(_SESSIONS, f"sample AS ({_sample_rows()})") + """
SELECT * FROM sample WHERE NOT EXISTS (SELECT 1 FROM sessions WHERE start_time > (SELECT max(start_time) FROM sessions))""",
    "completed_sessions": _with(_SESSIONS) + """
SELECT session_id, player_id, start_time FROM sessions WHERE status = 'completed'""",
    "positive_transactions": _with(_TRANSACTIONS) + """
SELECT transaction_id, player_id, amount FROM transactions WHERE amount > 0""",
    "players_in_countries": _with(_PLAYERS) + """
SELECT player_id, country FROM players
WHERE country IN ('NATION_1', 'NATION_6', 'NATION_11', 'NATION_16', 'NATION_21')""",
    "churned_players": _with(_PLAYERS) + """
SELECT player_id, city, country, last_login_date, CAST(DATE '2001-08-01' - last_login_date AS INT) AS days_inactive
FROM players WHERE DATE '2001-08-01' - last_login_date >= 14 ORDER BY days_inactive DESC, player_id""",
    "recently_active_players": _with(_PLAYERS) + """
SELECT player_id, last_login_date FROM players WHERE last_login_date > DATE '2001-08-01' - 14""",
    "nonblank_messages": """
SELECT conv_id, turn, role FROM conversations WHERE regexp_matches(text, '[^\\s\\p{Z}\\x0B\\x1C-\\x1F\\x{85}]')""",
    "globe_marker_size": _with(_PLAYERS, _SESSIONS, _GLOBE) + """
SELECT city, active_sessions, 8 + CAST(active_sessions - lo AS DOUBLE) / (hi - lo + 1) * 35 AS marker_size
FROM globe, (SELECT min(active_sessions) AS lo, max(active_sessions) AS hi FROM globe)""",
    "globe_hover_text": _with(_PLAYERS, _SESSIONS, _GLOBE) + f"SELECT city, {_HOVER} AS hover_text FROM globe",
    "clamped_durations": _with(_SESSIONS) + "SELECT session_id, raw_minutes, time_played_minutes FROM sessions",
    "session_end_times": _with(_SESSIONS) + "SELECT session_id, end_time FROM sessions",
    "player_session_window": _with(_PLAYERS) + """
SELECT player_id, create_date AS window_start, e AS window_end, CAST(e - create_date AS INT) AS window_days FROM (
  SELECT *, CASE WHEN least(last_login_date, DATE '2001-08-01') <= create_date THEN create_date + 1
                 ELSE least(last_login_date, DATE '2001-08-01') END AS e FROM players)""",
    "island_names": "SELECT p_partkey AS island_id, p_type || ' Arena ' || p_partkey AS island_name FROM part",
    "player_growth_phase": _with(_PLAYERS, _PHASE, _WEIGHTS) + """
SELECT player_id, p.phase, expected_weight FROM phased p LEFT JOIN weights w ON p.phase = w.phase AND p.region = w.region""",
    "session_local_time": _with(_SESSIONS) + """
SELECT session_id, strftime(start_time - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') || ' EST' AS local_time FROM sessions""",
    "session_long_date": _with(_SESSIONS) + """
SELECT session_id, strftime(start_time, '%B %d, %Y at %I:%M %p') AS long_date FROM sessions""",
    "agent_response_text": """
WITH replies AS (
  SELECT conv_id, turn, (conv_id + turn) % 4 AS shape, CASE (conv_id + turn) % 4
    WHEN 0 THEN CAST(to_json({'output': [{'content': [{'text': text}]}]}) AS VARCHAR)
    WHEN 1 THEN CAST(to_json({'choices': [{'message': {'content': text}}]}) AS VARCHAR)
    WHEN 2 THEN text ELSE CAST(to_json({'reply': text}) AS VARCHAR) END AS body
  FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN shape = 2 THEN '❌ API Error 503: ' || body
  ELSE coalesce(TRY_CAST(body AS JSON) ->> '$.output[0].content[0].text', TRY_CAST(body AS JSON) ->> '$.choices[0].message.content',
    '❌ Error: Unexpected response format. Response: ' || body) END AS answer
FROM replies""",
    "conversation_payload": """
SELECT conv_id, turn, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN '{"input":[' ELSE ',' END ||
  CAST(to_json({'role': role, 'content': text}) AS VARCHAR) ||
  CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN '],"max_output_tokens":1000}' ELSE '' END AS piece
FROM conversations""",
    "sessions_with_location": _with(_PLAYERS, _SESSIONS) + """
SELECT session_id, s.player_id, city, country, latitude, longitude
FROM sessions s JOIN players p ON s.player_id = p.player_id WHERE status = 'completed'""",
    "payments_with_country": _with(_PLAYERS, _TRANSACTIONS) + """
SELECT transaction_id, t.player_id, country, amount
FROM transactions t JOIN players p ON t.player_id = p.player_id WHERE amount > 0""",
    "island_total_plays": _with(_SESSIONS, _ISLANDS, _PLAYS) + "SELECT island_id, total_plays FROM island_plays",
    "player_lifetime_spend": _with(_PLAYERS, _TRANSACTIONS) + """
SELECT p.player_id, CAST(coalesce(sum(amount), 0) AS BIGINT) AS lifetime_spend
FROM players p LEFT JOIN transactions t ON p.player_id = t.player_id AND amount > 0 GROUP BY p.player_id""",
    "paying_players": _with(_PLAYERS, _TRANSACTIONS) + """
SELECT player_id FROM players WHERE player_id IN (SELECT player_id FROM transactions)""",
    "nonpaying_players": _with(_PLAYERS, _TRANSACTIONS) + """
SELECT player_id FROM players p WHERE NOT EXISTS (SELECT 1 FROM transactions t WHERE t.player_id = p.player_id)""",
    "cohort_members_named": _with(_PLAYERS, _TRANSACTIONS, _MEMBERS, _COHORTS) + """
SELECT player_id, cohort_id, name FROM members JOIN cohort_names USING (cohort_id)""",
    "payer_reference_time": _with(_PLAYERS, _SESSIONS, _TRANSACTIONS) + """
SELECT p.player_id, coalesce(max(s.start_time), CAST(any_value(p.create_date) AS TIMESTAMP)) AS reference_time
FROM players p LEFT JOIN sessions s ON s.player_id = p.player_id
WHERE p.player_id IN (SELECT player_id FROM transactions) GROUP BY p.player_id""",
    "player_region": _with(_PLAYERS) + "SELECT player_id, country, region FROM players",
    "active_players_globe": _with(_PLAYERS, _SESSIONS, _GLOBE) + """
SELECT latitude, longitude, city, country, active_sessions, active_sessions AS player_count,
  45.0 AS avg_session_duration FROM globe ORDER BY active_sessions DESC""",
    "active_players_globe_measured": _with(_PLAYERS, _SESSIONS, _GLOBE) + "SELECT * FROM globe",
    "globe_feed": _with(
        _PLAYERS, _SESSIONS, _GLOBE,
        f"""places AS (
  SELECT country, city, latitude, longitude, active_sessions, player_count, avg_session_duration FROM globe
  UNION ALL SELECT * FROM ({_sample_rows()}) WHERE NOT EXISTS (SELECT 1 FROM globe))""",
    ) + f"""
SELECT places.*, 8 + CAST(active_sessions - lo AS DOUBLE) / (hi - lo + 1) * 35 AS marker_size, {_HOVER} AS hover_text
FROM places, (SELECT min(active_sessions) AS lo, max(active_sessions) AS hi FROM places)""",
    "monthly_new_players_by_country": _with(_PLAYERS) + """
SELECT CAST(date_trunc('month', create_date) AS DATE) AS month, country, count(*) AS new_players FROM players
WHERE country IN ('NATION_1', 'NATION_6', 'NATION_11', 'NATION_16', 'NATION_21') GROUP BY 1, 2
ORDER BY month, new_players DESC, country""",
    "session_metrics_by_device": _with(_SESSIONS) + """
SELECT device_type, count(*) AS sessions, CAST(sum(time_played_minutes) AS DOUBLE) / count(*) AS avg_minutes
FROM sessions GROUP BY device_type""",
    "revenue_by_country": _with(_PLAYERS, _TRANSACTIONS) + """
SELECT country, count(DISTINCT t.player_id) AS paying_players, CAST(sum(amount) AS BIGINT) / 100 AS total_revenue
FROM transactions t JOIN players p ON t.player_id = p.player_id WHERE amount > 0
GROUP BY country ORDER BY total_revenue DESC""",
    "players_by_country_top10": _with(_PLAYERS) + """
SELECT country, count(*) AS players, CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM players) AS pct
FROM players GROUP BY country ORDER BY players DESC, country LIMIT 10""",
    "device_distribution": _with(_PLAYERS) + """
SELECT device_type, count(*) AS players, CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM players) AS pct
FROM players GROUP BY device_type""",
    "total_revenue": _with(_TRANSACTIONS) + """
SELECT CAST(coalesce(sum(amount), 0) AS BIGINT) / 100 AS total_revenue FROM transactions WHERE amount > 0""",
    "paying_player_share": _with(_PLAYERS, _TRANSACTIONS) + """
SELECT paying_players, players, CAST(paying_players AS DOUBLE) * 100 / players AS pct
FROM (SELECT count(DISTINCT player_id) AS paying_players FROM transactions), (SELECT count(*) AS players FROM players)""",
    "cohort_sizes": _with(_PLAYERS, _TRANSACTIONS, _MEMBERS, _COHORTS) + """
SELECT cohort_id, name, count(*) AS size FROM members JOIN cohort_names USING (cohort_id) GROUP BY cohort_id, name""",
    "kpi_strip": _with(_PLAYERS, _SESSIONS, _GLOBE) + """
SELECT *, format('{:,}', total_sessions) AS total_sessions_text, format('{:,}', total_locations) AS total_locations_text,
  format('{:.1f}', avg_duration) AS avg_duration_text
FROM (SELECT CAST(sum(active_sessions) AS BIGINT) AS total_sessions, count(*) AS total_locations,
    CAST(sum(CAST(round(avg_session_duration * 1000000) AS BIGINT)) AS DOUBLE) / 1000000 / count(*) AS avg_duration
  FROM globe)""",
    "island_cards": _with(_SESSIONS, _ISLANDS, _PLAYS) + """
SELECT island_id, island_name, total_plays, avg_rating,
  CASE WHEN total_plays > 0 THEN CAST((minutes * 20 + total_plays) // (2 * total_plays) AS DOUBLE) / 10 END AS avg_minutes
FROM island_plays""",
    "island_active_players_7d": _with(_SESSIONS, _ISLANDS) + """
SELECT i.island_id, count(DISTINCT s.player_id) AS active_players
FROM islands i LEFT JOIN sessions s ON i.island_id = s.island_id AND start_time > TIMESTAMP '2024-01-24 00:00:00'
  AND start_time <= TIMESTAMP '2024-01-31 00:00:00'
GROUP BY i.island_id""",
    "island_peak_concurrency": _with(_SESSIONS) + """
SELECT island_id, CAST(greatest(max(running), 0) AS BIGINT) AS peak_concurrent FROM (
  SELECT island_id, sum(d) OVER (PARTITION BY island_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS running FROM (
    SELECT island_id, start_time AS t, 1 AS d FROM sessions
    UNION ALL SELECT island_id, end_time, -1 FROM sessions))
GROUP BY island_id""",
    "portfolio_summary": _with(_SESSIONS, _ISLANDS) + """
SELECT i.creator_player_id, coalesce(total_plays, 0) AS total_plays, avg_rating,
  coalesce(unique_players, 0) AS unique_players
FROM (SELECT creator_player_id,
        CAST(sum(CAST(round(avg_rating * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS avg_rating
      FROM islands GROUP BY 1) i
LEFT JOIN (SELECT creator_player_id, count(*) AS total_plays, count(DISTINCT player_id) AS unique_players
      FROM islands JOIN sessions USING (island_id) GROUP BY 1) s ON i.creator_player_id = s.creator_player_id""",
    "island_rollup": _with(_SESSIONS) + """
SELECT island_id, CAST(grouping(island_id) AS INT) AS is_total, count(*) AS plays,
  CAST(sum(time_played_minutes) AS BIGINT) AS minutes FROM sessions GROUP BY ROLLUP (island_id)""",
    "top_players": _with(_SESSIONS) + """
SELECT CAST(row_number() OVER (ORDER BY sessions DESC, player_id) AS INT) AS rank, * FROM (
  SELECT player_id, count(*) AS sessions, CAST(sum(time_played_minutes) AS BIGINT) / 60 AS total_hours,
    CAST(count(*) FILTER (status = 'completed') AS DOUBLE) / count(*) AS completion_rate
  FROM sessions GROUP BY player_id ORDER BY sessions DESC, player_id LIMIT 6)""",
    "favorite_island": _with(_SESSIONS) + """
SELECT player_id, island_id, plays FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY plays DESC, island_id) AS r
  FROM (SELECT player_id, island_id, count(*) AS plays FROM sessions GROUP BY 1, 2)) WHERE r = 1""",
    "best_rated_island": _with(_ISLANDS) + """
SELECT island_id, island_name, avg_rating FROM islands ORDER BY avg_rating DESC, island_id LIMIT 1""",
    "island_minimums": _with(_SESSIONS, _ISLANDS, _PLAYS) + """
SELECT min(total_plays) AS min_plays, min(avg_rating) AS min_rating FROM island_plays""",
    "region_share_by_phase": _with(_PLAYERS, _PHASE, _WEIGHTS) + """
SELECT c.phase, c.region, players, CAST(players AS DOUBLE) / total AS share, expected_weight
FROM (SELECT phase, region, count(*) AS players FROM phased GROUP BY 1, 2) c
JOIN (SELECT phase, count(*) AS total FROM phased GROUP BY 1) t ON c.phase = t.phase
LEFT JOIN weights w ON c.phase = w.phase AND c.region = w.region""",
    "peak_hours_by_region": _with(_PLAYERS, _SESSIONS) + """
SELECT region, CAST(hour(start_time) AS INT) AS hour, count(*) AS sessions
FROM sessions s JOIN players p ON s.player_id = p.player_id GROUP BY 1, 2""",
    "churn_rate_by_country": _with(_PLAYERS) + """
SELECT country, count(*) AS players, count(*) FILTER (DATE '2001-08-01' - last_login_date >= 14) AS churned,
  CAST(count(*) FILTER (DATE '2001-08-01' - last_login_date >= 14) AS DOUBLE) / count(*) AS churn_rate
FROM players GROUP BY country""",
    "monthly_revenue": _with(_TRANSACTIONS) + """
SELECT CAST(date_trunc('month', "timestamp") AS DATE) AS month, CAST(sum(amount) AS BIGINT) / 100 AS revenue
FROM transactions WHERE amount > 0 GROUP BY 1""",
    "player_cohorts": _with(_PLAYERS, _TRANSACTIONS, _MEMBERS) + "SELECT * FROM members",
    "players_final": _with(_PLAYERS, _TRANSACTIONS) + """
SELECT p.* EXCLUDE (region), coalesce(spend, 0) AS lifetime_spend FROM players p
LEFT JOIN (SELECT player_id, CAST(sum(amount) AS BIGINT) AS spend FROM transactions WHERE amount > 0 GROUP BY 1) t
  ON p.player_id = t.player_id""",
    "session_weights": _with(_PLAYERS) + """
SELECT player_id, weight, weight / sum(weight) OVER () AS probability FROM (
  SELECT player_id, CASE WHEN last_login_date > DATE '2001-08-01' - 14 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM players)""",
    "latest_completed_sessions": _with(_SESSIONS) + """
SELECT session_id, player_id, start_time FROM sessions WHERE status = 'completed'
ORDER BY start_time DESC, session_id DESC LIMIT 500""",
    "top_islands": _with(_SESSIONS, _ISLANDS, _PLAYS) + """
SELECT island_name, category, total_plays, avg_rating FROM island_plays ORDER BY total_plays DESC, island_id LIMIT 10""",
    "sample_players_40pct": _with(_PLAYERS) + f"""
SELECT player_id FROM (
  SELECT player_id, row_number() OVER (ORDER BY {_draw('player_id', '42')}, player_id) AS r, count(*) OVER () AS n FROM players)
WHERE r <= round_even(0.4 * n, 0)""",
    "one_session_per_payer": _with(_SESSIONS, _TRANSACTIONS) + f"""
SELECT player_id, session_id FROM (
  SELECT player_id, session_id,
    row_number() OVER (PARTITION BY player_id ORDER BY {_draw('session_id', '42')}, session_id) AS r
  FROM sessions WHERE player_id IN (SELECT player_id FROM transactions)) WHERE r = 1""",
    "stream_active_sessions_5min": _WINDOWS,
    "stream_closed_windows": f"""
SELECT * FROM ({_WINDOWS}) WHERE window_end <= (SELECT max(ts) FROM events WHERE event_type NOT IN ('error', 'view')) - INTERVAL 10 MINUTE""",
    "active_sessions_5min": _WINDOWS,
    "stream_globe": _with(_PLAYERS, _SESSIONS, _GLOBE) + "SELECT * FROM globe",
    "stream_location_counts": _with(_PLAYERS, _SESSIONS) + """
SELECT city, country, count(*) AS active_sessions
FROM sessions s JOIN players p ON s.player_id = p.player_id WHERE status = 'completed' GROUP BY city, country""",
    "players_without_kind": _with(_PLAYERS, _TRANSACTIONS) + """
SELECT player_id FROM players WHERE player_id NOT IN (SELECT player_id FROM transactions WHERE type = 'purchase_battle_pass')""",
    "catalog_row_counts": _with(_PLAYERS, _TRANSACTIONS, _MEMBERS) + """
SELECT unnest(['cohorts', 'islands', 'player_cohorts', 'players', 'sessions', 'transactions']) AS table_name,
  unnest([8, (SELECT count(*) FROM part), (SELECT count(*) FROM members), (SELECT count(*) FROM players),
    (SELECT count(*) FROM events), (SELECT count(*) FROM orders)]) AS cnt""",
}
# The same questions put to stored tables.
ORACLES["stored_latest_sessions"] = ORACLES["latest_completed_sessions"]
ORACLES["stored_globe"] = ORACLES["active_players_globe_measured"]
ORACLES["catalog_sessions_with_location"] = ORACLES["sessions_with_location"]
