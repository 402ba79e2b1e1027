"""Edge cases of the operators on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from playlens.functions import numbers, texts, times
from playlens.operators import (
    aggregates, chat, cohorts, derive, filters, globe, joins, panels,
)
from playlens.plans import feed
from playlens.sources import dimensions, tables
from tests import frames
from tests.frames import AS_OF, at, tuples

T0 = at("2024-06-01 10:00:00")


def minutes(n: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=n)


def simple_sessions(spark, triples, status="completed"):
    """triples: (session_id, player_id, island_id), one minute apart, ten minutes long."""
    return frames.sessions(
        spark, [(s, p, i, minutes(s), minutes(s + 10), status) for s, p, i in triples]
    )


def test_location_join_drops_null_and_unknown_players(spark):
    se = simple_sessions(spark, [(1, 1, 1), (2, None, 1), (3, 99, 1)])
    pl = frames.players(spark, [{"player_id": 1}, {"player_id": 2}])
    assert [r.session_id for r in joins.with_location(se, pl).collect()] == [1]


def test_latest_located_looks_past_sessions_without_player(spark):
    # The newest 40 sessions are orphans, far more than the candidates hold.
    se = simple_sessions(spark, [(s, 1 if s <= 10 else 99, 1) for s in range(1, 51)])
    pl = frames.players(spark, [{"player_id": 1}])
    got = [r.session_id for r in globe.latest_located(se, pl, n=5, margin=2).collect()]
    assert got == [10, 9, 8, 7, 6]


def test_latest_located_uses_the_bound_when_candidates_suffice(spark):
    se = simple_sessions(spark, [(s, 99 if s % 3 == 0 else 1, 1) for s in range(1, 61)])
    pl = frames.players(spark, [{"player_id": 1}])
    got = [r.session_id for r in globe.latest_located(se, pl, n=10).collect()]
    assert got == [s for s in range(60, 0, -1) if s % 3][:10]


def test_latest_located_with_fewer_sessions_than_asked(spark):
    se = simple_sessions(spark, [(1, 1, 1), (2, 99, 1)])
    pl = frames.players(spark, [{"player_id": 1}])
    assert globe.latest_located(se, pl, n=500).count() == 1


def test_newest_500_break_ties_by_session_id(spark):
    se = frames.sessions(
        spark, [(s, 1, 1, T0, minutes(5), "completed") for s in range(700)]
    )
    pl = frames.players(spark, [{"player_id": 1}])
    ids = {r.session_id for r in globe.latest(se).collect()}
    assert ids == set(range(200, 700))
    assert {r.session_id for r in globe.latest_located(se, pl).collect()} == ids


def test_marker_size_of_one_and_two_places(spark):
    one = spark.createDataFrame([("a", 7)], "city string, active_sessions bigint")
    assert globe.marker_size(one, "active_sessions").collect()[0].marker_size == 8.0
    two = spark.createDataFrame([("a", 1), ("b", 5)], "city string, active_sessions bigint")
    sizes = {r.city: r.marker_size for r in globe.marker_size(two, "active_sessions").collect()}
    assert sizes == {"a": 8.0, "b": 8 + 4 / 5 * 35}


def test_fallback_only_for_an_empty_report(spark):
    report = spark.createDataFrame([(1,)], "x bigint")
    default = spark.createDataFrame([(8,), (9,)], "x bigint")
    assert tuples(tables.with_fallback(report, default)) == [(1,)]
    assert tuples(tables.with_fallback(report.where("x > 5"), default)) == [(8,), (9,)]


def test_globe_counts_and_constant(spark):
    se = simple_sessions(spark, [(1, 1, 1), (2, 1, 1), (3, 2, 1)])
    pl = frames.players(spark, [{"player_id": 1}, {"player_id": 2}])
    row = globe.globe(se, pl).collect()[0]
    assert (row.active_sessions, row.player_count, str(row.avg_session_duration)) == (3, 3, "45.0")
    measured = globe.globe_measured(se, pl).collect()[0]
    assert (measured.player_count, measured.avg_session_duration) == (2, 10.0)


def test_feed_without_sessions_shows_the_sample_places(spark):
    se = simple_sessions(spark, [(1, 1, 1)], status="crashed")
    pl = frames.players(spark, [{"player_id": 1}])
    rows = feed.globe_feed(se, pl, dimensions.sample_locations(spark)).collect()
    assert [r.city for r in rows[:2]] == ["New York", "Tokyo"] and len(rows) == 10
    assert rows[-1].marker_size == 8.0 and rows[0].marker_size == 8 + 105 / 106 * 35
    assert rows[0].hover_text.endswith("⏱ Avg Duration: 45.5 min")


def test_hover_text_rounds_half_even(spark):
    df = spark.createDataFrame(
        [("Lima", "Peru", 3, 2, 45.25)],
        "city string, country string, active_sessions bigint, player_count bigint, "
        "avg_session_duration double",
    )
    assert globe.hover_text(df).collect()[0].hover_text == (
        "Lima, Peru<br>🎮 Active Sessions: 3<br>👥 Players: 2<br>⏱ Avg Duration: 45.2 min"
    )


def test_kpis_use_the_unweighted_mean(spark):
    df = spark.createDataFrame(
        [(1200, 40.0), (34, 50.5)], "active_sessions bigint, avg_session_duration double"
    )
    row = globe.kpis(df).collect()[0]
    assert (row.total_sessions, row.total_locations, row.avg_duration) == (1234, 2, 45.25)
    assert row.total_sessions_text == "1,234"
    assert row.avg_duration_text == "45.2"


def test_peak_of_touching_nested_and_identical_intervals(spark):
    se = frames.sessions(
        spark,
        [
            (1, 1, 1, minutes(0), minutes(10), "completed"),  # touching
            (2, 1, 1, minutes(10), minutes(20), "completed"),
            (3, 1, 2, minutes(0), minutes(60), "completed"),  # nested
            (4, 1, 2, minutes(10), minutes(20), "completed"),
            (5, 1, 2, minutes(12), minutes(15), "completed"),
            (6, 1, 3, minutes(0), minutes(5), "completed"),  # identical
            (7, 1, 3, minutes(0), minutes(5), "completed"),
            (8, 1, 4, minutes(0), minutes(0), "completed"),  # empty
            (9, 1, 5, minutes(0), minutes(3 * 1440), "completed"),  # over several days
            (10, 1, 5, minutes(2 * 1440), minutes(4 * 1440), "completed"),
        ],
    )
    assert tuples(panels.peak_concurrency(se)) == [(1, 1), (2, 3), (3, 2), (4, 0), (5, 2)]


def test_leaderboard_favorites_and_best_rated_break_ties(spark):
    se = simple_sessions(spark, [(1, 2, 5), (2, 2, 3), (3, 1, 9), (4, 1, 9), (5, 3, 1)])
    board = panels.leaderboard(se, n=2).orderBy("rank").collect()
    assert [(r["rank"], r.player_id, r.sessions) for r in board] == [(1, 1, 2), (2, 2, 2)]
    assert tuples(panels.favorite(se)) == [(1, 9, 2), (2, 3, 1), (3, 1, 1)]
    isl = frames.islands(spark, [(2, 1, "Racing", 4.5), (1, 1, "Parkour", 4.5), (3, 1, "Racing", 4.0)])
    assert panels.best_rated(isl).collect()[0].island_id == 1


def test_cohort_rules_at_their_borders(spark):
    day = dt.timedelta(days=1)
    pl = frames.players(
        spark,
        [
            {"player_id": 1, "player_level": 20, "create_date": AS_OF - 5 * day},
            {"player_id": 2, "player_level": 19, "create_date": AS_OF - 29 * day},
            {"player_id": 3, "player_level": 19, "create_date": AS_OF - 30 * day},
            {"player_id": 4, "total_time_played": 500},
            {"player_id": 5, "total_time_played": 501},
            {"player_id": 6, "total_time_played": 99},
            {"player_id": 7, "total_time_played": 100},
            {"player_id": 8, "last_login_date": AS_OF - 13 * day},
            {"player_id": 9, "last_login_date": AS_OF - 14 * day},
            {"player_id": 10, "device_type": "mobile"},
            {"player_id": 11},
        ],
    )
    tx = frames.transactions(spark, [(1, 11, -5), (2, 11, -5)])
    got = {}
    for pid, cid in tuples(cohorts.assign_cohorts(pl, tx, AS_OF, "LATAM")):
        got.setdefault(pid, set()).add(cid)
    expected = {
        1: {1, 5}, 2: {2, 5}, 3: {5}, 4: {5}, 5: {5, 7}, 6: {5, 8}, 7: {5}, 8: {5}, 9: {5, 6},
        10: {4, 5}, 11: {3, 5},
    }
    assert got == expected


def test_refund_only_payer_counts_as_payer_but_not_in_revenue(spark):
    pl = frames.players(spark, [{"player_id": 1}, {"player_id": 2}, {"player_id": 3}])
    tx = frames.transactions(spark, [(1, 1, 250), (2, 1, 300), (3, 2, -100)])
    assert tuples(aggregates.revenue_by_country(tx, pl)) == [("Peru", 1, 5.5)]
    assert aggregates.paying_share(tx, pl).collect()[0].paying_players == 2
    assert aggregates.total_revenue(tx).collect()[0].total_revenue == 5.5
    assert tuples(joins.paying(pl, tx).select("player_id")) == [(1,), (2,)]
    assert tuples(joins.paying(pl, tx, anti=True).select("player_id")) == [(3,)]
    assert tuples(joins.lifetime_spend(pl, tx).select("player_id", "lifetime_spend")) == [
        (1, 550), (2, 0), (3, 0)
    ]


def test_shares_of_empty_tables_are_null(spark):
    pl = frames.players(spark, [])
    tx = frames.transactions(spark, [])
    row = aggregates.paying_share(tx, pl).collect()[0]
    assert (row.paying_players, row.players, row.pct) == (0, 0, None)
    assert aggregates.total_revenue(tx).collect()[0].total_revenue == 0.0


def test_islands_without_sessions_keep_zero(spark):
    isl = frames.islands(spark, [(1, 7, "Racing", 4.0), (2, 7, "Parkour", 5.0), (3, 8, "Racing", 3.5)])
    se = simple_sessions(spark, [(1, 1, 1), (2, 2, 1), (3, 2, 2)])
    assert tuples(joins.total_plays(isl, se).select("island_id", "total_plays")) == [(1, 2), (2, 1), (3, 0)]
    assert tuples(panels.portfolio(isl, se)) == [(7, 3, 4.5, 2), (8, 0, 3.5, 0)]
    assert tuples(panels.minimums(isl, se)) == [(0, 3.5)]
    last = panels.cards(isl, se).where("island_id = 3").collect()[0]
    assert (last.total_plays, last.avg_minutes) == (0, None)


def test_active_7d_is_a_strict_bound(spark):
    isl = frames.islands(spark, [(1, 7, "Racing", 4.0), (2, 7, "Racing", 4.0)])
    edge = at("2024-06-01 00:00:00")
    later = edge + dt.timedelta(seconds=1)
    se = frames.sessions(
        spark,
        [(1, 1, 1, edge, later, "completed"), (2, 2, 1, later, later, "abandoned"), (3, 2, 1, later, later, "completed")],
    )
    assert tuples(panels.active_7d(isl, se, at("2024-06-08 00:00:00"))) == [(1, 1), (2, 0)]


def test_reference_time_with_and_without_sessions(spark):
    pl = frames.players(spark, [{"player_id": 1}, {"player_id": 2}, {"player_id": 3}])
    tx = frames.transactions(spark, [(1, 1, 5), (2, 2, 5)])
    se = simple_sessions(spark, [(1, 1, 1), (4, 1, 1), (9, 3, 1)])
    assert tuples(joins.reference_time(pl, tx, se)) == [(1, minutes(4)), (2, at("2024-05-01 00:00:00"))]


def test_session_window_around_the_last_login(spark):
    day = dt.timedelta(days=1)
    start = dt.date(2024, 10, 1)
    pl = frames.players(
        spark,
        [
            {"player_id": 1, "create_date": start, "last_login_date": start - day},
            {"player_id": 2, "create_date": start, "last_login_date": start},
            {"player_id": 3, "create_date": start, "last_login_date": start + 9 * day},
            {"player_id": 4, "create_date": start, "last_login_date": AS_OF + 9 * day},
        ],
    )
    got = {r.player_id: (r.window_end, r.window_days) for r in derive.session_window_of(pl, AS_OF).collect()}
    assert got == {
        1: (start + day, 1), 2: (start + day, 1), 3: (start + 9 * day, 9), 4: (AS_OF, 30)
    }


def test_growth_phase_borders(spark):
    start = dt.date(2024, 5, 1)
    pl = frames.players(
        spark,
        [{"player_id": d, "create_date": start + dt.timedelta(days=d)} for d in (0, 59, 60, 119, 120)]
        + [{"player_id": 500, "region": None}],
    )
    weights = dimensions.growth_weight_dimension(spark, {"LATAM": (0.05, 0.20, 0.32)})
    got = {r.player_id: (r.phase, r.expected_weight) for r in derive.growth_phases(pl, start, weights).collect()}
    assert got == {
        0: (1, 0.05), 59: (1, 0.05), 60: (2, 0.20), 119: (2, 0.20), 120: (3, 0.32), 500: (1, None)
    }


def test_growth_phase_of_no_date(spark):
    from playlens.functions import times

    row = spark.createDataFrame([(None,)], "d date").select(times.growth_phase(F.col("d"), AS_OF).alias("p")).first()
    assert row.p is None


def test_active_7d_ends_at_the_reference_time(spark):
    isl = spark.createDataFrame([(1,)], "island_id bigint")
    se = spark.createDataFrame(
        [(1, 1, dt.datetime(2024, 6, 7)), (1, 2, dt.datetime(2025, 1, 1))], "island_id bigint, player_id bigint, start_time timestamp_ntz"
    )
    assert tuples(panels.active_7d(isl, se, dt.datetime(2024, 6, 8)).select("island_id", "active_players")) == [(1, 1)]


def test_latest_located_keeps_sessions_without_a_start_time(spark):
    se = spark.createDataFrame(
        [(1, 1, None, 5, "completed"), (2, 1, dt.datetime(2024, 1, 1), 5, "completed")],
        "session_id bigint, player_id bigint, start_time timestamp_ntz, time_played_minutes bigint, status string",
    )
    pl = frames.players(spark, [{"player_id": 1}])
    assert [r.session_id for r in globe.latest_located(se, pl, n=2).collect()] == [2, 1]
    with pytest.raises(ValueError):
        globe.latest_located(se, pl, n=10**6)


def test_a_session_must_run_in_utc(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "t timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError):
            tables.with_zone(df)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tables.save_tables({}, "unused") == {}


def test_churn_and_recent_activity_complement_each_other(spark):
    day = dt.timedelta(days=1)
    pl = frames.players(
        spark, [{"player_id": d, "last_login_date": AS_OF - d * day} for d in range(0, 30)]
    )
    gone = {r.player_id for r in filters.churned(pl, AS_OF).collect()}
    here = {r.player_id for r in filters.recently_active(pl, AS_OF).collect()}
    assert gone == set(range(14, 30)) and here == set(range(14))
    weights = cohorts.session_weights(pl, AS_OF).collect()
    assert sum(r.weight == 5.0 for r in weights) == 14
    assert abs(sum(r.probability for r in weights) - 1) < 1e-12


def test_unknown_country_keeps_the_player(spark):
    pl = frames.players(spark, [{"player_id": 1}, {"player_id": 2, "country": "Atlantis"}])
    countries = spark.createDataFrame([(pl.where("player_id = 1").first().country, 7)], "country string, region_id int")
    regions = spark.createDataFrame([(7, "LATAM")], "region_id int, region string")
    assert tuples(joins.player_region(pl, countries, regions).select("player_id", "region")) == [(1, "LATAM"), (2, None)]


def test_nonblank_drops_null_empty_and_any_white_space(spark):
    rows = [(1, None), (2, ""), (3, "  \t\n"), (4, "  \x0b\x85"), (5, " hi "), (6, "é")]
    turns = spark.createDataFrame(rows, "conv_id bigint, content string")
    assert [r.conv_id for r in filters.nonblank(turns).orderBy("conv_id").collect()] == [5, 6]


def test_answers_of_all_reply_shapes(spark):
    bodies = [
        (1, 200, '{"output":[{"content":[{"text":"a"}]}]}'),
        (2, 200, '{"choices":[{"message":{"content":"b"}}]}'),
        (3, 200, '{"output":[],"choices":[{"message":{"content":"c"}}]}'),
        (4, 200, '{"other":1}'),
        (5, 503, "busy"),
    ]
    df = spark.createDataFrame(bodies, "id bigint, code int, body string")
    got = {r.id: r.answer for r in chat.response_text(df, "code").collect()}
    assert got == {
        1: "a", 2: "b", 3: "c",
        4: '❌ Error: Unexpected response format. Response: {"other":1}',
        5: "❌ API Error 503: busy",
    }


def test_text_and_number_helpers(spark):
    row = spark.range(1).select(
        times.local_time_text(F.lit("2024-01-30 03:04:05").cast("timestamp_ntz"), "-05:00", "EST").alias("local"),
        times.long_date_text(F.lit("2024-01-30 23:57:00").cast("timestamp_ntz")).alias("long"),
        texts.island_label(F.lit("Parkour"), F.lit(16)).alias("label"),
        numbers.clamp(F.lit(1), 3, 120).alias("low"),
        numbers.clamp(F.lit(500), 3, 120).alias("high"),
        numbers.one_decimal(F.lit(12345.67)).alias("plain"),
    ).collect()[0]
    assert row.local == "2024-01-29 22:04:05 EST"
    assert row.long == "January 30, 2024 at 11:57 PM"
    assert row.label == "Parkour Arena 16"
    assert (row.low, row.high, row.plain) == (3, 120, "12345.7")


def test_rollup_total_equals_sum_of_islands(spark):
    se = simple_sessions(spark, [(1, 1, 1), (2, 1, 1), (3, 1, 2)])
    assert tuples(panels.island_rollup(se)) == [(1, 0, 2, 20), (2, 0, 1, 10), (None, 1, 3, 30)]
