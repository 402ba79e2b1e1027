"""Physical plans: what is read, what is shuffled, and how skew is met."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from playlens.operators import aggregates, cohorts, filters, globe, joins, panels
from playlens.plans.queries import REPORTS, build
from playlens.sources import tables
from tests import frames
from tests.conftest import DATA

EAGER = {
    "save_tables_roundtrip", "saved_tables", "saved_peak_hours", "table_row_counts", "stream_active_sessions_5min",
    "stream_closed_windows", "stream_location_counts", "stream_globe", "stored_latest_sessions", "stored_globe",
    "catalog_row_counts", "catalog_sessions_with_location",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def settings(spark, **values):
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def scans(df) -> list[tuple[str, int]]:
    """(columns read, rows read) per file scan of the executed main plan."""
    df.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("Scan"):
            found.append((node.simpleString(1000), node.metrics().get("numOutputRows").get().value()))
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("name", sorted(set(REPORTS) - EAGER))
def test_no_nested_loops_and_no_python_rows(spark, bound, name):
    text = plan(build(name)(spark, bound.folder))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "EvalPython" not in text and "InPandas" not in text


def all_scans(spark, df) -> list[tuple[str, int]]:
    """(table and columns, rows read) per scan that ran, those of subqueries included."""
    df.collect()
    found = {}

    def walk(node):
        name = node.nodeName()
        if name.startswith("Scan") or name.startswith("FileScan"):
            found[node.id()] = (node.simpleString(1000), node.metrics().get("numOutputRows").get().value())
        if name.startswith("AdaptiveSparkPlan"):
            walk(node.executedPlan())
        if name.endswith("QueryStage") or name == "ReusedSubquery":
            walk(node.plan() if name.endswith("QueryStage") else node.child())
        for nodes in (node.children(), node.subqueries()):
            for i in range(nodes.size()):
                walk(nodes.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return list(found.values())


def test_flagship_reads_nothing_more_when_candidates_suffice(spark, stored):
    """Sessions once for the candidates, players once; the branch over all sessions reads no row."""
    before = folders(spark)
    df = globe.latest_located(stored["sessions"], stored["players"], n=50)
    assert folders(spark) == before, "nothing is written while the query is built"
    read = all_scans(spark, df)
    assert sum(n for scan, n in read if "start_time" in scan) == stored["sessions"].count()
    assert sum(n for scan, n in read if "latitude" in scan) == stored["players"].count()
    assert folders(spark) == before, "nor when it is run"


def folders(spark):
    from pathlib import Path

    return sorted(p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).iterdir())


def test_flagship_joins_all_sessions_when_candidates_do_not_suffice(spark, stored):
    few = stored["players"].where("player_id % 15 = 0")
    df = globe.latest_located(stored["sessions"], few, n=30, margin=1)
    rows = df.collect()
    expected = joins.with_location(stored["sessions"], few).orderBy(F.desc("start_time"), F.desc("session_id")).limit(30)
    assert len(rows) == 30 and {r["session_id"] for r in rows} == {r["session_id"] for r in expected.collect()}


def test_newest_sessions_skip_files_by_their_time(spark, bound):
    from playlens.session import workspace

    folder = workspace(spark, "by-time")
    sessions = tables.with_zone(bound.sessions)
    with settings(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        tables.save_tables({"sessions": sessions}, folder, {"sessions": ["start_time", "session_id"]})
    saved = tables.scan(spark, folder, "sessions")
    bounds = spark.read.parquet(tables.save_time_bounds(saved, folder))
    everything = saved.count()
    for n in (1, 40, 100):
        df = globe.latest(saved, n, since=tables.newest_since(bounds, n))
        read = [(scan, rows) for scan, rows in all_scans(spark, df) if "session_id" in scan]
        assert 0 < sum(rows for _, rows in read) <= everything / 2
        assert df.select("session_id").collect() == globe.latest(bound.sessions, n).select("session_id").collect()
    # More rows than there are, or a status that nobody has: no bound, and all rows count.
    for n, status in ((10 * everything, "completed"), (5, "paused")):
        since = tables.newest_since(bounds, n, status)
        assert globe.latest(saved, n, status, since).count() == globe.latest(saved, n, status).count()
    located = globe.latest_located(saved, bound.players, 20, since=tables.newest_since(bounds, 80))
    assert located.select("session_id").collect() == globe.latest_located(bound.sessions, bound.players, 20).select("session_id").collect()


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_every_query_reads_a_table(spark, bound, name):
    assert re.search(r"Location: \w+\s*\[.*parquet|FileScan parquet", plan(build(name)(spark, bound.folder)))


def test_filters_reach_the_scan(spark, stored):
    assert "EqualTo(status,completed)" in plan(filters.completed(stored["sessions"]))
    assert "GreaterThan(amount,0)" in plan(joins.payments(stored["transactions"], stored["players"]))
    assert "In(country, [Brazil,Mexico])" in plan(
        aggregates.monthly_new(stored["players"], ["Brazil", "Mexico"])
    )
    from playlens.sources.bindings import SESSIONS_AS_OF

    assert "GreaterThan(start_time," in plan(
        panels.active_7d(stored["islands"], stored["sessions"], SESSIONS_AS_OF)
    )


def test_unused_login_lookup_is_dropped(spark, bound):
    text = plan(aggregates.device_distribution(bound.players))
    assert "customer.parquet" in text and "orders.parquet" not in text


def test_facts_are_combined_before_they_are_joined(spark, stored):
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        for df in (
            aggregates.revenue_by_country(stored["transactions"], stored["players"]),
            panels.peak_hours(stored["sessions"], stored["players"]),
            joins.lifetime_spend(stored["players"], stored["transactions"]),
            cohorts.assign_cohorts(stored["players"], stored["transactions"], frames.AS_OF, "LATAM"),
        ):
            text = plan(df)
            join = text.index("SortMergeJoin")
            assert "partial_" in text[join:] or "HashAggregate" in text[join:]


def test_bucketed_tables_join_without_a_shuffle(spark, stored):
    schema = f"bucketed_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE SCHEMA {schema}")
    try:
        tables.save_catalog_tables(
            {name: stored[name] for name in ("players", "sessions")}, schema,
            {"players": (4, "player_id"), "sessions": (4, "player_id")},
        )
        with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
            text = plan(joins.with_location(
                tables.scan_catalog(spark, schema, "sessions"), tables.scan_catalog(spark, schema, "players")
            ))
        assert "SortMergeJoin" in text and "Exchange" not in text
    finally:
        spark.sql(f"DROP SCHEMA {schema} CASCADE")


def test_hot_player_is_split_by_adaptive_execution(spark):
    se = spark.range(0, 200_000, 1, 16).select(
        F.col("id").alias("session_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).cast("bigint").alias("player_id"),
        F.lit("completed").alias("status"),
        F.repeat(F.lit("x"), 10).alias("pad"),
    )
    pl = spark.range(5000).select(
        F.col("id").alias("player_id"), F.lit("Lima").alias("city"), F.lit("Peru").alias("country"),
        F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"),
    )
    with settings(
        spark,
        **{
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        },
    ):
        df = joins.with_location(se, pl)
        assert len(df.collect()) == 200_000
        assert "SortMergeJoin(skew=true)" in plan(df)


def test_windows_run_over_bounded_keys_only(spark, stored):
    text = plan(panels.peak_concurrency(stored["sessions"]))
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
    assert any("minute" in k for k in keys) and any("day" in k for k in keys)
    assert len(keys) == 3 and sum("minute" in k for k in keys) == 1, "the edges are dealt once"
    assert "SinglePartition" not in text


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not mounted")
def test_payload_gathers_no_conversation(spark, bound):
    from playlens.operators import chat

    text = plan(chat.conversation_payload(bound.turns))
    assert "collect_list" not in text and text.count("FileScan") == 2
