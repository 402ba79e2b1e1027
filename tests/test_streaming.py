from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from playlens.operators import globe
from playlens.session import workspace
from playlens.sources import bindings
from playlens.sources.bindings import Bindings
from playlens.streaming import activity
from tests.frames import tuples


@pytest.fixture
def files(spark, bound):
    """The events in five files, in no order of time, so that every batch brings late rows."""
    folder = workspace(spark, "events")
    bound.raw("events").repartition(5, "event_id").write.parquet(folder)
    return folder


def stream(spark, folder):
    session = activity.utc_session(spark)
    events = activity.read_stream(session, folder, bindings.RAW["events"], files_per_batch=1)
    return session, bindings.sessions_from_events(events)


def test_complete_windows_equal_the_batch_twin(spark, bound, files):
    _, sessions = stream(spark, files)
    target = workspace(spark, "windows")
    query = activity.refresh_windows(activity.active_sessions(sessions), target, workspace(spark, "state"))
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 4
    assert tuples(activity.running_result(spark, target)) == tuples(activity.active_sessions(bound.sessions))


def test_appended_windows_are_closed_ones(spark, bound):
    session = activity.utc_session(spark)
    folder = workspace(spark, "ordered")
    days = bound.raw("events").orderBy("ts").coalesce(1)
    days.write.parquet(folder)
    events = activity.read_stream(session, folder, bindings.RAW["events"])
    target = workspace(spark, "closed")
    counts = activity.active_sessions(bindings.sessions_from_events(events))
    activity.append_windows(counts, target, workspace(spark, "state")).awaitTermination()
    closed = {tuple(r) for r in spark.read.parquet(target).collect()}
    everything = {tuple(r) for r in activity.active_sessions(bound.sessions).collect()}
    assert closed and closed <= everything
    newest = max(start for start, _, _ in everything)
    assert all((newest - start).total_seconds() <= 15 * 60 for start, _, _ in everything - closed)


def test_location_counts_add_up_and_resume(spark, bound, files):
    session, sessions = stream(spark, files)
    players = Bindings(session, bound.folder).players
    target, state = workspace(spark, "locations"), workspace(spark, "state")

    def run():
        activity.refresh_location_counts(sessions, players, target, state).awaitTermination()
        return tuples(activity.running_result(spark, target))

    expected = tuples(activity.count_locations(bound.sessions, bound.players))
    assert run() == expected
    # Nothing new: a restart from the same checkpoint adds nothing.
    assert run() == expected
    # More files arrive: only they are added.
    bound.raw("events").limit(100).write.mode("append").parquet(files)
    extra = bindings.sessions_from_events(bound.raw("events").limit(100)).where("status = 'completed'").count()
    assert sum(row[2] for row in run()) == sum(row[2] for row in expected) + extra


def test_newest_sessions_across_batches_and_late_files(spark, bound, files):
    session, sessions = stream(spark, files)
    players = Bindings(session, bound.folder).players
    target, state = workspace(spark, "newest"), workspace(spark, "state")
    query = activity.refresh_newest(sessions, players, target, state, n=40)
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 4
    expected = globe.latest_located(bound.sessions, bound.players, 40)
    columns = expected.columns
    assert tuples(activity.running_result(spark, target).select(columns)) == tuples(expected)


def total(rows):
    return rows.agg(F.sum("k").alias("k"), F.sum("v").alias("v"))


def test_a_batch_run_twice_changes_nothing(spark):
    target = workspace(spark, "slots")
    frames = [spark.createDataFrame([(i, 10 * i)], "k bigint, v bigint") for i in range(3)]
    for batch_id in (0, 0, 1, 1, 2, 2, 2):
        activity._advance(batch_id, target, "one", frames[batch_id], total)
    assert tuples(activity.running_result(spark, target)) == [(3, 30)]
    # A new checkpoint starts again from batch 0, while the other slot holds an older query's.
    activity._advance(0, target, "two", frames[1], total)
    assert tuples(activity.running_result(spark, target)) == [(1, 10)]
    activity._advance(0, target, "two", frames[2], total)
    assert tuples(activity.running_result(spark, target)) == [(2, 20)]


def test_an_empty_result_replaces_an_older_one(spark):
    target = workspace(spark, "slots")
    rows = spark.createDataFrame([(1, 1)], "k bigint, v bigint")
    for batch_id in range(3):
        activity._advance(batch_id, target, "old", rows, lambda found: found)
    assert activity.running_result(spark, target).count() == 3
    # Batch 0 of a new query finds nothing: its slot is empty, and its mark says that it is the last.
    activity._advance(0, target, "new", rows.where("k > 1"), lambda found: found)
    assert activity.running_result(spark, target).count() == 0
    activity._advance(1, target, "new", rows, lambda found: found)
    assert tuples(activity.running_result(spark, target)) == [(1, 1)]


def test_a_batch_that_fails_leaves_the_result(spark):
    target = workspace(spark, "slots")
    rows = spark.createDataFrame([(1, 1)], "k bigint, v bigint")
    activity._advance(0, target, "one", rows, total)
    broken = rows.withColumn("k", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        activity._advance(1, target, "one", broken, total)
    assert tuples(activity.running_result(spark, target)) == [(1, 1)]
    activity._advance(1, target, "one", rows, total)
    assert tuples(activity.running_result(spark, target)) == [(2, 2)]


def test_many_batches_leave_two_slots_and_nothing_else(spark, bound):
    """A micro-batch per file: the shared folder holds what it held before, and the two slots."""
    from pathlib import Path

    root = Path(spark.conf.get("spark.checkpoint.dir"))
    folder, target, state = (workspace(spark, name) for name in ("events", "newest", "state"))
    bound.raw("events").limit(300).repartition(30, "event_id").write.parquet(folder)
    before = {p.name for p in root.iterdir()}
    session, sessions = stream(spark, folder)
    players = Bindings(session, bound.folder).players
    query = activity.refresh_newest(sessions, players, target, state, n=20)
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 25
    assert {p.name for p in root.iterdir()} - before == {Path(target).name, Path(state).name}
    assert {str(p.relative_to(target)) for p in Path(target).glob("*/*")} == {
        f"{kind}/slot={k}" for kind in ("rows", "marks") for k in (0, 1)
    }
    files = [p for p in Path(target).rglob("*.parquet")]
    assert len(files) <= 4
    expected = globe.latest_located(bindings.sessions_from_events(spark.read.parquet(folder)), bound.players, 20)
    assert tuples(activity.running_result(spark, target).select(expected.columns)) == tuples(expected)


def test_only_the_last_slot_is_read(spark):
    from tests.test_plans import scans

    target = workspace(spark, "slots")
    rows = spark.range(100).selectExpr("id AS k", "id AS v")
    for batch_id in range(2):
        activity._advance(batch_id, target, "one", rows, lambda found: found)
    assert [n for scan, n in scans(activity.running_result(spark, target)) if "k#" in scan] == [200]
