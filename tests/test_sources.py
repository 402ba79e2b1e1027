from __future__ import annotations

import uuid

import pytest

from playlens.operators import aggregates, globe, panels
from playlens.session import workspace
from playlens.sources import bindings, tables
from tests.frames import tuples


@pytest.fixture
def schema(spark):
    name = f"play_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE SCHEMA {name}")
    yield name
    spark.sql(f"DROP SCHEMA {name} CASCADE")


def test_workspace_lies_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, two = workspace(spark, "x"), workspace(spark, "x")
    assert one.startswith(root) and one != two


def test_no_local_folder_on_a_cluster():
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key.replace(".", "_"), default)

    class Session:
        def __init__(self, master, **values):
            self.conf = Conf(spark_master=master, **values)

    for master in ("yarn", "local-cluster[3,2,1000]", "spark://host:7077"):
        with pytest.raises(ValueError):
            workspace(Session(master), "x")
        assert workspace(Session(master, spark_checkpoint_dir="hdfs:///shared"), "x").startswith("hdfs:///shared/x-")
    assert workspace(Session("local[4]"), "x")


def test_stored_tables_have_the_declared_schema_and_all_rows(bound, stored):
    counts = {r.table_name: r.cnt for r in tables.table_row_counts(bound.tables).collect()}
    assert counts == {r.table_name: r.cnt for r in tables.table_row_counts(stored).collect()}
    assert counts["players"] == 150 and counts["sessions"] == 1000 and counts["cohorts"] == 8
    assert dict(stored["sessions"].dtypes)["start_time"] == "timestamp"


def test_operators_agree_on_both_time_types(bound, stored):
    for run in (
        lambda t: globe.globe(t["sessions"], t["players"]),
        lambda t: panels.peak_concurrency(t["sessions"]),
        lambda t: panels.active_7d(t["islands"], t["sessions"], bindings.SESSIONS_AS_OF),
        lambda t: panels.peak_hours(t["sessions"], t["players"]),
        lambda t: aggregates.monthly_revenue(t["transactions"]),
    ):
        assert tuples(run(bound.tables)) == tuples(run(stored))


def test_catalog_tables_are_saved_listed_counted_and_overwritten(spark, bound, schema):
    frames = {name: bound.tables[name] for name in ("islands", "cohorts", "player_cohorts")}
    tables.save_catalog_tables(frames, schema)
    tables.save_catalog_tables(frames, schema)
    got = {r.table_name: r.cnt for r in tables.catalog_row_counts(spark, schema).collect()}
    assert got == {r.table_name: r.cnt for r in tables.table_row_counts(frames).collect()}
    assert tables.scan_catalog(spark, schema, "cohorts").count() == 8


def test_views_answer_sql(spark, bound):
    tables.register_views(bound.tables)
    plays = spark.sql("""
        SELECT island_id, COUNT(*) AS plays, SUM(time_played_minutes) AS minutes
        FROM sessions GROUP BY island_id""")
    assert sum(r.plays for r in plays.collect()) == bound.sessions.count()
    churn = spark.sql(f"""
        SELECT country, COUNT(*) AS players,
          COUNT_IF(DATEDIFF(DATE '{bindings.END}', last_login_date) >= 14) AS churned,
          COUNT_IF(DATEDIFF(DATE '{bindings.END}', last_login_date) >= 14) / COUNT(*) AS churn_rate
        FROM players GROUP BY country""")
    assert tuples(churn) == tuples(panels.churn_rate(bound.players, bindings.END).select(churn.columns))
    revenue = spark.sql("""
        SELECT TRUNC(timestamp, 'MM') AS month, SUM(amount) / 100 AS revenue
        FROM transactions WHERE amount > 0 GROUP BY 1""")
    assert tuples(revenue) == tuples(aggregates.monthly_revenue(bound.transactions))


def test_warehouse_tables_carry_the_derived_fields(spark, bound):
    from playlens.operators import cohorts, joins
    from playlens.plans import warehouse

    folder = workspace(spark, "warehouse")
    raw = {name: df for name, df in bound.tables.items() if name != "player_cohorts"}
    paths = warehouse.save_warehouse(spark, raw, folder, bindings.END, bindings.COHORT_REGION)
    assert set(paths) == set(bound.tables)
    folder = tables.current(spark, folder)
    players = tables.scan(spark, folder, "players")
    expected = cohorts.finalize_players(bound.players, bound.transactions)
    assert spark.read.parquet(paths["players"]).columns == players.columns
    assert tuples(players) == tuples(expected.select(players.columns))
    islands = tables.scan(spark, folder, "islands")
    plays = joins.total_plays(bound.islands, bound.sessions).select(islands.columns)
    assert tuples(islands) == tuples(plays)
    assert tuples(tables.scan(spark, folder, "player_cohorts")) == tuples(bound.player_cohorts)
    assert tuples(globe.globe(tables.scan(spark, folder, "sessions"), players)) == tuples(
        globe.globe(bound.sessions, bound.players)
    )
    with_region = joins.player_region(players, bound.countries, bound.regions)
    assert tuples(panels.peak_hours(tables.scan(spark, folder, "sessions"), with_region)) == tuples(
        panels.peak_hours(bound.sessions, bound.players)
    )


def test_a_failed_save_leaves_the_last_snapshot(spark, bound):
    from pathlib import Path

    from pyspark.sql import functions as F

    from playlens.plans import warehouse

    folder = workspace(spark, "warehouse")
    raw = {name: df for name, df in bound.tables.items() if name != "player_cohorts"}
    save = lambda frames: warehouse.save_warehouse(spark, frames, folder, bindings.END, bindings.COHORT_REGION)
    with pytest.raises(ValueError):
        tables.current(spark, folder)
    save(raw)
    first = tables.current(spark, folder)
    names = lambda: sorted(p.name for p in Path(folder).iterdir())
    assert names() == ["saves", Path(first).name], "no staging folder stays"
    before = tuples(tables.scan(spark, first, "player_cohorts"))
    broken = raw | {"transactions": raw["transactions"].withColumn("amount", F.raise_error(F.lit("lost")).cast("bigint"))}
    with pytest.raises(Exception, match="lost"):
        save(broken)
    assert tables.current(spark, folder) == first and names() == ["saves", Path(first).name]
    assert tuples(tables.scan(spark, first, "player_cohorts")) == before
    fewer = raw | {"players": raw["players"].where("player_id < 50")}
    save(fewer)
    second = tables.current(spark, folder)
    assert tables.scan(spark, second, "players").count() == 50 and tables.scan(spark, first, "players").count() == 150
    save(raw)
    assert names() == sorted(["saves", Path(second).name, Path(tables.current(spark, folder)).name]), "two snapshots are kept"


def test_catalog_keys_join_without_a_shuffle(spark, bound):
    from playlens.plans.queries import build

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = build("catalog_sessions_with_location")(spark, bound.folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "Exchange" not in text and "SelectedBucketsCount: 8 out of 8" in text
