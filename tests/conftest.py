from __future__ import annotations

import tempfile
from pathlib import Path

import pytest

from playlens.session import build_session
from playlens.sources.bindings import Bindings

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", 8,
        {
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.log.level": "ERROR",
            "spark.sql.maxMetadataStringLength": "100000",
            "spark.sql.debug.maxToStringFields": "1000",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="playlens-warehouse-"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="playlens-shared-"),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bound(spark):
    if not DATA.exists():
        pytest.skip("test tables are not mounted")
    return Bindings(spark, str(DATA))


@pytest.fixture(scope="session")
def stored(spark, bound):
    """The domain tables saved as Parquet, sessions clustered by time, players with their region."""
    from playlens.session import workspace
    from playlens.sources import tables
    from playlens.sources.schemas import RAW_PLAYERS

    folder = workspace(spark, "stored")
    frames = {name: tables.with_zone(df) for name, df in bound.tables.items()}
    # Keep one file per range: these tables are so small that they would end up in one.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables.save_tables(frames, folder, {"sessions": ["start_time", "session_id"]})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return {name: tables.scan(spark, folder, name, RAW_PLAYERS if name == "players" else None) for name in frames}
