"""Small constant tables: growth weights, cohorts and the sample globe."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Cohort ids, names and days after the start on which each was created.
COHORTS = [
    (1, "veteran_player", 0),
    (2, "new_player", 0),
    (3, "spenders", 0),
    (4, "mobile_players", 0),
    (5, "latam_players", 60),
    (6, "churned_players", 0),
    (7, "binge_players", 0),
    (8, "casual_players", 0),
]

# The globe shown when no session qualifies (country, city, latitude,
# longitude, active sessions, players, average minutes).
SAMPLE_LOCATIONS = [
    ("USA", "New York", 40.7128, -74.0060, 150, 150, 45.5),
    ("Japan", "Tokyo", 35.6762, 139.6503, 120, 120, 52.3),
    ("Brazil", "São Paulo", -23.5505, -46.6333, 90, 90, 38.7),
    ("UK", "London", 51.5074, -0.1278, 80, 80, 41.2),
    ("Germany", "Berlin", 52.5200, 13.4050, 70, 70, 47.8),
    ("Australia", "Sydney", -33.8688, 151.2093, 65, 65, 39.2),
    ("Canada", "Toronto", 43.6532, -79.3832, 60, 60, 44.1),
    ("France", "Paris", 48.8566, 2.3522, 55, 55, 41.8),
    ("India", "Mumbai", 19.0760, 72.8777, 50, 50, 48.3),
    ("Mexico", "Mexico City", 19.4326, -99.1332, 45, 45, 42.7),
]

def _constant(spark: SparkSession, rows: list[tuple], columns: list[tuple]) -> DataFrame:
    """A constant table. From Arrow it becomes a local relation, whose size Spark knows."""
    schema = pa.schema(columns)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema))


def growth_weight_dimension(
    spark: SparkSession, weights: dict[str, tuple[float, float, float]]
) -> DataFrame:
    """(phase, region, expected_weight) from a table of weights per region."""
    rows = [
        (phase, region, share)
        for region, shares in weights.items()
        for phase, share in enumerate(shares, start=1)
    ]
    columns = [("phase", pa.int32()), ("region", pa.string()), ("expected_weight", pa.float64())]
    return _constant(spark, rows, columns)


def cohort_dimension(spark: SparkSession, start: dt.date) -> DataFrame:
    rows = [(cid, name, start + dt.timedelta(days=days)) for cid, name, days in COHORTS]
    columns = [("cohort_id", pa.int64()), ("name", pa.string()), ("create_date", pa.date32())]
    return _constant(spark, rows, columns)


def sample_locations(spark: SparkSession) -> DataFrame:
    return _constant(spark, SAMPLE_LOCATIONS, [
        ("country", pa.string()), ("city", pa.string()),
        ("latitude", pa.float64()), ("longitude", pa.float64()),
        ("active_sessions", pa.int64()), ("player_count", pa.int64()),
        ("avg_session_duration", pa.float64()),
    ])
