"""Small hand-made frames."""

from __future__ import annotations

import datetime as dt

AS_OF = dt.date(2024, 10, 31)


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def sessions(spark, rows):
    """rows: (session_id, player_id, island_id, start, end, status)."""
    data = [
        (sid, pid, island, start, end,
         None if start is None or end is None else int((end - start).total_seconds() // 60), status)
        for sid, pid, island, start, end, status in rows
    ]
    return spark.createDataFrame(
        data,
        "session_id bigint, player_id bigint, island_id bigint, start_time timestamp_ntz, "
        "end_time timestamp_ntz, time_played_minutes bigint, status string",
    )


def players(spark, rows):
    """rows: dicts with any of the player attributes."""
    base = {
        "player_id": 1, "create_date": dt.date(2024, 5, 1), "city": "Lima", "country": "Peru",
        "region": "LATAM", "latitude": -12.0, "longitude": -77.0, "player_level": 1,
        "device_type": "pc", "total_time_played": 200, "last_login_date": AS_OF,
    }
    names = list(base)
    return spark.createDataFrame(
        [tuple({**base, **row}[n] for n in names) for row in rows],
        "player_id bigint, create_date date, city string, country string, region string, "
        "latitude double, longitude double, player_level bigint, device_type string, "
        "total_time_played bigint, last_login_date date",
    )


def transactions(spark, rows):
    """rows: (transaction_id, player_id, amount)."""
    return spark.createDataFrame(rows, "transaction_id bigint, player_id bigint, amount bigint")


def islands(spark, rows):
    """rows: (island_id, creator_player_id, category, avg_rating)."""
    return spark.createDataFrame(
        [(i, c, f"{k} Arena {i}", k, 0, r) for i, c, k, r in rows],
        "island_id bigint, creator_player_id bigint, island_name string, category string, "
        "total_plays bigint, avg_rating double",
    )


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))
