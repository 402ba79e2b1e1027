"""Reproducible sampling: exact fractions and one row per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from playlens.functions.hashing import HASH_BITS, draw
from playlens.operators.joins import payer_ids

_BUCKET_BITS = 20


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Exactly round(fraction * rows) rows without replacement; `key` must be unique.

    The rows with the smallest draws win, ties by key, so the sample is one filter on the draw. Where to cut is
    a scalar: a histogram of the draws' leading bits (2^20 buckets at most) finds the bucket in
    which the sample ends, and only that bucket, a millionth of the table, is ranked. Both
    look at the key alone; the columns of `df` are read once.
    """
    drawn = df.select(F.col(key).alias("key"), draw(F.col(key), seed).alias("draw")).withColumn(
        "bucket", F.shiftright("draw", HASH_BITS - _BUCKET_BITS)
    )
    histogram = drawn.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    # The first bucket that reaches the wanted size, and how many of its rows are needed.
    edge = (
        histogram.select(
            "bucket",
            (F.sum("n").over(order) - F.col("n")).alias("below"),
            "n",
            F.bround(fraction * total).cast("bigint").alias("wanted"),
        )
        .where((F.col("below") + F.col("n") >= F.col("wanted")) & (F.col("wanted") > 0))
        .agg(F.min(F.struct("bucket", (F.col("wanted") - F.col("below")).alias("rest"))))
        .scalar()
    )
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("draw", "key"))
    last = (
        drawn.where(F.col("bucket") == edge["bucket"])
        .withColumn("rank", rank)
        .where(F.col("rank") == edge["rest"])
        .agg(F.max(F.struct("draw", "key")))
        .scalar()
    )
    return df.where(F.struct(draw(F.col(key), seed).alias("draw"), F.col(key).alias("key")) <= last)


def one_per_player(sessions: DataFrame, transactions: DataFrame, seed: int) -> DataFrame:
    """One random session of every player with a transaction; a hash aggregate of two numbers.

    Two sessions of a player share a draw of 60 bits with negligible probability; then either
    may be the one.
    """
    pick = F.min_by("session_id", draw(F.col("session_id"), seed)).alias("session_id")
    picks = sessions.groupBy("player_id").agg(pick)
    return picks.join(payer_ids(transactions), "player_id", "left_semi").select("player_id", "session_id")
