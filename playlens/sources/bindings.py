"""Domain views over the TPC-H-like test tables.

The only module that knows those tables' names and columns (see FIXTURES.md, section 3).
Every view covers its whole table.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from playlens.functions import numbers, texts, times
from playlens.operators import cohorts
from playlens.sources import dimensions

START = dt.date(2001, 1, 29)
END = dt.date(2001, 8, 1)
SESSIONS_AS_OF = dt.datetime(2024, 1, 31)
COUNTRIES = ["NATION_1", "NATION_6", "NATION_11", "NATION_16", "NATION_21"]
COHORT_REGION = "AMERICA"
KIND = "purchase_battle_pass"
# Expected shares of new players per region in phases 1, 2 and 3; the test regions' own numbers.
PHASE_WEIGHTS = {
    "AFRICA": (0.40, 0.35, 0.30),
    "EUROPE": (0.30, 0.25, 0.25),
    "ASIA": (0.20, 0.25, 0.25),
    "AMERICA": (0.10, 0.15, 0.20),
}

RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _device(player_id: Column) -> Column:
    slot = player_id % 20
    return F.when(slot < 11, "mobile").when(slot < 17, "pc").otherwise("console")


def _ip(player_id: Column) -> Column:
    return F.lit(16777216) + (player_id * 7919) % F.lit(3741319168)


def sessions_from_events(events: DataFrame) -> DataFrame:
    """Sessions view; works on a batch or a streaming `events` frame."""
    raw = F.floor("value").cast("bigint")
    return (
        events.withColumn("raw_minutes", raw)
        .withColumn("time_played_minutes", numbers.clamp(F.col("raw_minutes"), 3, 120))
        .select(
            F.col("event_id").alias("session_id"),
            F.col("user_id").alias("player_id"),
            F.col("ts").alias("start_time"),
            times.minutes_after(F.col("ts"), F.col("time_played_minutes")).alias("end_time"),
            _ip(F.col("user_id")).alias("ip_address"),
            F.get_json_object("props", "$.k").cast("bigint").alias("island_id"),
            (F.col("raw_minutes") * 20 + F.col("event_id") % 20).alias("score"),
            (F.col("event_id") % 11).alias("objectives_completed"),
            (F.col("event_id") % 16).alias("deaths"),
            (F.col("event_id") % 21).alias("eliminations"),
            "raw_minutes",
            "time_played_minutes",
            F.when(~F.col("event_type").isin("error", "view"), "completed")
            .when(F.col("event_type") == "view", "abandoned")
            .otherwise("crashed")
            .alias("status"),
            _device(F.col("user_id")).alias("device_type"),
        )
    )


class Bindings:
    """Lazy domain frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.folder}/{name}.parquet")

    def with_place(self, df: DataFrame, key: str) -> DataFrame:
        """Add nation and region columns, one lookup after the other.

        Joined to each other first, the two would be estimated at the product of their sizes,
        and Spark would stream that single partition past a broadcast of `df`.
        """
        return df.join(self.raw("nation"), F.col(key) == F.col("n_nationkey")).join(
            self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )

    @cached_property
    def countries(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_name").alias("country"), F.col("n_regionkey").alias("region_id"))

    @cached_property
    def regions(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region"))

    @cached_property
    def players(self) -> DataFrame:
        last_order = self.raw("orders").groupBy("o_custkey").agg(
            F.max(F.col("o_orderdate").cast("date")).alias("last_order")
        )
        created = F.date_add(times.as_date(START), (F.col("c_custkey") * 7 % 185).cast("int"))
        level = F.greatest(F.lit(1), F.floor(F.col("c_acctbal") / 200).cast("bigint"))
        return (
            self.with_place(self.raw("customer"), "c_nationkey")
            .join(last_order, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(
                F.col("c_custkey").alias("player_id"),
                _ip(F.col("c_custkey")).alias("ip_address"),
                created.alias("create_date"),
                F.concat(F.lit("CITY_"), F.col("n_nationkey").cast("string")).alias("city"),
                F.concat(F.lit("ST_"), F.col("n_nationkey").cast("string")).alias("state"),
                F.col("n_name").alias("country"),
                F.col("r_name").alias("region"),
                (F.col("n_nationkey") * 6 - 72).cast("double").alias("latitude"),
                (F.col("n_nationkey") * 14 - 168).cast("double").alias("longitude"),
                level.cast("bigint").alias("player_level"),
                _device(F.col("c_custkey")).alias("device_type"),
                (level * (20 + F.col("c_custkey") % 41)).cast("bigint").alias("total_time_played"),
                F.greatest(created, F.coalesce(F.col("last_order"), created)).alias("last_login_date"),
            )
        )

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions_from_events(self.raw("events"))

    @cached_property
    def transactions(self) -> DataFrame:
        """Every order is a transaction; those of the lowest priority are refunds."""
        priority = F.col("o_orderpriority")
        kind = (
            F.when(priority == "1-URGENT", "purchase_skin")
            .when(priority == "2-HIGH", "purchase_emote")
            .when(priority == "3-MEDIUM", "purchase_bundle")
            .when(priority == "4-NOT SPECIFIED", "purchase_battle_pass")
            .otherwise("refund")
        )
        cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
        return (
            self.raw("orders")
            .withColumn("type", kind)
            .select(
                F.col("o_orderkey").alias("transaction_id"),
                F.col("o_custkey").alias("player_id"),
                "type",
                F.col("o_orderdate").alias("timestamp"),
                F.when(F.col("type") == "refund", -cents).otherwise(cents).alias("amount"),
                (F.lit(1000) + F.col("o_orderkey") % 9000).cast("bigint").alias("credit_card_last4"),
            )
        )

    @cached_property
    def islands(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("island_id"),
            (F.col("p_partkey") % 37 + 1).alias("creator_player_id"),
            texts.island_label(F.col("p_type"), F.col("p_partkey")).alias("island_name"),
            F.col("p_type").alias("category"),
            F.date_add(times.as_date(START), (F.col("p_partkey") % 31).cast("int")).alias("create_date"),
            F.lit(0).cast("bigint").alias("total_plays"),
            ((F.col("p_size") % 16 + 35) / 10).alias("avg_rating"),
        )

    @cached_property
    def cohorts(self) -> DataFrame:
        return dimensions.cohort_dimension(self.spark, START)

    @cached_property
    def player_cohorts(self) -> DataFrame:
        return cohorts.assign_cohorts(self.players, self.transactions, END, COHORT_REGION)

    @cached_property
    def phase_weights(self) -> DataFrame:
        return dimensions.growth_weight_dimension(self.spark, PHASE_WEIGHTS)

    @cached_property
    def turns(self) -> DataFrame:
        return self.raw("conversations").withColumnRenamed("text", "content")

    @cached_property
    def responses(self) -> DataFrame:
        """Assistant turns as replies: the output list, the choices list, an HTTP error, another body."""
        text = F.col("content")
        output = F.to_json(
            F.struct(F.array(F.struct(F.array(F.struct(text.alias("text"))).alias("content"))).alias("output"))
        )
        choices = F.to_json(
            F.struct(F.array(F.struct(F.struct(text).alias("message"))).alias("choices"))
        )
        other = F.to_json(F.struct(text.alias("reply")))
        shape = (F.col("conv_id") + F.col("turn")) % 4
        return self.turns.where(F.col("role") == "assistant").select(
            "conv_id", "turn", F.when(shape == 2, 503).otherwise(200).alias("status"),
            F.when(shape == 0, output).when(shape == 1, choices).when(shape == 2, text).otherwise(other).alias("body"),
        )

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return {
            "players": self.players,
            "islands": self.islands,
            "sessions": self.sessions,
            "transactions": self.transactions,
            "cohorts": self.cohorts,
            "player_cohorts": self.player_cohorts,
        }
