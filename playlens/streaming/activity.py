"""Activity counts kept up to date from a stream of sessions.

Inside `foreachBatch` the batch is fixed: filters and columns no longer reach the scan. So both
are narrowed on the stream.

A running result lies in two slots that batches write in turn. What is in a slot says its mark, a
table of one row beside it: the query whose checkpoint counted the batch, the batch, and how many
queries have written to the target before. So an empty result has a mark like any other, and no
clock decides which is the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from playlens.operators import globe
from playlens.operators.filters import completed


def utc_session(spark: SparkSession) -> SparkSession:
    """A session on the same context that runs in UTC.

    Watermarks need TIMESTAMP, while session times are stored without a zone. In UTC the
    cast there and back keeps every value.
    """
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass"):
        value = spark.conf.get(key, None)
        if value:
            session.conf.set(key, value)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def read_stream(
    spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def active_sessions(
    sessions: DataFrame, width: str = "5 minutes", lateness: str = "10 minutes"
) -> DataFrame:
    """Completed sessions per tumbling window, for a batch or a streaming frame.

    Append mode emits a window once the watermark has passed it and then drops its state, so
    it is the mode for unbounded input. Complete mode keeps one counter per window.
    """
    done = completed(sessions)
    if sessions.isStreaming:
        done = done.withColumn("start_time", F.col("start_time").cast("timestamp")).withWatermark(
            "start_time", lateness
        )
    return (
        done.groupBy(F.window("start_time", width))
        .agg(F.count(F.lit(1)).alias("active_sessions"))
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            F.col("window.end").cast("timestamp_ntz").alias("window_end"),
            "active_sessions",
        )
    )


def _started(writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    """Start: once over all that has arrived, or again and again at the interval `every`."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def refresh_windows(
    counts: DataFrame, target: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep all windows at `target`, read by `running_result`.

    Complete mode hands over every window after each batch, a few bytes per five minutes of
    history, and keeps a counter for each. `append_windows` is the mode for input without end.
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        _write_slot(batch, target, *_turn(batch.sparkSession, target, _query_id(batch), batch_id))

    return _started(counts.writeStream.outputMode("complete").foreachBatch(replace), checkpoint, every)


def append_windows(
    counts: DataFrame, target: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Add closed windows to the table at `target`, once each."""
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", target)
    return _started(writer, checkpoint, every)


#: run: number of the query among those that wrote to the target, in order of their first batch.
MARK = "run bigint, batch bigint, query string"


def _query_id(batch: DataFrame) -> str:
    """The id that the checkpoint of the running query carries."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _marks(spark: SparkSession, target: str) -> dict[int, tuple]:
    """Slot -> (run, batch, query); two small files at most."""
    try:
        rows = spark.read.schema(f"{MARK}, slot int").parquet(f"{target}/marks").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    return {row["slot"]: (row["run"], row["batch"], row["query"]) for row in rows}


def _turn(spark: SparkSession, target: str, query: str, batch_id: int) -> tuple[int, tuple]:
    """The slot for a batch, and its mark. The same again when a batch is run again."""
    marks = _marks(spark, target).values()
    runs = [run for run, _, by in marks if by == query]
    run = runs[0] if runs else max((run for run, _, _ in marks), default=0) + 1
    return batch_id % 2, (run, batch_id, query)


def _write_slot(rows: DataFrame, target: str, slot: int, mark: tuple) -> None:
    """Write a batch's result to its slot, and then its mark.

    Until the mark is there, readers go by the mark of the other slot.
    """
    rows.write.mode("overwrite").parquet(f"{target}/rows/slot={slot}")
    marks = rows.sparkSession.createDataFrame([mark], MARK).coalesce(1)
    marks.write.mode("overwrite").parquet(f"{target}/marks/slot={slot}")


def _advance(
    batch_id: int, target: str, query: str, change: DataFrame, merge: Callable[[DataFrame], DataFrame]
) -> None:
    """Merge a batch's rows into the running result.

    Batch k reads the slot of batch k-1 and overwrites the other, so running it again gives
    the same result, and storage stays at two copies however many batches there are.
    Readers of the other slot see all of it meanwhile.
    """
    spark, rows = change.sparkSession, change
    slot, mark = _turn(spark, target, query, batch_id)
    if batch_id > 0:
        before = spark.read.schema(change.schema).parquet(f"{target}/rows/slot={1 - slot}")
        rows = rows.unionByName(before)
    _write_slot(merge(rows), target, slot, mark)


def running_result(spark: SparkSession, target: str) -> DataFrame:
    """The result after the last finished batch of the query that wrote first most recently.

    Which slot that is, is a scalar over the marks, and only that slot is read.
    """
    marks = spark.read.schema(f"{MARK}, slot int").parquet(f"{target}/marks")
    last = marks.agg(F.max_by("slot", F.struct("run", "batch"))).scalar()
    return spark.read.parquet(f"{target}/rows").where(F.col("slot") == last).drop("slot")


def count_locations(sessions: DataFrame, players: DataFrame) -> DataFrame:
    """Completed sessions per city. A hot player is one row by the time of the join."""
    per_player = completed(sessions).groupBy("player_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_player.join(players.select("player_id", "city", "country"), "player_id")
        .groupBy("city", "country")
        .agg(F.sum("n").alias("active_sessions"))
    )


def refresh_location_counts(
    sessions: DataFrame, players: DataFrame, target: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep counts per city at `target`; they add up, so no state store is needed."""

    def total(rows: DataFrame) -> DataFrame:
        return rows.groupBy("city", "country").agg(F.sum("active_sessions").alias("active_sessions"))

    def add(batch: DataFrame, batch_id: int) -> None:
        _advance(batch_id, target, _query_id(batch), count_locations(batch, players), total)

    needed = completed(sessions).select("player_id", "status")
    return _started(needed.writeStream.foreachBatch(add), checkpoint, every)


def refresh_newest(
    sessions: DataFrame,
    players: DataFrame,
    target: str,
    checkpoint: str,
    n: int = 500,
    every: str | None = None,
) -> StreamingQuery:
    """Keep the newest n located sessions at `target`.

    Late sessions count as well: the newest n of all are among the newest n so far and those
    of the batch. The globe over these rows costs n rows instead of a scan of all sessions.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        newest = globe.latest_located(batch, players, n)
        _advance(batch_id, target, _query_id(batch), newest, lambda rows: globe.newest_of(rows, n))

    needed = completed(sessions).select(
        "session_id", "player_id", "start_time", "time_played_minutes", "status"
    )
    return _started(needed.writeStream.foreachBatch(keep), checkpoint, every)
