"""Scans, saves, snapshots, time bounds, row counts and the default for an empty result."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from playlens.session import remove
from playlens.sources.schemas import DOMAIN

#: The table of finished saves below a folder of snapshots.
SAVES = "seq bigint, snapshot string"


def scan(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A domain table from `folder/name` in Parquet, with its declared schema."""
    return spark.read.schema(schema or DOMAIN[name]).parquet(f"{folder.rstrip('/')}/{name}")


def scan_catalog(spark: SparkSession, schema: str, name: str) -> DataFrame:
    """A table of a catalog schema; `schema` may carry a catalog name in front."""
    return spark.table(f"{schema}.{name}")


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make frames visible to `spark.sql` under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def with_zone(df: DataFrame) -> DataFrame:
    """Times without a zone as UTC instants, the stored form; needs a session in UTC."""
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone.upper() not in ("UTC", "ETC/UTC", "GMT", "ETC/GMT", "Z", "+00:00"):
        raise ValueError(f"the session must run in UTC, not in {zone}")
    zoned = {
        name: F.col(name).cast("timestamp") for name, kind in df.dtypes if kind == "timestamp_ntz"
    }
    return df.withColumns(zoned)


def save_tables(
    tables: dict[str, DataFrame], folder: str, cluster_by: dict[str, list[str]] | None = None
) -> dict[str, str]:
    """Overwrite one Parquet table per frame below `folder`; returns name -> path.

    `cluster_by` names columns to range-partition and sort a table by, so that row groups
    hold narrow ranges and a filter on them skips the rest: sessions by start_time, for one.
    End the list with a unique column to keep a frequent value from filling one file.
    """
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in tables}
    if not paths:
        return paths

    def save(name: str) -> None:
        df, columns = tables[name], (cluster_by or {}).get(name)
        if columns:
            df = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
        df.write.mode("overwrite").parquet(paths[name])

    # The tables do not depend on each other: their jobs share the cluster instead of queueing.
    with ThreadPoolExecutor(max_workers=len(tables)) as jobs:
        list(jobs.map(save, tables))
    return paths


def new_snapshot(folder: str) -> str:
    """A folder for the next save below `folder`; nobody reads it before it is published."""
    return f"{folder.rstrip('/')}/snapshot-{uuid.uuid4().hex}"


def publish(spark: SparkSession, folder: str, snapshot: str, keep: int = 2) -> None:
    """Make `snapshot` the current one of `folder`, and remove all but the last `keep`.

    One row appended to the small table of saves is what readers go by. So they see all tables of
    the save before or all of this one, and a save that fails changes nothing. Snapshots that a
    running job may still read have to be among the last `keep`. One writer at a time.
    """
    saves = _saves(spark, folder)
    seq = max([row["seq"] for row in saves], default=0) + 1
    row = spark.createDataFrame([(seq, snapshot.rstrip("/").rsplit("/", 1)[1])], SAVES)
    row.coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/saves")
    for old in sorted(saves, reverse=True)[max(0, keep - 1):]:
        remove(spark, f"{folder.rstrip('/')}/{old['snapshot']}")


def _saves(spark: SparkSession, folder: str) -> list:
    try:
        return spark.read.schema(SAVES).parquet(f"{folder.rstrip('/')}/saves").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def current(spark: SparkSession, folder: str) -> str:
    """The folder of the tables that were saved last; `scan` reads from it."""
    saves = _saves(spark, folder)
    if not saves:
        raise ValueError(f"nothing has been saved in {folder}")
    return f"{folder.rstrip('/')}/{max(saves)['snapshot']}"


def save_time_bounds(table: DataFrame, folder: str, time: str = "start_time", by: str = "status") -> str:
    """Save, per file of a stored `table` and value of `by`, the oldest time and the number of rows.

    A row per file and value, so it is small beside the table; `newest_since` reads it. The scan
    takes two columns. Rows without a time don't count.
    """
    path = f"{folder.rstrip('/')}/time_bounds"
    bounds = table.where(F.col(time).isNotNull()).groupBy(F.input_file_name().alias("file"), F.col(by).alias("value"))
    bounds.agg(F.min(time).alias("oldest"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return path


def newest_since(bounds: DataFrame, n: int, value: str = "completed") -> Column:
    """A time from which a table has at least n rows with `value`, as a scalar; null if it has fewer.

    The files with the newest beginnings are counted up; a file has one row at least, so n files
    are enough and no more than n are looked at in one task.
    """
    newest = bounds.where((F.col("value") == value) & (F.col("n") > 0)).orderBy(F.desc("oldest"), "file").limit(n)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("oldest"), "file")
    return newest.select("oldest", F.sum("n").over(order).alias("so_far")).where(F.col("so_far") >= n).agg(F.max("oldest")).scalar()


def save_catalog_tables(
    tables: dict[str, DataFrame],
    schema: str,
    bucket_by: dict[str, tuple[int, str]] | None = None,
) -> None:
    """Overwrite one managed table per frame in `schema`.

    `bucket_by` maps a table to (buckets, key). Players, sessions and transactions bucketed
    alike on player_id join without a shuffle.
    """
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format("parquet")
        if bucket_by and name in bucket_by:
            buckets, key = bucket_by[name]
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{schema}.{name}")


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, cnt) for all frames as one job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(name).alias("table_name"), "cnt")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def catalog_row_counts(spark: SparkSession, schema: str) -> DataFrame:
    """Row counts of every table of a catalog schema. Only table names reach the driver."""
    names = sorted(t.name for t in spark.catalog.listTables(schema) if not t.isTemporary)
    return table_row_counts({name: scan_catalog(spark, schema, name) for name in names})


def with_fallback(report: DataFrame, default: DataFrame) -> DataFrame:
    """`report`, or `default` when it has no row; decided inside the plan.

    Whether there is a row is a scalar subquery over the report, whose last exchange is
    computed once for both.
    """
    empty = report.agg(F.count(F.lit(1)) == 0).scalar()
    return report.unionByName(default.where(empty))
