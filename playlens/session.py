"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # AQE sizes the reduce side, splits skewed join partitions by map output and turns a
    # sort-merge join into a broadcast one only after it has measured the side.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The default, INT96, carries no statistics, so no row group could be skipped by time.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Recording a Python call site per expression makes plans slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # State of unbounded streams stays off the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(
    app_name: str = "playlens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the library's defaults.

    `shuffle_partitions` is the upper limit that AQE coalesces from: a few thousand on a
    cluster, the core count on a laptop.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession, purpose: str) -> str:
    """A new path for `purpose` below the cluster's shared folder.

    The folder is the one named in `spark.checkpoint.dir`. Only a session that runs in one
    process (master `local[...]`) may go without: there a temporary folder is as good as a
    shared one. On a cluster the setting is required, because every executor would
    write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder when the master is {master!r}")
        root = tempfile.mkdtemp(prefix="playlens-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder that this library wrote, in whatever store it lies; False if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
