"""Parquet sinks for rides, stations and status."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridemetrics.functions.expressions import utc_day
from ridemetrics.operators.maintenance import needs_loading, upsert
from ridemetrics.schema import COMPACTED, STATUS_LOAD, STATUS_PARTITION
from ridemetrics.sources import files
from ridemetrics.sources.tables import read_stations, read_status

# What the reports read; other ride columns stay in the source files.
RIDE_COLUMNS = [
    "ride_id",
    "rideable_type",
    "member_casual",
    "started_ts",
    "ended_ts",
    "ride_duration_minutes",
    "start_station_name",
    "end_station_name",
    "start_lat",
    "start_lng",
    "end_lat",
    "end_lng",
]


def store_rides(rides: DataFrame, path: str) -> DataFrame:
    """Write derived rides once as Parquet and read them back.

    A report over the stored rides scans only the columns it names, instead of
    parsing all text again.
    """
    rides.select(*[c for c in RIDE_COLUMNS if c in rides.columns]).write.mode("overwrite").parquet(path)
    return rides.sparkSession.read.parquet(path)


def _ranged(status: DataFrame) -> DataFrame:
    """Ranges over date, station and time keep files even when one station holds
    much of a day, and let row-group statistics skip other stations."""
    return status.repartitionByRange(STATUS_PARTITION, "station_id", "grab_time").sortWithinPartitions(
        STATUS_PARTITION, "station_id", "grab_time"
    )


def store_status(status: DataFrame, path: str, mode: str = "append", load: str | None = None) -> None:
    """Write status rows by date, sorted so that one station's rows sit together.

    With a `load` name, appending the same load again replaces it.
    """
    dated = _ranged(status.withColumn(STATUS_PARTITION, utc_day(F.col("grab_time"))))
    write_load(dated, path, load or f"batch-{uuid.uuid4().hex}", mode)


def write_load(dated: DataFrame, path: str, load: str, mode: str = "append") -> None:
    """Write rows that have their day as one load of the status table.

    Appending replaces the folders of this load only, so a load may be written
    again; streams and batches may take turns in any order.
    """
    writer = dated.withColumn(STATUS_LOAD, F.lit(load)).write.partitionBy(STATUS_PARTITION, STATUS_LOAD)
    if mode == "append":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode(mode).option("partitionOverwriteMode", "static").parquet(path)


def compact_status(spark: SparkSession, path: str, day: str) -> None:
    """Make one load of ranged files of all loads of a day (yyyy-mm-dd).

    The new files are written out of sight, then take the place of the old ones
    folder by folder; no reader or writer of that day should run meanwhile. A
    run that failed is finished by the next one.
    """
    folder = f"{path.rstrip('/')}/{STATUS_PARTITION}={day}"
    hidden = f"{folder}/_compacting"
    done = f"{hidden}/_FINISHED"
    if not files.exists(spark, done):
        if not files.child_folders(spark, folder):
            return
        rows = read_status(spark, path).filter(F.col(STATUS_PARTITION) == F.lit(day).cast("date"))
        _ranged(rows).drop(STATUS_PARTITION).write.mode("overwrite").parquet(f"{hidden}/rows")
        files.touch(spark, done)
    for name in files.child_folders(spark, folder):
        if name.startswith(f"{STATUS_LOAD}="):
            files.delete(spark, f"{folder}/{name}")
    if files.exists(spark, f"{hidden}/rows"):
        files.rename(spark, f"{hidden}/rows", f"{folder}/{STATUS_LOAD}={COMPACTED}{uuid.uuid4().hex}")
    files.delete(spark, hidden)


def upsert_stations(
    spark: SparkSession, old_path: str | None, incoming: DataFrame, new_path: str, order: str = "feed_order"
) -> DataFrame:
    """Write the stored stations with `incoming` merged in to a new path."""
    if old_path == new_path:
        raise ValueError("Stations must be rewritten to a new path, not over their source")
    if old_path is None:
        stored = incoming.drop(order).limit(0)
    else:
        stored = read_stations(spark, old_path)
    upsert(stored, incoming, order=order).write.mode("overwrite").parquet(new_path)
    return read_stations(spark, new_path)


def load_stations_once(
    spark: SparkSession, old_path: str | None, incoming: DataFrame, new_path: str, wanted: int
) -> DataFrame:
    """First load: merge `incoming` only while fewer than `wanted` are stored."""
    if old_path is not None:
        stored = read_stations(spark, old_path)
        if not needs_loading(stored, wanted):
            return stored
    return upsert_stations(spark, old_path, incoming, new_path)
