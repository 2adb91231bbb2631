"""Incremental reads: each consumer sees every status row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridemetrics.operators.series import bike_series, dock_series
from ridemetrics.operators.stations import StationIds, only_stations
from ridemetrics.sources.tables import follow_status
from ridemetrics.streaming.ingest import paced


# How long a consumer remembers the rows it has read.
REMEMBERED = "1 day"


def each_once(rows: DataFrame, within: str = REMEMBERED) -> DataFrame:
    """A followed status table, each row (station_id, id) once.

    A load that failed after its write and ran again is read a second time by a
    consumer that came in between. Keys read stay in state for `within` after
    they came and no longer, so the state holds what came in that time. The time
    that counts is the consumer's own: however old a row is, it is never late.
    """
    return (
        rows.withColumn("_read_at", F.current_timestamp())
        .withWatermark("_read_at", within)
        .dropDuplicatesWithinWatermark(["station_id", "id"])
        .drop("_read_at")
    )


def new_points(
    spark: SparkSession,
    table: str,
    measure: str = "bikes",
    ids: StationIds | None = None,
    within: str | None = REMEMBERED,
) -> DataFrame:
    """Stream of chart points appended to the status table, each row once.

    `within=None` keeps no state; a load that ran again may then come twice.
    """
    series = {"bikes": bike_series, "docks": dock_series}[measure]
    rows = only_stations(follow_status(spark, table), ids)
    return series(rows if within is None else each_once(rows, within), ordered=False)


def deliver(points: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append to `path` what came since the last run under this checkpoint.

    The checkpoint is the consumer's cursor.
    """
    writer = (
        points.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return paced(writer, interval).start()
