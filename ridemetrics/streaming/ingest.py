"""Continuous ingest of landed status polls into the status table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ridemetrics.functions.expressions import utc_day
from ridemetrics.schema import STATUS_PARTITION, TARGET_STATIONS
from ridemetrics.sinks.tables import write_load
from ridemetrics.sources import files
from ridemetrics.sources.feeds import decode_status, read_polls
from ridemetrics.sources.tables import ANY_AGE

# Fixed value: time between polls.
POLL_INTERVAL = "30 seconds"


def paced(writer: DataStreamWriter, interval: str | None) -> DataStreamWriter:
    """Run every `interval`, or once over what is there when it is None."""
    return writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)


def landed_polls(spark: SparkSession, landing: str, max_files: int | None = None, archive: str | None = None) -> DataFrame:
    """Stream of landed documents. With `archive`, finished files move there so
    that the landing folder stays quick to list."""
    reader = spark.readStream.option("maxFileAge", ANY_AGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return read_polls(reader, landing)


def load_writer(spark: SparkSession, table: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each micro-batch as a load of the table.

    The load is named after the checkpoint and the batch, so a batch that runs
    again, because it stopped between its write and the commit, replaces itself.
    """
    stream = hashlib.sha256(files.qualified(spark, checkpoint).encode()).hexdigest()[:16]

    def append(rows: DataFrame, batch_id: int) -> None:
        dated = rows.withColumn(STATUS_PARTITION, utc_day(F.col("grab_time")))
        write_load(dated, table, f"stream-{stream}-{batch_id}")

    return append


def append_status(status: DataFrame, table: str, checkpoint: str, interval: str | None = POLL_INTERVAL) -> StreamingQuery:
    """Append a status stream to the date-partitioned table, exactly once.

    The table stays a plain one that batch writes may append to, see load_writer.
    """
    append = load_writer(status.sparkSession, table, checkpoint)
    writer = status.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)
    return paced(writer, interval).start()


def ingest_status(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    targets: Sequence[str] | None = TARGET_STATIONS,
    interval: str | None = POLL_INTERVAL,
    on_bad: str = "drop_poll",
    max_files: int | None = None,
    archive: str | None = None,
) -> StreamingQuery:
    polls = landed_polls(spark, landing, max_files, archive)
    return append_status(decode_status(polls, targets, on_bad), table, checkpoint, interval)
