"""Stored station and status tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridemetrics.schema import COMPACTED, STATUS, STATUS_LOAD, STATUS_PARTITION

# A file stream skips files much older than the newest one seen. This is long
# enough that none is ever skipped, whatever its time.
ANY_AGE = "36500d"

_SCHEMA = f"{STATUS}, {STATUS_PARTITION} date, {STATUS_LOAD} string"


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Status rows of all loads; files from before a column existed give NULL for it.

    The day stays as a column, so that reads since a moment skip older days.
    """
    return spark.read.schema(_SCHEMA).parquet(path).drop(STATUS_LOAD)


def list_loads(spark: SparkSession, path: str) -> DataFrame:
    """Day and name of every load of the status table. The listing reads no content."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select(F.col(STATUS_PARTITION).cast("date"), F.col(STATUS_LOAD).cast("string")).distinct()


def read_loads(spark: SparkSession, path: str, loads: list[tuple] | None = None) -> DataFrame:
    """Status rows of some loads, (day, name) each, or of all.

    Days and names become partition filters; a load of several days that is asked
    for by one of them may come with rows of another.
    """
    rows = spark.read.schema(_SCHEMA).parquet(path)
    if loads is not None:
        days, names = (sorted(set(values)) for values in zip(*loads))
        rows = rows.filter(F.col(STATUS_PARTITION).isin(days) & F.col(STATUS_LOAD).isin(names))
    return rows.drop(STATUS_PARTITION, STATUS_LOAD)


def follow_status(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The status table as a stream of appended rows, streamed or batch-written.

    Compacted files hold rows that came before and are passed over, so compact a
    day when its followers have read it. A micro-batch that failed after its
    write and ran again comes twice to a follower that read in between; see
    `streaming.follow.each_once`.
    """
    reader = spark.readStream.schema(_SCHEMA).option("maxFileAge", ANY_AGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).filter(~F.col(STATUS_LOAD).startswith(COMPACTED)).drop(STATUS_PARTITION, STATUS_LOAD)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
