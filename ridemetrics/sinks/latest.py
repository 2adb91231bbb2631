"""The newest row per station without a scan of all history.

A snapshot holds the newest rows and which loads of the status table they come
from. Newest rows of newest rows are newest rows, so a read takes the snapshot
and only the loads that came after it, and a refresh writes just that as the
next snapshot. A load that is folded in twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridemetrics.operators.stations import latest_rows
from ridemetrics.schema import STATUS, STATUS_LOAD, STATUS_PARTITION
from ridemetrics.sources import generations
from ridemetrics.sources.tables import list_loads, read_loads

_LOADS = f"{STATUS_PARTITION} date, {STATUS_LOAD} string"


def _newest_rows(spark: SparkSession, table: str, snapshot: str | None) -> tuple[DataFrame, DataFrame]:
    """Newest rows as of now, and all loads of the table."""
    loads = list_loads(spark, table)
    if snapshot is None:
        return latest_rows(read_loads(spark, table)), loads
    folded = spark.read.schema(_LOADS).parquet(f"{snapshot}/loads")
    # One row per load since the snapshot: as many as polls came in between.
    fresh = loads.join(folded, [STATUS_PARTITION, STATUS_LOAD], "left_anti").collect()
    rows = spark.read.schema(STATUS).parquet(f"{snapshot}/rows")
    if fresh:
        rows = latest_rows(rows.unionByName(read_loads(spark, table, [tuple(row) for row in fresh])))
    return rows, loads


def latest_so_far(spark: SparkSession, table: str, root: str) -> DataFrame:
    """The newest row of each station: the snapshot at `root` and the loads after it.

    Equal to `latest_rows` over the whole table, which is read where there is no
    snapshot yet. Days without a new load are not opened.
    """
    return _newest_rows(spark, table, generations.newest(spark, root))[0]


def refresh_latest(spark: SparkSession, table: str, root: str) -> DataFrame:
    """Fold the loads since the last snapshot into a new one, and read it.

    A refresh that fails leaves the last snapshot in use. Loads that are gone,
    because their day was compacted, are forgotten; the compacted load counts as
    new once.
    """
    rows, loads = _newest_rows(spark, table, generations.newest(spark, root))
    folder = generations.begin(spark, root)
    # Loads are listed before rows are read: one that lands in between is read again.
    loads.write.mode("overwrite").parquet(f"{folder}/loads")
    rows.select(*[column.split()[0] for column in STATUS.split(", ")]).write.mode("overwrite").parquet(f"{folder}/rows")
    generations.finish(spark, folder)
    return spark.read.schema(STATUS).parquet(f"{folder}/rows")
