"""The empty-station alert over the whole history: when it went on and off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds of history that one task orders for one station.
BLOCK_SECONDS = 86400


def is_empty() -> Column:
    """The alert's condition: exactly no bikes. An unknown count is not empty."""
    return F.coalesce(F.col("num_bikes_available") == 0, F.lit(False))


def alert_edges(status: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Every change of a station's alert: station_id, grab_time, is_empty.

    Rows of a station follow each other by (grab_time, id), and the alert is off
    before the first of them; rows without a time or an id have no place. A station's rows are ordered within blocks of time,
    so that one with a long history is spread over tasks; what the blocks' ends
    tell is put together from two rows per block.
    """
    rows = status.filter("grab_time IS NOT NULL AND id IS NOT NULL").select(
        "station_id",
        "grab_time",
        "id",
        is_empty().alias("is_empty"),
        F.floor(F.col("grab_time") / block_seconds).alias("block"),
    )
    block = Window.partitionBy("station_id", "block").orderBy("grab_time", "id")
    marked = rows.select(
        "*",
        F.lag("is_empty").over(block).alias("before"),
        F.lead("is_empty").over(block).isNull().alias("last"),
    )
    first = F.col("before").isNull()
    changed = F.col("before") != F.col("is_empty")
    # Ends of blocks meet by station; a change inside a block stays where it is.
    ends = marked.filter(first | F.col("last") | changed).withColumn("at", F.when(~(first | F.col("last")), F.col("block")))
    order = Window.partitionBy("station_id", "at").orderBy("grab_time", "id")
    known = F.coalesce("before", F.lag("is_empty").over(order), F.lit(False))
    return ends.withColumn("known", known).filter("known != is_empty").select("station_id", "grab_time", "is_empty")
