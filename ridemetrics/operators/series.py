"""Chart series: one measure of the status rows over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemetrics.functions.expressions import to_millis, utc_day
from ridemetrics.operators.stations import StationIds, later_than, only_stations
from ridemetrics.schema import STATUS_PARTITION


def after_cursor(status: DataFrame, since: int | DataFrame | None, known_only: bool = False) -> DataFrame:
    """Rows strictly later than the consumer's last seen time.

    `since` is one time for all stations, or a relation of station_id and
    last_time. A cursor that is absent or not positive keeps everything. With a
    column consumer_id in the relation, each consumer gets its own rows and the
    column stays. A station must come once, or once per consumer: a check here
    would put an aggregation under the join, and hot stations could no longer
    be split there.

    `known_only` keeps stations with a positive cursor only. Then no row is older
    than the least cursor, so a stored table skips the days before it.
    """
    if not isinstance(since, DataFrame):
        return later_than(status, since)
    keys = ["station_id", *[c for c in ("consumer_id",) if c in since.columns]]
    cursors = since.select(*keys, "last_time")
    if known_only:
        cursors = cursors.filter(F.col("last_time") > 0)
        if STATUS_PARTITION in status.columns:
            least = since.filter(F.col("last_time") > 0).agg(utc_day(F.min("last_time"))).scalar()
            status = status.filter(F.col(STATUS_PARTITION) >= least)
    last_seen = F.coalesce(F.col("last_time"), F.lit(0))
    return (
        status.join(cursors, "station_id", "inner" if known_only else "left")
        .filter((last_seen <= 0) | (F.col("grab_time") > last_seen))
        .drop("last_time")
    )


def _series(status, measure, ids, since, ordered, known_only) -> DataFrame:
    rows = after_cursor(only_stations(status, ids), since, known_only)
    consumer = [c for c in ("consumer_id",) if isinstance(since, DataFrame) and c in since.columns]
    rows = rows.select(*consumer, "station_id", "grab_time", measure)
    if ordered:
        # Ordering on time as well as station spreads a hot station over
        # several range partitions. The measure settles equal times without
        # reading the wide row id.
        rows = rows.orderBy("station_id", "grab_time", measure)
    return rows.select(*consumer, "station_id", to_millis("grab_time").alias("ts_ms"), F.col(measure).alias("value"))


def bike_series(
    status: DataFrame,
    ids: StationIds | None = None,
    since: int | DataFrame | None = None,
    ordered: bool = True,
    known_only: bool = False,
) -> DataFrame:
    return _series(status, "num_bikes_available", ids, since, ordered, known_only)


def dock_series(
    status: DataFrame,
    ids: StationIds | None = None,
    since: int | DataFrame | None = None,
    ordered: bool = True,
    known_only: bool = False,
) -> DataFrame:
    return _series(status, "num_docks_available", ids, since, ordered, known_only)
