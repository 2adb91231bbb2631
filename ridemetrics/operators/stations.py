"""Operators over the station dimension and the status time series."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemetrics.functions.expressions import (
    NOT_AVAILABLE,
    as_flag,
    coordinate_text,
    local_time,
    or_not_available,
    to_millis,
    utc_day,
)
from ridemetrics.schema import STATUS_ADDED, STATUS_PARTITION

# Station ids asked for: one id, a short list, or a relation with a station_id
# column. Ids and lists become literals and reach the Parquet scan as filters.
StationIds = str | int | Sequence | DataFrame


def _as_list(ids) -> list:
    return [ids] if isinstance(ids, (str, int)) else list(ids)


def only_stations(rows: DataFrame, ids: StationIds | None) -> DataFrame:
    """Rows of the stations asked for; all rows when `ids` is None.

    A relation is semi-joined without a hint: Catalyst broadcasts it when its
    size allows and otherwise shuffles, with adaptive skew splitting for a
    station that holds much of the fact table.
    """
    if ids is None:
        return rows
    if isinstance(ids, DataFrame):
        return rows.join(ids.select("station_id"), "station_id", "left_semi")
    return rows.filter(F.col("station_id").isin(_as_list(ids)))


def later_than(rows: DataFrame, since: int | None) -> DataFrame:
    """Rows strictly later than `since`; all rows when it is None or not positive.

    On the stored status table the days before `since` are not read at all.
    """
    if since is None or since <= 0:
        return rows
    if STATUS_PARTITION in rows.columns:
        rows = rows.filter(F.col(STATUS_PARTITION) >= utc_day(F.lit(since)))
    return rows.filter(F.col("grab_time") > since)


def target_status(status: DataFrame, targets: StationIds) -> DataFrame:
    """Status of target stations, with counters that are absent set to zero."""
    defaulted = [c for c in STATUS_ADDED if c in status.columns]
    return only_stations(status, targets).withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in defaulted}
    )


def latest_rows(rows: DataFrame, recency: str = "id", key: str = "station_id") -> DataFrame:
    """The whole newest row of each key, newest by `recency`.

    `recency` must not repeat within a key: of two rows that share it, columns
    could come from either. Ids are unique unless the same rows are stored twice,
    and then the two rows are equal.

    One aggregation and one scan. Taking column by column instead of packing a
    struct keeps fixed-width columns in a hash aggregation that combines on
    the map side; a struct buffer would sort all rows first.
    """
    carried = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(*[F.max_by(c, recency).alias(c) for c in carried])


_STATION_FIELDS = ["station_id", "name", "lat", "lon", "capacity"]


def _status_fields() -> list:
    return [
        as_flag("is_installed").alias("is_installed"),
        as_flag("is_renting").alias("is_renting"),
        as_flag("is_returning").alias("is_returning"),
        F.col("num_bikes_available"),
        F.col("num_docks_available"),
        F.col("num_bikes_disabled").alias("num_vehicles_disabled"),
        F.col("num_bikes_disabled"),
        F.col("num_docks_disabled"),
        F.col("grab_time").alias("latest_grab_time"),
        to_millis("grab_time").alias("latest_grab_time_ms"),
    ]


def latest_status(stations: DataFrame, status: DataFrame, ordered: bool = True) -> DataFrame:
    """Every station with its newest status; NULL fields where it has none."""
    joined = stations.join(latest_rows(status), "station_id", "left").select(
        *_STATION_FIELDS, *_status_fields()
    )
    return joined.orderBy("name", "station_id") if ordered else joined


def _requested(ids: StationIds, stations: DataFrame) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select("station_id").distinct()
    key_type = stations.schema["station_id"].dataType.simpleString()
    rows = [(i,) for i in dict.fromkeys(_as_list(ids))]
    return stations.sparkSession.createDataFrame(rows, f"station_id {key_type}")


def _with_latest(ids: StationIds, stations: DataFrame, status: DataFrame) -> DataFrame:
    # Literal ids cut the fact scan first. For a relation the fact is brought
    # down to one row per station before any join, so it is never shuffled whole.
    literal = None if isinstance(ids, DataFrame) else ids
    return (
        _requested(ids, stations)
        .join(
            only_stations(stations, literal).withColumn("found", F.lit(True)),
            "station_id",
            "left",
        )
        .join(latest_rows(only_stations(status, literal)), "station_id", "left")
    )


def station_latest(ids: StationIds, stations: DataFrame, status: DataFrame) -> DataFrame:
    """Static fields and newest status per id; `found` is false for unknown ids."""
    return (
        _with_latest(ids, stations, status)
        .withColumn("found", F.coalesce("found", F.lit(False)))
        .select(*_STATION_FIELDS, *_status_fields(), "found")
        .drop("num_bikes_disabled")
    )


def latest_or_raise(station_id: str | int, stations: DataFrame, status: DataFrame) -> DataFrame:
    """`station_latest` for one id, or LookupError when the station is unknown."""
    if only_stations(stations, station_id).isEmpty():
        raise LookupError(f"Station not found: {station_id}")
    return station_latest(station_id, stations, status).drop("found")


def status_history(
    status: DataFrame,
    ids: StationIds | None = None,
    since: int | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Raw status rows, oldest first within each station."""
    rows = later_than(only_stations(status, ids), since).select(
        "id",
        "station_id",
        "num_bikes_available",
        "num_docks_available",
        "grab_time",
        to_millis("grab_time").alias("grab_time_ms"),
        local_time("grab_time").alias("local_time"),
    )
    return rows.orderBy("station_id", "grab_time", "id") if ordered else rows


class StationDetail(NamedTuple):
    card: DataFrame
    history: DataFrame


def station_detail(ids: StationIds, stations: DataFrame, status: DataFrame) -> StationDetail:
    """Header with newest status, plus history. An unknown id labels itself."""
    card = _with_latest(ids, stations, status).select(
        "station_id",
        F.coalesce(F.col("name"), F.col("station_id").cast("string")).alias("station_name"),
        F.col("lat").alias("station_lat"),
        F.col("lon").alias("station_lon"),
        F.col("capacity").alias("station_capacity"),
        *_status_fields(),
    )
    return StationDetail(
        card.drop("num_bikes_disabled", "latest_grab_time_ms"), status_history(status, ids)
    )


def station_card(latest: DataFrame) -> DataFrame:
    """`latest_status` or `station_latest` rows as display text."""
    shown = [
        "capacity",
        "is_installed",
        "is_renting",
        "is_returning",
        "num_bikes_available",
        "num_docks_available",
        "num_vehicles_disabled",
        "num_docks_disabled",
    ]
    # A zero epoch is shown like a missing one.
    updated = F.when(F.col("latest_grab_time") != 0, local_time("latest_grab_time"))
    return latest.select(
        "station_id",
        "name",
        coordinate_text("lat").alias("lat"),
        coordinate_text("lon").alias("lon"),
        *[or_not_available(F.col(c)).alias(c) for c in shown],
        F.coalesce(updated, F.lit(NOT_AVAILABLE)).alias("latest_update"),
    )


def empty_stations(status: DataFrame) -> DataFrame:
    """Stations whose newest bike count is exactly zero."""
    newest = latest_rows(status.select("id", "station_id", "grab_time", "num_bikes_available"))
    return newest.filter(F.col("num_bikes_available") == 0).select(
        "station_id", "num_bikes_available", F.col("grab_time").alias("latest_grab_time")
    )


def poll_counts(status: DataFrame) -> DataFrame:
    """Rows accepted per poll."""
    return status.groupBy("grab_time").agg(F.count("*").alias("accepted_rows"))


def history_counts(status: DataFrame, ids: StationIds | None = None) -> DataFrame:
    """History rows per station."""
    return only_stations(status, ids).groupBy("station_id").agg(F.count("*").alias("history_rows"))


def station_count(stations: DataFrame) -> DataFrame:
    return stations.agg(F.count("*").alias("stations"))
