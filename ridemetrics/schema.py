"""Column names and types shared by the readers, operators and sinks."""

from __future__ import annotations

# Canonical ride columns and the header names accepted for each,
# in order of preference.
RIDE_ALIASES = {
    "ride_id": ["ride_id"],
    "rideable_type": ["rideable_type"],
    "started_at": ["started_at", "start_time", "start_at"],
    "ended_at": ["ended_at", "end_time", "end_at"],
    "start_station_name": ["start_station_name", "from_station_name"],
    "start_station_id": ["start_station_id", "from_station_id"],
    "end_station_name": ["end_station_name", "to_station_name"],
    "end_station_id": ["end_station_id", "to_station_id"],
    "start_lat": ["start_lat", "start_latitude"],
    "start_lng": ["start_lng", "start_longitude"],
    "end_lat": ["end_lat", "end_latitude"],
    "end_lng": ["end_lng", "end_longitude"],
    "member_casual": ["member_casual", "member_or_casual_ride"],
}

# Columns without which rides cannot be analysed.
RIDE_REQUIRED = ["ride_id", "started_at", "ended_at"]

RIDE_COORDINATES = ["start_lat", "start_lng", "end_lat", "end_lng"]

# The report tables, in publishing order, with their columns.
REPORT_COLUMNS = {
    "overview": "total_rides long, distinct_ride_ids long, first_ride_start timestamp, last_ride_end timestamp",
    "duration_stats": "avg_duration_min double, median_duration_min double, max_duration_min double",
    "rides_by_member_type": "member_casual string, rides long",
    "rides_by_rideable_type": "rideable_type string, rides long",
    "top_start_stations": "start_station_name string, rides_started long",
    "top_end_stations": "end_station_name string, rides_ended long",
    "hourly_distribution": "hour_of_day int, rides long",
    "data_quality": (
        "missing_start_station_name long, missing_end_station_name long, "
        "missing_start_coords long, missing_end_coords long"
    ),
}

# Columns of the station and status tables.
STATION = "station_id string, name string, lat double, lon double, capacity int"

# `id` grows with insertion order. Decimal because streamed rows build it from
# arrival time, poll and position (see sources.feeds).
STATUS = (
    "id decimal(38,0), station_id string, num_bikes_available int, "
    "num_docks_available int, grab_time long, is_installed int, is_renting int, "
    "is_returning int, num_bikes_disabled int, num_docks_disabled int"
)

# Stored status is partitioned by the UTC day of grab_time.
STATUS_PARTITION = "grab_date"

# Below a day, one folder per load: a micro-batch, a batch write, a compaction.
# Rows of one load are replaced together, never those of another.
STATUS_LOAD = "load"
COMPACTED = "compact-"

# Columns that status tables written by older versions lack.
STATUS_ADDED = {
    "is_installed": "int",
    "is_renting": "int",
    "is_returning": "int",
    "num_bikes_disabled": "int",
    "num_docks_disabled": "int",
}

# The high-capacity stations followed by default.
TARGET_STATIONS = [
    "06439006-11b6-44f0-8545-c9d39035f32a",
    "9394fb49-583f-4426-8d2f-a2b0ffb584d2",
    "66dea7b5-0aca-11e7-82f6-3863bb44ef7c",
    "66de85d2-0aca-11e7-82f6-3863bb44ef7c",
    "66de25bd-0aca-11e7-82f6-3863bb44ef7c",
    "66dc2c78-0aca-11e7-82f6-3863bb44ef7c",
    "66dc292c-0aca-11e7-82f6-3863bb44ef7c",
    "66dd17a5-0aca-11e7-82f6-3863bb44ef7c",
    "bc5235a5-7f10-4a27-806e-9c25fa700959",
    "32cc1603-a4b5-4099-b7bf-681de451b04a",
]
