"""Every operator as a named query over the test tables, with its SQL twin.

All queries run over whole tables. `ORACLE` holds the same question in DuckDB
SQL; column names and values agree, row order does not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridemetrics.operators import maintenance, reports, series, stations
from ridemetrics.operators.rides import valid_rides
from ridemetrics.plans import bridge, stored, streamed
from ridemetrics.plans.bridge import table

# Start of the incremental reads: 2024-01-15 00:00:00 UTC.
SINCE = 1705276800

# Stations holding at least this many bikes are the targets.
TARGET_CAPACITY = 35


def rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.rides_from_events(table(spark, sf_dir, "events"))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.status_from_events(table(spark, sf_dir, "events"))


def station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.stations_from_customers(table(spark, sf_dir, "customer"))


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.requested_from_parts(table(spark, sf_dir, "part"))


def _report(build: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: build(rides(spark, sf_dir))


def _status_query(build: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: build(status(spark, sf_dir))


def ride_durations(spark, sf_dir):
    return rides(spark, sf_dir).select("ride_id", "started_ts", "ended_ts", "ride_duration_minutes")


def valid_ride_rows(spark, sf_dir):
    return valid_rides(rides(spark, sf_dir)).select("ride_id", "ride_duration_minutes")


def latest_status(spark, sf_dir):
    return stations.latest_status(station(spark, sf_dir), status(spark, sf_dir))


def station_latest(spark, sf_dir):
    return stations.station_latest(
        requested(spark, sf_dir), station(spark, sf_dir), status(spark, sf_dir)
    )


def _detail(spark, sf_dir):
    return stations.station_detail(
        requested(spark, sf_dir), station(spark, sf_dir), status(spark, sf_dir)
    )


def station_card(spark, sf_dir):
    return stations.station_card(latest_status(spark, sf_dir))


def target_status(spark, sf_dir):
    targets = station(spark, sf_dir).filter(F.col("capacity") >= TARGET_CAPACITY)
    return stations.target_status(status(spark, sf_dir), targets)


def bike_series_after_cursors(spark, sf_dir):
    """Every station has its own consumer, who has seen it up to its own time."""
    cursors = bridge.cursors_from_customers(table(spark, sf_dir, "customer"))
    return series.bike_series(status(spark, sf_dir), since=cursors)


def station_upsert(spark, sf_dir):
    updates = bridge.station_updates_from_orders(table(spark, sf_dir, "orders"))
    return maintenance.upsert(station(spark, sf_dir), updates, order="seq")


def status_migrate(spark, sf_dir):
    rows = status(spark, sf_dir)
    older = rows.select("id", "station_id", "num_bikes_available", "num_docks_available", "grab_time")
    return maintenance.union_status(older, rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "overview": _report(reports.overview),
    "duration_stats": _report(reports.duration_stats),
    "rides_by_member_type": _report(reports.rides_by_member_type),
    "rides_by_rideable_type": _report(reports.rides_by_rideable_type),
    "top_start_stations": _report(reports.top_start_stations),
    "top_end_stations": _report(reports.top_end_stations),
    "hourly_distribution": _report(reports.hourly_distribution),
    "data_quality": _report(reports.data_quality),
    "ride_durations": ride_durations,
    "valid_rides": valid_ride_rows,
    "latest_status": latest_status,
    "station_latest": station_latest,
    "station_detail": lambda spark, sf_dir: _detail(spark, sf_dir).card,
    "station_detail_history": lambda spark, sf_dir: _detail(spark, sf_dir).history,
    "station_card": station_card,
    "bike_series": _status_query(series.bike_series),
    "bike_series_since": _status_query(lambda df: series.bike_series(df, since=SINCE)),
    "bike_series_after_cursors": bike_series_after_cursors,
    "dock_series": _status_query(series.dock_series),
    "dock_series_since": _status_query(lambda df: series.dock_series(df, since=SINCE)),
    "status_history": _status_query(stations.status_history),
    "empty_stations": _status_query(stations.empty_stations),
    "target_status": target_status,
    "poll_counts": _status_query(stations.poll_counts),
    "history_counts": _status_query(stations.history_counts),
    "station_count": lambda spark, sf_dir: stations.station_count(station(spark, sf_dir)),
    "station_upsert": station_upsert,
    "status_migrate": status_migrate,
    "stream_status": stored.stream_status,
    "stream_latest_status": stored.stream_latest_status,
    "stream_new_points": stored.stream_new_points,
    "csv_rides": stored.csv_rides,
    "published_counts": stored.published_counts,
    "status_mixed_writes": stored.status_mixed_writes,
    "csv_mixed_layouts": stored.csv_mixed_layouts,
    "feed_status": stored.feed_status,
    "feed_refused": stored.feed_refused,
    "feed_stations": stored.feed_stations,
    "first_load": stored.first_load,
    "published_reports": stored.published_reports,
    "published_fallback": stored.published_fallback,
    "reports_minimal": stored.reports_minimal,
    "cursor_series": stored.cursor_series,
    "published_corrupt": stored.published_corrupt,
    "published_whole": stored.published_whole,
    "station_alerts": streamed.station_alerts,
    "stream_station_alerts": streamed.stream_station_alerts,
    "stream_points_once": streamed.stream_points_once,
    "latest_incremental": streamed.latest_incremental,
    "live_state": streamed.live_state,
    "ingest_restarted": streamed.ingest_restarted,
    "feed_stamps": streamed.feed_stamps,
}

_RIDES = """
rides AS (
  SELECT r.*, (floor(epoch(ended_ts)) - floor(epoch(started_ts))) / 60.0::double AS ride_duration_minutes
  FROM (
    SELECT event_id AS ride_id, event_type AS rideable_type, ts AS started_ts,
           ts + to_seconds(cast(floor((value - 5) * 60) AS bigint)) AS ended_ts,
           CASE WHEN event_id % 6 = 0 THEN 'casual' ELSE 'member' END AS member_casual,
           CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 10 = 1 THEN ''
                ELSE 'station_' || (user_id % 50) END AS start_station_name,
           CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ''
                ELSE 'station_' || (event_id % 50) END AS end_station_name,
           CASE WHEN user_id % 10 = 0 THEN NULL ELSE 40.5::double + (user_id % 100) / 1000.0::double END AS start_lat,
           CASE WHEN user_id % 7 = 0 THEN NULL ELSE -73.9::double - (user_id % 100) / 1000.0::double END AS start_lng,
           CASE WHEN event_id % 11 = 0 THEN NULL ELSE 40.5::double END AS end_lat,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE -73.9::double END AS end_lng
    FROM events
  ) r
)
"""

_STATUS = """
status AS (
  SELECT id, station_id, cast(k % 20 AS int) AS num_bikes_available,
         cast(20 - k % 20 AS int) AS num_docks_available, grab_time,
         1 AS is_installed,
         CASE WHEN k = 0 THEN NULL ELSE cast(k % 2 AS int) END AS is_renting,
         CASE WHEN k = 0 THEN NULL ELSE cast(k % 2 AS int) END AS is_returning,
         cast(k % 3 AS int) AS num_bikes_disabled, cast(k % 4 AS int) AS num_docks_disabled
  FROM (
    SELECT event_id AS id, user_id AS station_id,
           cast(floor(epoch(ts)) AS bigint) AS grab_time,
           cast(json_extract_string(props, '$.k') AS int) AS k
    FROM events
  )
)
"""

_STATION = """
station AS (
  SELECT c_custkey AS station_id, c_name AS name,
         CASE WHEN c_custkey % 100 = 0 THEN NULL ELSE 40.5::double + c_custkey / 100000.0::double END AS lat,
         -73.9::double - c_custkey / 100000.0::double AS lon,
         cast(20 + c_nationkey AS int) AS capacity
  FROM customer
)
"""

# The newest row per station: greatest id, then the row that carries it.
_LATEST = """
newest AS (SELECT station_id, max(id) AS id FROM status GROUP BY station_id),
latest AS (SELECT s.* FROM status s JOIN newest n ON s.id = n.id)
"""

_LATEST_FIELDS = """
  l.is_installed <> 0 AS is_installed, l.is_renting <> 0 AS is_renting,
  l.is_returning <> 0 AS is_returning, l.num_bikes_available, l.num_docks_available,
  l.num_bikes_disabled AS num_vehicles_disabled, l.num_docks_disabled,
  l.grab_time AS latest_grab_time
"""

_LATEST_STATUS = f"""
latest_status AS (
  SELECT s.station_id, s.name, s.lat, s.lon, s.capacity, {_LATEST_FIELDS},
         l.num_bikes_disabled, l.grab_time * 1000 AS latest_grab_time_ms
  FROM station s LEFT JOIN latest l ON l.station_id = s.station_id
)
"""

_REQUESTED = "requested AS (SELECT DISTINCT p_partkey AS station_id FROM part)"

_HISTORY_FIELDS = """
  id, station_id, num_bikes_available, num_docks_available, grab_time,
  grab_time * 1000 AS grab_time_ms,
  strftime(make_timestamp(grab_time * 1000000), '%Y-%m-%d %H:%M:%S') AS local_time
"""


def _with(*parts: str, body: str) -> str:
    return "WITH " + ", ".join(part.strip() for part in parts) + " " + body.strip()


def _rides_sql(body: str) -> str:
    return _with(_RIDES, body=body)


def _status_sql(body: str) -> str:
    return _with(_STATUS, body=body)


def _top_sql(column: str, count: str) -> str:
    return _rides_sql(
        f"SELECT {column}, count(*) AS {count} FROM rides WHERE {column} IS NOT NULL AND {column} <> '' "
        f"GROUP BY {column} ORDER BY {count} DESC, {column} LIMIT 10"
    )


def _series_sql(measure: str, where: str = "") -> str:
    return _status_sql(
        f"SELECT station_id, grab_time * 1000 AS ts_ms, {measure} AS value FROM status {where}"
    )


def _text(column: str) -> str:
    return f"coalesce(cast({column} AS varchar), 'N/A') AS {column}"



def _unless_few(column: str, value: str | None = None) -> str:
    """A ride column that one of the three CSV layouts lacks."""
    return f"CASE WHEN ride_id % 3 <> 2 THEN {value or column} END AS {column}"


def _cells_sql(
    report: str, name: str, count: str, key: str | None = None, top: bool = False, named: bool = False
) -> str:
    """The cells of a counting report; `named` for the first of a union."""
    key = key or name
    where = f"WHERE {key} <> ''" if top else ""
    best = "ORDER BY n DESC, key LIMIT 10" if top else ""
    report_as, field_as, value_as = (" AS report", " AS field", " AS value") if named else ("", "", "")
    return (
        f"SELECT '{report}'{report_as}, unnest(['{name}', '{count}']){field_as}, "
        f"unnest([cast(key AS varchar), cast(n AS varchar)]){value_as} "
        f"FROM (SELECT {key} AS key, count(*) AS n FROM rides {where} GROUP BY 1 {best})"
    )


_ALERTS = _status_sql(
    """
    SELECT station_id, grab_time, is_empty FROM (
        SELECT station_id, grab_time, is_empty,
               lag(is_empty, 1, false) OVER (PARTITION BY station_id ORDER BY grab_time, id) AS before
        FROM (SELECT *, num_bikes_available = 0 AS is_empty FROM status)
    ) WHERE is_empty <> before
    """
)

_FED = _with(
    _STATUS,
    "k_of AS (SELECT event_id AS id, cast(json_extract_string(props, '$.k') AS int) AS k FROM events)",
    body="""
    SELECT station_id, CASE WHEN k % 7 <> 0 THEN num_bikes_available END AS num_bikes_available,
           num_docks_available, CASE WHEN k = 0 THEN 0 ELSE is_installed END AS is_installed,
           coalesce(is_renting, 0) AS is_renting, coalesce(is_returning, 0) AS is_returning,
           num_bikes_disabled, num_docks_disabled
    FROM status JOIN k_of USING (id) WHERE grab_time // 86400 % 5 <> 0
    """,
)

ORACLE: dict[str, str] = {
    "overview": _rides_sql(
        "SELECT count(*) AS total_rides, count(DISTINCT ride_id) AS distinct_ride_ids, "
        "min(started_ts) AS first_ride_start, max(ended_ts) AS last_ride_end FROM rides"
    ),
    "duration_stats": _rides_sql(
        "SELECT round(avg(ride_duration_minutes), 2) AS avg_duration_min, "
        "round(quantile_disc(ride_duration_minutes, 0.5), 2) AS median_duration_min, "
        "round(max(ride_duration_minutes), 2) AS max_duration_min "
        "FROM rides WHERE ride_duration_minutes >= 0"
    ),
    "rides_by_member_type": _rides_sql(
        "SELECT member_casual, count(*) AS rides FROM rides GROUP BY member_casual"
    ),
    "rides_by_rideable_type": _rides_sql(
        "SELECT rideable_type, count(*) AS rides FROM rides GROUP BY rideable_type"
    ),
    "top_start_stations": _top_sql("start_station_name", "rides_started"),
    "top_end_stations": _top_sql("end_station_name", "rides_ended"),
    "hourly_distribution": _rides_sql(
        "SELECT cast(hour(started_ts) AS int) AS hour_of_day, count(*) AS rides FROM rides "
        "WHERE started_ts IS NOT NULL GROUP BY 1"
    ),
    "data_quality": _rides_sql(
        "SELECT cast(sum(CASE WHEN start_station_name IS NULL OR start_station_name = '' THEN 1 ELSE 0 END) AS bigint) "
        "AS missing_start_station_name, "
        "cast(sum(CASE WHEN end_station_name IS NULL OR end_station_name = '' THEN 1 ELSE 0 END) AS bigint) "
        "AS missing_end_station_name, "
        "cast(sum(CASE WHEN start_lat IS NULL OR start_lng IS NULL THEN 1 ELSE 0 END) AS bigint) AS missing_start_coords, "
        "cast(sum(CASE WHEN end_lat IS NULL OR end_lng IS NULL THEN 1 ELSE 0 END) AS bigint) AS missing_end_coords "
        "FROM rides"
    ),
    "ride_durations": _rides_sql(
        "SELECT ride_id, started_ts, ended_ts, ride_duration_minutes FROM rides"
    ),
    "valid_rides": _rides_sql(
        "SELECT ride_id, ride_duration_minutes FROM rides WHERE ride_duration_minutes >= 0"
    ),
    "latest_status": _with(_STATUS, _STATION, _LATEST, _LATEST_STATUS, body="SELECT * FROM latest_status"),
    "station_latest": _with(
        _STATUS,
        _STATION,
        _LATEST,
        _REQUESTED,
        body=f"""
        SELECT r.station_id, s.name, s.lat, s.lon, s.capacity, {_LATEST_FIELDS},
               l.grab_time * 1000 AS latest_grab_time_ms, s.station_id IS NOT NULL AS found
        FROM requested r LEFT JOIN station s ON s.station_id = r.station_id
        LEFT JOIN latest l ON l.station_id = r.station_id
        """,
    ),
    "station_detail": _with(
        _STATUS,
        _STATION,
        _LATEST,
        _REQUESTED,
        body=f"""
        SELECT r.station_id, coalesce(s.name, cast(r.station_id AS varchar)) AS station_name,
               s.lat AS station_lat, s.lon AS station_lon, s.capacity AS station_capacity, {_LATEST_FIELDS}
        FROM requested r LEFT JOIN station s ON s.station_id = r.station_id
        LEFT JOIN latest l ON l.station_id = r.station_id
        """,
    ),
    "station_detail_history": _with(
        _STATUS,
        _REQUESTED,
        body=f"SELECT {_HISTORY_FIELDS} FROM status WHERE station_id IN (SELECT station_id FROM requested)",
    ),
    "station_card": _with(
        _STATUS,
        _STATION,
        _LATEST,
        _LATEST_STATUS,
        body=f"""
        SELECT station_id, name, coalesce(printf('%.5f', lat), 'N/A') AS lat,
               coalesce(printf('%.5f', lon), 'N/A') AS lon, {_text('capacity')},
               {_text('is_installed')}, {_text('is_renting')}, {_text('is_returning')},
               {_text('num_bikes_available')}, {_text('num_docks_available')},
               {_text('num_vehicles_disabled')}, {_text('num_docks_disabled')},
               CASE WHEN latest_grab_time <> 0
                    THEN strftime(make_timestamp(latest_grab_time * 1000000), '%Y-%m-%d %H:%M:%S')
                    ELSE 'N/A' END AS latest_update
        FROM latest_status
        """,
    ),
    "bike_series": _series_sql("num_bikes_available"),
    "bike_series_since": _series_sql("num_bikes_available", f"WHERE grab_time > {SINCE}"),
    "bike_series_after_cursors": _with(
        _STATUS,
        "cursors AS (SELECT c_custkey AS station_id, 1704067200 + c_nationkey::bigint * 86400 AS last_time FROM customer)",
        body="SELECT s.station_id, s.grab_time * 1000 AS ts_ms, s.num_bikes_available AS value "
        "FROM status s LEFT JOIN cursors c ON c.station_id = s.station_id "
        "WHERE coalesce(c.last_time, 0) <= 0 OR s.grab_time > c.last_time",
    ),
    "dock_series": _series_sql("num_docks_available"),
    "dock_series_since": _series_sql("num_docks_available", f"WHERE grab_time > {SINCE}"),
    "status_history": _status_sql(f"SELECT {_HISTORY_FIELDS} FROM status"),
    "empty_stations": _with(
        _STATUS,
        _LATEST,
        body="SELECT station_id, num_bikes_available, grab_time AS latest_grab_time FROM latest WHERE num_bikes_available = 0",
    ),
    "target_status": _with(
        _STATUS,
        _STATION,
        body=f"""
        SELECT id, station_id, num_bikes_available, num_docks_available, grab_time,
               coalesce(is_installed, 0) AS is_installed, coalesce(is_renting, 0) AS is_renting,
               coalesce(is_returning, 0) AS is_returning,
               coalesce(num_bikes_disabled, 0) AS num_bikes_disabled,
               coalesce(num_docks_disabled, 0) AS num_docks_disabled
        FROM status WHERE station_id IN (SELECT station_id FROM station WHERE capacity >= {TARGET_CAPACITY})
        """,
    ),
    "poll_counts": _status_sql("SELECT grab_time, count(*) AS accepted_rows FROM status GROUP BY grab_time"),
    "history_counts": _status_sql("SELECT station_id, count(*) AS history_rows FROM status GROUP BY station_id"),
    "station_count": "SELECT count(*) AS stations FROM customer",
    "station_upsert": _with(
        _STATION,
        """
        updates AS (
          SELECT o_orderkey AS seq, o_custkey + 100 AS station_id, 'Order#' || o_orderkey AS name,
                 40.5::double + o_totalprice / 1000000.0::double AS lat, -73.9::double AS lon,
                 cast(length(o_orderpriority) AS int) AS capacity
          FROM orders
        )
        """,
        "last_seq AS (SELECT station_id, max(seq) AS seq FROM updates GROUP BY station_id)",
        body="""
        SELECT u.station_id, u.name, u.lat, u.lon, u.capacity
        FROM updates u JOIN last_seq f ON f.station_id = u.station_id AND f.seq = u.seq
        UNION ALL
        SELECT station_id, name, lat, lon, capacity FROM station
        WHERE station_id NOT IN (SELECT station_id FROM updates)
        """,
    ),
    "status_migrate": _status_sql(
        "SELECT * FROM status UNION ALL SELECT id, station_id, num_bikes_available, num_docks_available, grab_time, "
        "cast(NULL AS int), cast(NULL AS int), cast(NULL AS int), cast(NULL AS int), cast(NULL AS int) FROM status"
    ),
    "stream_status": _status_sql("SELECT * FROM status"),
    "stream_latest_status": _with(
        _STATUS,
        _LATEST,
        body="SELECT station_id, id, grab_time, num_bikes_available, num_docks_available, "
        "num_bikes_available = 0 AS is_empty FROM latest",
    ),
    "stream_new_points": _series_sql("num_bikes_available"),
    "csv_rides": _rides_sql(
        "SELECT cast(ride_id AS varchar) AS ride_id, started_ts, ended_ts, ride_duration_minutes, "
        "nullif(start_station_name, '') AS start_station_name, start_lat, member_casual FROM rides"
    ),
    "published_counts": _rides_sql(
        "SELECT 'rides_by_member_type' AS report, member_casual AS key, cast(count(*) AS varchar) AS rides "
        "FROM rides GROUP BY member_casual "
        "UNION ALL SELECT 'rides_by_rideable_type', rideable_type, cast(count(*) AS varchar) FROM rides GROUP BY rideable_type "
        "UNION ALL SELECT 'hourly_distribution', cast(hour(started_ts) AS varchar), cast(count(*) AS varchar) FROM rides "
        "GROUP BY hour(started_ts) "
        "UNION ALL SELECT 'top_start_stations', name, cast(n AS varchar) FROM (SELECT start_station_name AS name, count(*) AS n "
        "FROM rides WHERE start_station_name <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 10) "
        "UNION ALL SELECT 'top_end_stations', name, cast(n AS varchar) FROM (SELECT end_station_name AS name, count(*) AS n "
        "FROM rides WHERE end_station_name <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 10)"
    ),
    "status_mixed_writes": _status_sql("SELECT * FROM status"),
    "csv_mixed_layouts": _rides_sql(
        f"""
        SELECT cast(ride_id AS varchar) AS ride_id, started_ts, ended_ts, ride_duration_minutes,
               {_unless_few('rideable_type')},
               {_unless_few('start_station_name', "nullif(start_station_name, '')")},
               {_unless_few('start_station_id', "'0' || ride_id % 100")},
               {_unless_few('end_station_name', "nullif(end_station_name, '')")},
               {_unless_few('end_station_id', "(ride_id % 90) || '.10'")},
               {_unless_few('start_lat')}, {_unless_few('start_lng')}, {_unless_few('end_lat')}, {_unless_few('end_lng')},
               {_unless_few('member_casual')}
        FROM rides
        """
    ),
    "feed_status": _FED,
    "feed_refused": _status_sql(
        "SELECT day, 'bad station' AS reason FROM ("
        f"SELECT DISTINCT grab_time // 86400 AS day, id // {stored.DOCUMENT_ROWS} FROM status) WHERE day % 5 = 0"
    ),
    "feed_stations": _with(_STATION, body="SELECT station_id, name, lat, lon, capacity FROM station"),
    "first_load": _with(_STATION, body="SELECT station_id, name, lat, lon, capacity FROM station WHERE station_id % 2 = 0"),
    "published_reports": _rides_sql(
        f"""
        SELECT 'overview' AS report, unnest(['total_rides', 'distinct_ride_ids', 'first_ride_start', 'last_ride_end']) AS field,
               unnest([cast(count(*) AS varchar), cast(count(DISTINCT ride_id) AS varchar),
                       strftime(min(started_ts), '%Y-%m-%dT%H:%M:%S.%g'), strftime(max(ended_ts), '%Y-%m-%dT%H:%M:%S.%g')]) AS value
        FROM rides
        UNION ALL
        SELECT 'duration_stats', unnest(['avg_duration_min', 'median_duration_min', 'max_duration_min']),
               unnest([cast(round(avg(ride_duration_minutes), 2) AS varchar),
                       cast(round(quantile_disc(ride_duration_minutes, 0.5), 2) AS varchar),
                       cast(round(max(ride_duration_minutes), 2) AS varchar)])
        FROM rides WHERE ride_duration_minutes >= 0
        UNION ALL {_cells_sql('rides_by_member_type', 'member_casual', 'rides')}
        UNION ALL {_cells_sql('rides_by_rideable_type', 'rideable_type', 'rides')}
        UNION ALL {_cells_sql('top_start_stations', 'start_station_name', 'rides_started', top=True)}
        UNION ALL {_cells_sql('top_end_stations', 'end_station_name', 'rides_ended', top=True)}
        UNION ALL {_cells_sql('hourly_distribution', 'hour_of_day', 'rides', key='hour(started_ts)')}
        UNION ALL
        SELECT 'data_quality',
               unnest(['missing_start_station_name', 'missing_end_station_name', 'missing_start_coords', 'missing_end_coords']),
               unnest([cast(count(*) FILTER (coalesce(start_station_name, '') = '') AS varchar),
                       cast(count(*) FILTER (coalesce(end_station_name, '') = '') AS varchar),
                       cast(count(*) FILTER (start_lat IS NULL OR start_lng IS NULL) AS varchar),
                       cast(count(*) FILTER (end_lat IS NULL OR end_lng IS NULL) AS varchar)])
        FROM rides
        """
    ),
    "published_fallback": _rides_sql(
        "SELECT cast(hour(started_ts) AS varchar) AS hour_of_day, cast(count(*) AS varchar) AS rides FROM rides GROUP BY 1"
    ),
    "reports_minimal": _rides_sql(
        """
        SELECT 'overview' AS report, least(count(*), 1) AS "rows", 0::bigint AS empty_cells FROM rides
        UNION ALL SELECT 'duration_stats', least(count(*), 1), 0 FROM rides
        UNION ALL SELECT unnest(['rides_by_member_type', 'rides_by_rideable_type', 'top_start_stations', 'top_end_stations']), 0, 0
        UNION ALL SELECT 'hourly_distribution', count(DISTINCT hour(started_ts)), 0 FROM rides
        UNION ALL SELECT 'data_quality', least(count(*), 1), 4 FROM rides
        """
    ),
    "cursor_series": _with(
        _STATUS,
        "cursors AS (SELECT c_custkey AS station_id, 1704067200 + c_nationkey::bigint * 86400 AS last_time FROM customer)",
        body="SELECT consumer_id, s.station_id, s.grab_time * 1000 AS ts_ms, s.num_bikes_available AS value "
        "FROM status s JOIN cursors c ON c.station_id = s.station_id CROSS JOIN (VALUES (1), (2)) AS n(consumer_id) "
        "WHERE s.grab_time > c.last_time + consumer_id * 86400",
    ),
    "published_corrupt": _rides_sql(
        f"""
        {_cells_sql('hourly_distribution', 'hour_of_day', 'rides', key='hour(started_ts)', named=True)}
        UNION ALL {_cells_sql('rides_by_member_type', 'member_casual', 'rides')}
        """
    ),
    "published_whole": _with(
        _RIDES.replace("rides AS", "all_rides AS"),
        "rides AS (SELECT * FROM all_rides WHERE member_casual = 'casual')",
        body=f"""
        {_cells_sql('hourly_distribution', 'hour_of_day', 'rides', key='hour(started_ts)', named=True)}
        UNION ALL {_cells_sql('rides_by_member_type', 'member_casual', 'rides')}
        UNION ALL {_cells_sql('top_start_stations', 'start_station_name', 'rides_started', top=True)}
        """,
    ),
    "station_alerts": _ALERTS,
    "stream_station_alerts": _ALERTS,
    "stream_points_once": _series_sql("num_bikes_available"),
    "latest_incremental": _with(_STATUS, _STATION, _LATEST, _LATEST_STATUS, body="SELECT * FROM latest_status"),
    "live_state": _with(
        _STATUS,
        _LATEST,
        body="SELECT station_id, id, grab_time, num_bikes_available, num_docks_available, "
        "num_bikes_available = 0 AS is_empty FROM latest",
    ),
    "ingest_restarted": _FED,
    "feed_stamps": _status_sql(
        f"""
        SELECT station_id, day * 86400 + block AS grab_time, (day * 86400 + block) * 1000 + 125 AS arrived_ms,
               row_number() OVER (PARTITION BY day, block ORDER BY id) - 1 AS place, 1::bigint AS same_id
        FROM (SELECT *, grab_time // 86400 AS day, id // {stored.DOCUMENT_ROWS} AS block FROM status)
        WHERE day % 5 <> 0
        """
    ),
}
