"""Queries that go through files and streams: Spark writes what it derives from
the test tables to the shared scratch folder and reads it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridemetrics.operators.reports import all_reports
from ridemetrics.operators.rides import derive
from ridemetrics.operators.series import bike_series
from ridemetrics.plans import bridge
from ridemetrics.plans.bridge import table
from ridemetrics.schema import STATUS, STATUS_ADDED, STATUS_PARTITION
from ridemetrics.session import scratch_dir
from ridemetrics.sinks.reports import publish_reports, write_reports
from ridemetrics.sinks.tables import compact_status, load_stations_once, store_status
from ridemetrics.sources import files
from ridemetrics.sources.feeds import decode_stations, read_polls, refused_polls
from ridemetrics.sources.reports import read_reports
from ridemetrics.sources.rides import read_rides
from ridemetrics.sources.tables import follow_status, read_status
from ridemetrics.streaming.follow import deliver, new_points
from ridemetrics.streaming.ingest import append_status, ingest_status
from ridemetrics.streaming.live import keep_latest, read_live


def _as_stored(status: DataFrame) -> DataFrame:
    """Bridge status under the types of the stored status table."""
    columns = [column.split() for column in STATUS.split(", ")]
    return status.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns])


def _as_bridge(status: DataFrame) -> DataFrame:
    return status.withColumns({"id": F.col("id").cast("long"), "station_id": F.col("station_id").cast("long")})


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, since a stream takes a plain path for a folder; this one fits
    # the table as one file and as a folder of part files.
    events = table(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")


def _ingested(spark: SparkSession, sf_dir: str, run: str) -> str:
    status = _as_stored(bridge.status_from_events(_event_stream(spark, sf_dir)))
    append_status(status, f"{run}/status", f"{run}/ingest", interval=None).awaitTermination()
    return f"{run}/status"


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status rows ingested by a stream."""
    run = scratch_dir(spark, "stream-status")
    return _as_bridge(read_status(spark, _ingested(spark, sf_dir, run)).drop(STATUS_PARTITION))


def status_mixed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch write, a stream and a second batch write on one table; one day compacted."""
    path = f"{scratch_dir(spark, 'mixed-status')}/status"
    run = scratch_dir(spark, "mixed-ingest")
    status = _as_stored(bridge.status_from_events(table(spark, sf_dir, "events")))
    store_status(status.filter(F.col("id") % 3 == 0), path)
    streamed = _as_stored(bridge.status_from_events(_event_stream(spark, sf_dir)))
    append_status(streamed.filter(F.col("id") % 3 == 1), path, run, interval=None).awaitTermination()
    store_status(status.filter(F.col("id") % 3 == 2), path)
    compact_status(spark, path, "2024-01-02")
    return _as_bridge(read_status(spark, path).drop(STATUS_PARTITION))


def stream_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live table kept by a stream over the ingested status table."""
    run = scratch_dir(spark, "stream-latest")
    status = follow_status(spark, _ingested(spark, sf_dir, run))
    keep_latest(status, f"{run}/live", f"{run}/latest", interval=None).awaitTermination()
    return _as_bridge(read_live(spark, f"{run}/live")).select(
        "station_id", "id", "grab_time", "num_bikes_available", "num_docks_available", "is_empty"
    )


def stream_new_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart points delivered to a consumer that runs twice; none comes twice."""
    run = scratch_dir(spark, "stream-points")
    status = _ingested(spark, sf_dir, run)
    for _ in range(2):
        deliver(new_points(spark, status), f"{run}/points", f"{run}/cursor").awaitTermination()
    points = spark.read.parquet(f"{run}/points")
    return points.withColumn("station_id", F.col("station_id").cast("long"))


def csv_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides written as CSV under older header names, then read and derived."""
    run = scratch_dir(spark, "csv-rides")
    rides = bridge.rides_from_events(table(spark, sf_dir, "events"))
    rides.select(
        F.col("ride_id").alias("Ride ID"),
        F.col("started_ts").cast("string").alias("Start Time"),
        F.col("ended_ts").cast("string").alias("End Time"),
        F.col("start_station_name").alias("From Station Name"),
        F.col("start_lat").alias("Start Latitude"),
        F.col("member_casual").alias("Member or Casual Ride"),
    ).write.option("header", True).csv(run)
    return derive(read_rides(spark, run)).select(
        "ride_id",
        F.col("started_ts").cast("timestamp_ntz").alias("started_ts"),
        F.col("ended_ts").cast("timestamp_ntz").alias("ended_ts"),
        "ride_duration_minutes",
        "start_station_name",
        "start_lat",
        "member_casual",
    )


def csv_mixed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides under one prefix in three layouts: other order, older names, few columns."""
    run = scratch_dir(spark, "csv-mixed")
    rides = bridge.rides_from_events(table(spark, sf_dir, "events")).select(
        "ride_id",
        "rideable_type",
        F.col("started_ts").cast("string").alias("started_at"),
        F.col("ended_ts").cast("string").alias("ended_at"),
        "start_station_name",
        F.concat(F.lit("0"), F.col("ride_id") % 100).alias("start_station_id"),
        "end_station_name",
        F.concat(F.col("ride_id") % 90, F.lit(".10")).alias("end_station_id"),
        "start_lat",
        "start_lng",
        "end_lat",
        "end_lng",
        "member_casual",
    )
    layouts = [
        dict.fromkeys(reversed(rides.columns)),
        {
            "ride_id": "Ride ID",
            "started_at": "Start Time",
            "ended_at": "End Time",
            "rideable_type": "Rideable Type",
            "start_station_name": "From Station Name",
            "start_station_id": "From Station ID",
            "end_station_name": "To Station Name",
            "end_station_id": "To Station ID",
            "start_lat": "Start Latitude",
            "start_lng": "Start Longitude",
            "end_lat": "End Latitude",
            "end_lng": "End Longitude",
            "member_casual": "Member or Casual Ride",
        },
        {"ended_at": "ended_at", "ride_id": "ride_id", "started_at": "start_at"},
    ]
    for i, names in enumerate(layouts):
        part = rides.filter(F.col("ride_id") % 3 == i)
        part = part.select(*[F.col(c).alias(name or c) for c, name in names.items()])
        part.write.option("header", True).csv(f"{run}/v{i}.0")
    return derive(read_rides(spark, run)).select(
        *[c for c in rides.columns if c not in ("started_at", "ended_at")],
        F.col("started_ts").cast("timestamp_ntz").alias("started_ts"),
        F.col("ended_ts").cast("timestamp_ntz").alias("ended_ts"),
        "ride_duration_minutes",
    )


#: Rows of one landed document: more rows give more documents, not longer ones.
DOCUMENT_ROWS = 2000


def _land(documents: DataFrame, keys: list[str], path: str) -> str:
    """One landed JSON file per row of (keys, document)."""
    documents.repartition(*keys).write.partitionBy(*keys).text(path)
    return path


def _in_order(item, order: str):
    """Texts of a document's rows, ordered."""
    rows = F.array_sort(F.collect_list(F.struct(order, item.alias("item"))))
    return F.transform(rows, lambda row: row["item"])


def _landed_days(spark: SparkSession, sf_dir: str, purpose: str) -> str:
    """Events as status polls, each of some rows of one day in the order of their ids.

    Counters are absent where k is 0, a bike count is an explicit null where 7
    divides k, and every fifth day holds a station without counts.
    """
    events = table(spark, sf_dir, "events")
    status = bridge.status_from_events(events)
    text = {c: F.col(c).cast("string") for c in status.columns}
    k = F.regexp_extract(F.col("props"), r'"k":\s*(-?\d+)', 1).try_cast("int")
    k_of = events.select(F.col("event_id").alias("id"), k.alias("k"))
    counters = F.concat(*[F.concat(F.lit(f',"{c}":'), text[c]) for c in STATUS_ADDED])
    station = F.concat(
        F.lit('{"station_id":"'),
        text["station_id"],
        F.lit('","num_bikes_available":'),
        F.when(F.col("k") % 7 == 0, "null").otherwise(text["num_bikes_available"]),
        F.lit(',"num_docks_available":'),
        text["num_docks_available"],
        F.when(F.col("k") == 0, "").otherwise(counters),
        F.lit("}"),
    )
    days = (
        status.join(k_of, "id")
        .withColumn("day", F.floor(F.col("grab_time") / 86400))
        .withColumn("block", F.floor(F.col("id") / DOCUMENT_ROWS))
        .groupBy("day", "block")
        .agg(F.concat_ws(",", _in_order(station, "id")).alias("stations"))
    )
    bad = F.when(F.col("day") % 5 == 0, ',{"station_id":"no counts"}').otherwise("")
    document = F.concat(F.lit('{"data":{"stations":['), "stations", bad, F.lit("]}}"))
    keys = ["day", "block"]
    return _land(days.select(*keys, document.alias("value")), keys, f"{scratch_dir(spark, purpose)}/landing")


def feed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed status documents, ingested by a stream."""
    landing = _landed_days(spark, sf_dir, "feed-status")
    run = scratch_dir(spark, "feed-ingest")
    ingest_status(spark, landing, f"{run}/status", f"{run}/ck", targets=None, interval=None).awaitTermination()
    return _as_bridge(read_status(spark, f"{run}/status")).drop("id", "grab_time", STATUS_PARTITION)


def feed_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the ingest drops, by day."""
    polls = read_polls(spark.read, _landed_days(spark, sf_dir, "feed-refused"))
    day = F.regexp_extract("poll_id", r"day=(\d+)", 1).cast("long")
    return refused_polls(polls).select(day.alias("day"), "reason")


def _station_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as station documents, each of some customers, decoded."""
    stations = bridge.stations_from_customers(table(spark, sf_dir, "customer"))
    fields = F.struct(*[F.col(c).cast("string").alias(c) for c in stations.columns])
    documents = stations.groupBy(F.floor(F.col("station_id") / DOCUMENT_ROWS).alias("poll")).agg(
        F.to_json(
            F.struct(F.struct(F.collect_list(fields).alias("stations")).alias("data")), {"ignoreNullFields": "false"}
        ).alias("value")
    )
    landing = _land(documents, ["poll"], f"{scratch_dir(spark, 'feed-stations')}/landing")
    return decode_stations(read_polls(spark.read, landing))


def _as_bridge_stations(stations: DataFrame) -> DataFrame:
    return stations.withColumn("station_id", F.col("station_id").cast("long"))


def feed_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of landed documents."""
    return _as_bridge_stations(_station_feed(spark, sf_dir).drop("feed_order"))


def first_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even stations loaded first; a later load finds enough and changes nothing."""
    feed = materialised(_station_feed(spark, sf_dir), "feed")
    run = scratch_dir(spark, "first-load")
    even = feed.filter(F.col("station_id").cast("long") % 2 == 0)
    load_stations_once(spark, None, even, f"{run}/first", wanted=10)
    stored = load_stations_once(spark, f"{run}/first", feed, f"{run}/second", wanted=10)
    return _as_bridge_stations(stored)


def materialised(df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _cells(name: str, report: DataFrame) -> DataFrame:
    """Every value of a report as (report, field, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in report.columns])
    return report.select(F.lit(name).alias("report"), F.inline(pairs))


def published_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight reports, published and read back through a store URI."""
    run = scratch_dir(spark, "store")
    uri = run if ":" in run else f"file:{run}"
    write_reports(all_reports(bridge.rides_from_events(table(spark, sf_dir, "events"))), uri)
    found = read_reports(spark, [], store_uri=uri)
    return reduce(DataFrame.union, [_cells(name, report) for name, report in found.tables.items()])


def published_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store cannot be read, so the fresher of two local report sets is."""
    run = scratch_dir(spark, "fallback")
    rides = bridge.rides_from_events(table(spark, sf_dir, "events"))
    for name, part in (("old", rides.filter("member_casual = 'casual'")), ("new", rides)):
        write_reports({"hourly_distribution": all_reports(part)["hourly_distribution"]}, f"{run}/{name}")
    found = read_reports(spark, [f"{run}/old", f"{run}/new", f"{run}/none"], store_uri="s3:///no-bucket")
    return found.tables["hourly_distribution"]


def published_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the store cannot be read to its end, so all come from the local set."""
    run = scratch_dir(spark, "corrupt")
    rides = bridge.rides_from_events(table(spark, sf_dir, "events"))
    reports = all_reports(rides)
    counted = {name: reports[name] for name in ("hourly_distribution", "rides_by_member_type")}
    write_reports(counted, f"{run}/local")
    write_reports(counted, f"{run}/store")
    # A part whose name says gzip and whose bytes do not.
    plain = f"{run}/store/rides_by_member_type"
    part = next(n for n in files.child_files(spark, plain) if n.startswith("part-"))
    files.rename(spark, f"{plain}/{part}", f"{plain}/{part}.gz")
    found = read_reports(spark, [f"{run}/local"], store_uri=f"{run}/store" if ":" in run else f"file:{run}/store")
    return reduce(DataFrame.union, [_cells(name, found.tables[name]) for name in counted])


def published_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set whose fifth report fails while the rides of one kind are replaced by all: the old set stays."""
    run = scratch_dir(spark, "whole-set")
    rides = bridge.rides_from_events(table(spark, sf_dir, "events"))
    publish_reports(all_reports(rides.filter("member_casual = 'casual'")), run)
    broken = all_reports(rides)
    fifth = list(broken)[4]
    broken[fifth] = broken[fifth].withColumn("rides_started", F.raise_error(F.lit("the fifth report fails")).cast("long"))
    try:
        publish_reports(broken, run)
    except Exception as error:
        if "the fifth report fails" not in str(error):
            raise
    found = read_reports(spark, [run])
    names = ["hourly_distribution", "rides_by_member_type", "top_start_stations"]
    return reduce(DataFrame.union, [_cells(name, found.tables[name]) for name in names])


def reports_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, and cells without a value, of all reports over rides without optional columns."""
    rides = bridge.rides_from_events(table(spark, sf_dir, "events")).select(
        "ride_id", "started_ts", "ended_ts", "ride_duration_minutes"
    )

    def counted(name: str, report: DataFrame) -> DataFrame:
        empty = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in report.columns])
        return report.agg(F.count("*").alias("rows"), F.coalesce(F.sum(empty), F.lit(0)).alias("empty_cells")).select(
            F.lit(name).alias("report"), "rows", "empty_cells"
        )

    return reduce(DataFrame.union, [counted(name, report) for name, report in all_reports(rides).items()])


def cursor_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two consumers with their own cursors on the stored table; older days are skipped."""
    path = f"{scratch_dir(spark, 'cursors')}/status"
    store_status(_as_stored(bridge.status_from_events(table(spark, sf_dir, "events"))), path)
    cursors = bridge.cursors_from_customers(table(spark, sf_dir, "customer"))
    consumers = cursors.select(
        F.explode(F.array(F.lit(1), F.lit(2))).alias("consumer_id"),
        F.col("station_id").cast("string").alias("station_id"),
        "last_time",
    ).withColumn("last_time", F.col("last_time") + F.col("consumer_id") * 86400)
    points = bike_series(read_status(spark, path), since=consumers, ordered=False, known_only=True)
    return points.withColumn("station_id", F.col("station_id").cast("long"))


def published_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports published as CSV; the counting ones read back as text."""
    run = scratch_dir(spark, "reports")
    write_reports(all_reports(bridge.rides_from_events(table(spark, sf_dir, "events"))), run)
    tables = read_reports(spark, [run]).tables
    counted = [
        "rides_by_member_type",
        "rides_by_rideable_type",
        "top_start_stations",
        "top_end_stations",
        "hourly_distribution",
    ]
    parts = [tables[name].toDF("key", "rides").select(F.lit(name).alias("report"), "key", "rides") for name in counted]
    return reduce(DataFrame.union, parts)
