"""Queries over streams that stop, restart and are followed meanwhile.

Spark writes what it derives from the test tables to the shared scratch folder;
streams read it there."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridemetrics.operators.alerts import alert_edges
from ridemetrics.operators.stations import latest_status
from ridemetrics.plans import bridge
from ridemetrics.plans.bridge import table
from ridemetrics.plans.stored import _as_bridge, _as_stored, _event_stream, _landed_days
from ridemetrics.schema import STATUS_PARTITION
from ridemetrics.session import scratch_dir
from ridemetrics.sinks.latest import latest_so_far, refresh_latest
from ridemetrics.sinks.tables import store_status
from ridemetrics.sources import files
from ridemetrics.sources.feeds import decode_status
from ridemetrics.sources.tables import follow_status, read_status
from ridemetrics.streaming.alerts import alert_changes
from ridemetrics.streaming.follow import deliver, new_points
from ridemetrics.streaming.ingest import append_status, ingest_status, landed_polls, load_writer
from ridemetrics.streaming.live import keep_latest_state, read_latest_state

# Documents a micro-batch takes where a query wants several of them, and how many
# micro-batches a landing folder makes at most: each has a cost of its own, however
# little it reads, so where many documents have landed it takes more of them.
FEW_FILES = 8
MOST_BATCHES = 12


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_stored(bridge.status_from_events(table(spark, sf_dir, "events")))


def _stopped_after_write(status: DataFrame, path: str, checkpoint: str, batch: int = 0) -> None:
    """Ingest that stops when it has written `batch` and not yet committed it."""
    write = load_writer(status.sparkSession, path, checkpoint)

    def stop(rows: DataFrame, batch_id: int) -> None:
        write(rows, batch_id)
        if batch_id >= batch:
            raise InterruptedError("stopped between write and commit")

    writer = status.writeStream.option("checkpointLocation", checkpoint).foreachBatch(stop)
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    except StreamingQueryException as error:
        if "stopped between write and commit" not in str(error):
            raise


def _few_files(spark: SparkSession, landing: str) -> int:
    """Documents a micro-batch takes: few, or an equal share of all. The listing reads no content."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(landing)
    return max(FEW_FILES, -(-listed.count() // MOST_BATCHES))


def _halves(status: DataFrame) -> list[DataFrame]:
    """Rows before and after the middle of their time."""
    middle = status.agg(((F.min("grab_time") + F.max("grab_time")) / 2).cast("long")).scalar()
    early = F.coalesce(F.col("grab_time") < middle, F.lit(True))
    return [status.filter(early), status.filter(~early)]


def _as_alerts(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("station_id").cast("long").alias("station_id"), "grab_time", "is_empty")


def station_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each station's empty alert went on and off, from all history."""
    return _as_alerts(alert_edges(bridge.status_from_events(table(spark, sf_dir, "events"))))


def stream_station_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream that is stopped and started again in the middle."""
    run = scratch_dir(spark, "stream-alerts")
    for part in _halves(_events(spark, sf_dir)):
        store_status(part, f"{run}/status")
        changes = alert_changes(follow_status(spark, f"{run}/status"))
        deliver(changes, f"{run}/alerts", f"{run}/cursor").awaitTermination()
    return _as_alerts(spark.read.parquet(f"{run}/alerts"))


def stream_points_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart points of a consumer that read a load which was then written again."""
    run = scratch_dir(spark, "points-once")
    status = _as_stored(bridge.status_from_events(_event_stream(spark, sf_dir)))
    _stopped_after_write(status, f"{run}/status", f"{run}/ingest")
    deliver(new_points(spark, f"{run}/status"), f"{run}/points", f"{run}/cursor").awaitTermination()
    append_status(status, f"{run}/status", f"{run}/ingest", interval=None).awaitTermination()
    deliver(new_points(spark, f"{run}/status"), f"{run}/points", f"{run}/cursor").awaitTermination()
    points = spark.read.parquet(f"{run}/points")
    return points.withColumn("station_id", F.col("station_id").cast("long"))


def latest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest status of every station: a snapshot of the first half, and the loads after it."""
    run = scratch_dir(spark, "latest-so-far")
    early, late = _halves(_events(spark, sf_dir))
    store_status(early, f"{run}/status")
    refresh_latest(spark, f"{run}/status", f"{run}/latest")
    store_status(late, f"{run}/status")
    newest = _as_bridge(latest_so_far(spark, f"{run}/status", f"{run}/latest"))
    return latest_status(bridge.stations_from_customers(table(spark, sf_dir, "customer")), newest)


def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row per station out of the state of a stream that was restarted."""
    run = scratch_dir(spark, "live-state")
    for part in _halves(_events(spark, sf_dir)):
        store_status(part, f"{run}/status")
        keep_latest_state(follow_status(spark, f"{run}/status"), f"{run}/state", interval=None).awaitTermination()
    return _as_bridge(read_latest_state(spark, f"{run}/state")).select(
        "station_id", "id", "grab_time", "num_bikes_available", "num_docks_available", "is_empty"
    )


def ingest_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed documents ingested a few at a time, with a stop between write and commit."""
    landing = _landed_days(spark, sf_dir, "restarted-landing")
    run = scratch_dir(spark, "restarted")
    few = _few_files(spark, landing)
    polls = decode_status(landed_polls(spark, landing, max_files=few))
    _stopped_after_write(polls, f"{run}/status", f"{run}/ck", batch=1)
    ingest_status(
        spark, landing, f"{run}/status", f"{run}/ck", targets=None, interval=None, max_files=few
    ).awaitTermination()
    return _as_bridge(read_status(spark, f"{run}/status")).drop("id", "grab_time", STATUS_PARTITION)


def feed_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of ingested rows: time and place in the document, out of the id, and how many rows share it."""
    landing = _landed_days(spark, sf_dir, "stamps-landing")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(landing)
    for path, day, block in listed.select("path", "day", "block").collect():
        files.set_time(spark, path, (day * 86400 + block) * 1000 + 125)
    run = scratch_dir(spark, "stamps")
    ingest_status(spark, landing, f"{run}/status", f"{run}/ck", targets=None, interval=None).awaitTermination()
    rows = read_status(spark, f"{run}/status")
    seq = F.col("id") % 10**7
    arrived = (F.col("id") - F.col("id") % F.lit(10**18)) / F.lit(10**18)
    arrived = ((arrived - arrived % 10**7) / 10**7).cast("long")
    return rows.select(
        F.col("station_id").cast("long").alias("station_id"),
        "grab_time",
        arrived.alias("arrived_ms"),
        seq.cast("long").alias("place"),
        F.count("*").over(Window.partitionBy("id")).alias("same_id"),
    )
