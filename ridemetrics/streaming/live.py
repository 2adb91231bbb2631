"""The live latest-status table, kept by a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridemetrics.operators.alerts import is_empty
from ridemetrics.operators.stations import latest_rows
from ridemetrics.schema import STATUS
from ridemetrics.sources import files
from ridemetrics.streaming.ingest import POLL_INTERVAL, paced


def latest_stream(status: DataFrame) -> DataFrame:
    """Newest row per station; state holds one row per station.

    Rows compare by `id`, so files that arrive late cannot turn a station back.
    """
    return latest_rows(status)


def keep_latest_state(status: DataFrame, checkpoint: str, interval: str | None = POLL_INTERVAL) -> StreamingQuery:
    """Keep the newest row per station in the state of a stream, and nowhere else.

    `read_latest_state` answers from that state; no table is written besides.
    """
    columns = [column.split()[0] for column in STATUS.split(", ")]
    writer = (
        latest_stream(status.select(columns))
        .writeStream.outputMode("update")
        .format("noop")
        .option("checkpointLocation", checkpoint)
    )
    return paced(writer, interval).start()


def read_latest_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The newest row per station from the state kept by `keep_latest_state`.

    The state data source reads the last committed batch, while the stream may
    go on. A column's buffer is its value and the id it belongs to; the source
    gives them all the same names, so they are told by their order.
    """
    columns = [column.split() for column in STATUS.split(", ")]
    carried = [(name, kind) for name, kind in columns if name != "station_id"]
    order = dict(columns)["id"]
    buffers = ", ".join(f"{name}: {kind}, {name}_order: {order}" for name, kind in carried)
    state = spark.read.format("statestore").load(checkpoint)
    rows = state.select("key.station_id", F.col("value").cast(f"struct<{buffers}>").alias("value"))
    return rows.select("station_id", *[f"value.{name}" for name, _ in carried]).withColumn("is_empty", is_empty())


#: States kept besides the newest, so that a DataFrame read before stays whole.
KEPT = 2

_FINISHED = "_FINISHED"


def _state(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch={batch_id}"


def _finished(spark: SparkSession, root: str) -> list[int]:
    """Batches whose state is whole, oldest first."""
    numbers = sorted(int(n[6:]) for n in files.child_folders(spark, root) if n.startswith("batch="))
    return [n for n in numbers if files.exists(spark, f"{_state(root, n)}/{_FINISHED}")]


def merge_batch(root: str):
    """A foreachBatch function that merges changed stations into the table.

    Each batch writes a whole new state from the one before it and marks it as
    finished last. A batch that is run again reads the same input and writes the
    same state. Readers take finished states only; older ones go after `KEPT`
    further batches.
    """

    def merge(changes: DataFrame, batch_id: int) -> None:
        spark = changes.sparkSession
        before = [n for n in _finished(spark, root) if n < batch_id]
        # `changes` is used once: each use would run the stateful plan again.
        rows = changes
        if before:
            previous = spark.read.parquet(_state(root, before[-1]))
            rows = latest_rows(previous.drop("is_empty").unionByName(changes))
        (
            rows.withColumn("is_empty", is_empty())
            .write.mode("overwrite")
            .parquet(_state(root, batch_id))
        )
        files.touch(spark, f"{_state(root, batch_id)}/{_FINISHED}")
        for old in [n for n in before if n < batch_id - KEPT]:
            files.delete(spark, _state(root, old))

    return merge


def keep_latest(
    status: DataFrame, root: str, checkpoint: str, interval: str | None = POLL_INTERVAL
) -> StreamingQuery:
    """Keep the table at `root` current with a status stream."""
    writer = (
        latest_stream(status)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(merge_batch(root))
    )
    return paced(writer, interval).start()


def read_live(spark: SparkSession, root: str) -> DataFrame:
    """The newest finished state of the live table.

    `is_empty` is the empty-station alert: true while the newest bike count is
    exactly zero. The DataFrame reads this one state; it stays whole for `KEPT`
    more batches.
    """
    finished = _finished(spark, root)
    if not finished:
        raise ValueError(f"No finished state of the live table at {root}")
    return spark.read.parquet(_state(root, finished[-1]))
