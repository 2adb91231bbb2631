"""The eight ride reports. Each takes derived rides and stays lazy.

Every report reads only its own columns, so on columnar rides the set costs
one pruned pass per report. All counts combine on the map side before the
shuffle, so a station or type holding most rides sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridemetrics.functions.expressions import count_where, is_blank, is_filled
from ridemetrics.operators.rides import valid_rides
from ridemetrics.schema import REPORT_COLUMNS


def empty_report(rides: DataFrame, name: str) -> DataFrame:
    columns = [column.split() for column in REPORT_COLUMNS[name].split(", ")]
    return rides.sparkSession.range(0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in columns])


def overview(rides: DataFrame) -> DataFrame:
    """Totals over all rides, those with bad durations included."""
    # The distinct count shuffles every ride id. Kept apart as a scalar
    # subquery it carries nothing but the id; in one aggregation each id would
    # carry the other three buffers along.
    distinct_ids = rides.agg(F.count_distinct("ride_id").alias("n")).scalar()
    return rides.agg(
        F.count("*").alias("total_rides"),
        F.min("started_ts").alias("first_ride_start"),
        F.max("ended_ts").alias("last_ride_end"),
    ).select(
        "total_rides",
        distinct_ids.alias("distinct_ride_ids"),
        "first_ride_start",
        "last_ride_end",
    )


def _exact_duration_stats(valid: DataFrame) -> DataFrame:
    """Mean, discrete median and maximum from rides counted per duration.

    The running sums behind the median are bounded, never over all durations
    at once: first over whole days (a timestamp allows a few million), then
    over the seconds of the day that holds the middle ride (86,400 at most).
    """
    minutes, rides = F.col("minutes"), F.col("rides")
    per_duration = (
        valid.groupBy(F.col("ride_duration_minutes").alias("minutes"))
        .agg(F.count("*").alias("rides"))
        # Never NULL, so that the join below adds no filter and both readers
        # of the histogram share one exchange and one scan.
        .withColumn("day", F.coalesce(F.floor(minutes / 1440), F.lit(0)))
    )
    whole = Window.partitionBy(F.lit(0))
    middle_day = (
        per_duration.groupBy("day")
        # Whole seconds, so that the sum does not depend on its order.
        .agg(
            F.sum(rides).alias("n"),
            F.sum(F.round(minutes * 60).cast("long") * rides).alias("total"),
            F.max(minutes).alias("longest"),
        )
        .select(
            "day",
            F.sum("n").over(whole.orderBy("day")).alias("up_to"),
            "n",
            F.ceil(F.sum("n").over(whole) / 2).alias("middle"),
            (F.sum("total").over(whole) / 60 / F.sum("n").over(whole)).alias("mean"),
            F.max("longest").over(whole).alias("longest"),
        )
        .filter((F.col("up_to") >= F.col("middle")) & (F.col("up_to") - F.col("n") < F.col("middle")))
        .select("day", (F.col("middle") - F.col("up_to") + F.col("n")).alias("rank"), "mean", "longest")
    )
    within = Window.partitionBy("day").orderBy("minutes")
    middle_ride = (
        # One row, so broadcasting it is safe at any scale.
        per_duration.join(F.broadcast(middle_day), "day")
        .withColumn("up_to", F.sum(rides).over(within))
        .filter((F.col("up_to") >= F.col("rank")) & (F.col("up_to") - rides < F.col("rank")))
    )
    # At most one row; the aggregation makes it one when there are no rides.
    return middle_ride.agg(
        F.round(F.max("mean"), 2).alias("avg_duration_min"),
        F.round(F.max("minutes"), 2).alias("median_duration_min"),
        F.round(F.max("longest"), 2).alias("max_duration_min"),
    )


def duration_stats(rides: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Average, median and maximum minutes of valid rides.

    Durations are whole seconds, so counting rides per duration shrinks any
    input on the map side, and everything after works on that small histogram.
    The median is exact. With `accuracy` it is the approximate percentile of
    that accuracy: fewer stages, but all partial sketches meet in one task.
    """
    valid = valid_rides(rides)
    if accuracy is None:
        return _exact_duration_stats(valid)
    minutes = F.col("ride_duration_minutes")
    return valid.agg(
        F.round(F.avg(minutes), 2).alias("avg_duration_min"),
        F.round(F.percentile_approx(minutes, 0.5, accuracy), 2).alias("median_duration_min"),
        F.round(F.max(minutes), 2).alias("max_duration_min"),
    )


def _rides_by(rides: DataFrame, column: str, report: str) -> DataFrame:
    if column not in rides.columns:
        return empty_report(rides, report)
    return (
        rides.groupBy(column)
        .agg(F.count("*").alias("rides"))
        .orderBy(F.desc("rides"), column)
    )


def rides_by_member_type(rides: DataFrame) -> DataFrame:
    return _rides_by(rides, "member_casual", "rides_by_member_type")


def rides_by_rideable_type(rides: DataFrame) -> DataFrame:
    return _rides_by(rides, "rideable_type", "rides_by_rideable_type")


def _top_stations(rides: DataFrame, column: str, count: str, report: str, k: int) -> DataFrame:
    if column not in rides.columns:
        return empty_report(rides, report)
    return (
        rides.filter(is_filled(column))
        .groupBy(column)
        .agg(F.count("*").alias(count))
        .orderBy(F.desc(count), column)
        .limit(k)
    )


def top_start_stations(rides: DataFrame, k: int = 10) -> DataFrame:
    return _top_stations(rides, "start_station_name", "rides_started", "top_start_stations", k)


def top_end_stations(rides: DataFrame, k: int = 10) -> DataFrame:
    return _top_stations(rides, "end_station_name", "rides_ended", "top_end_stations", k)


def hourly_distribution(rides: DataFrame) -> DataFrame:
    return (
        rides.filter(F.col("started_ts").isNotNull())
        .groupBy(F.hour("started_ts").alias("hour_of_day"))
        .agg(F.count("*").alias("rides"))
        .orderBy("hour_of_day")
    )


def data_quality(rides: DataFrame) -> DataFrame:
    """Missing names and coordinate pairs; NULL where the columns are absent."""
    present = set(rides.columns)

    def metric(columns, condition):
        return count_where(condition()) if present.issuperset(columns) else F.lit(None).cast("long")

    def name(column):
        return metric([column], lambda: is_blank(column))

    def pair(lat, lng):
        return metric([lat, lng], lambda: F.col(lat).isNull() | F.col(lng).isNull())

    return rides.agg(
        name("start_station_name").alias("missing_start_station_name"),
        name("end_station_name").alias("missing_end_station_name"),
        pair("start_lat", "start_lng").alias("missing_start_coords"),
        pair("end_lat", "end_lng").alias("missing_end_coords"),
    )


def all_reports(
    rides: DataFrame, accuracy: int | None = None, k: int = 10
) -> dict[str, DataFrame]:
    return {
        "overview": overview(rides),
        "duration_stats": duration_stats(rides, accuracy),
        "rides_by_member_type": rides_by_member_type(rides),
        "rides_by_rideable_type": rides_by_rideable_type(rides),
        "top_start_stations": top_start_stations(rides, k),
        "top_end_stations": top_end_stations(rides, k),
        "hourly_distribution": hourly_distribution(rides),
        "data_quality": data_quality(rides),
    }
