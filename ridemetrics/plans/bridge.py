"""Rides, status and stations seen through the general test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridemetrics.functions.expressions import minutes_between


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null_when(condition, value):
    return F.when(~condition, value)


def rides_from_events(events: DataFrame) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id")
    no_end = event % 11 == 0
    seconds = F.floor((F.col("value") - F.lit(5.0)) * F.lit(60.0)).cast("int")
    return events.select(
        event.alias("ride_id"),
        F.col("event_type").alias("rideable_type"),
        F.col("ts").alias("started_ts"),
        F.timestamp_add("SECOND", seconds, F.col("ts")).alias("ended_ts"),
        F.when(event % 6 == 0, "casual").otherwise("member").alias("member_casual"),
        F.when(user % 10 == 1, "")
        .when(user % 10 != 0, F.concat(F.lit("station_"), (user % 50).cast("string")))
        .alias("start_station_name"),
        _null_when(
            no_end,
            F.when(event % 13 == 0, "").otherwise(
                F.concat(F.lit("station_"), (event % 50).cast("string"))
            ),
        ).alias("end_station_name"),
        _null_when(user % 10 == 0, F.lit(40.5) + (user % 100) / F.lit(1000.0)).alias("start_lat"),
        _null_when(user % 7 == 0, F.lit(-73.9) - (user % 100) / F.lit(1000.0)).alias("start_lng"),
        _null_when(no_end, F.lit(40.5)).alias("end_lat"),
        _null_when(event % 7 == 0, F.lit(-73.9)).alias("end_lng"),
    ).withColumn("ride_duration_minutes", minutes_between("started_ts", "ended_ts"))


def status_from_events(events: DataFrame) -> DataFrame:
    k = F.col("k")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("station_id"),
        F.unix_timestamp("ts").alias("grab_time"),
        # `props` holds this one number; matching it is several times faster
        # than parsing the document.
        F.regexp_extract("props", r'"k":\s*(-?\d+)', 1).try_cast("int").alias("k"),
    ).select(
        "id",
        "station_id",
        (k % 20).alias("num_bikes_available"),
        (F.lit(20) - k % 20).alias("num_docks_available"),
        "grab_time",
        F.lit(1).alias("is_installed"),
        _null_when(k == 0, k % 2).alias("is_renting"),
        _null_when(k == 0, k % 2).alias("is_returning"),
        (k % 3).alias("num_bikes_disabled"),
        (k % 4).alias("num_docks_disabled"),
    )


def stations_from_customers(customers: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customers.select(
        key.alias("station_id"),
        F.col("c_name").alias("name"),
        _null_when(key % 100 == 0, F.lit(40.5) + key / F.lit(100000.0)).alias("lat"),
        (F.lit(-73.9) - key / F.lit(100000.0)).alias("lon"),
        (F.lit(20) + F.col("c_nationkey")).alias("capacity"),
    )


def station_updates_from_orders(orders: DataFrame) -> DataFrame:
    """A station feed with repeated, changed and new stations; `seq` is its order."""
    return orders.select(
        F.col("o_orderkey").alias("seq"),
        (F.col("o_custkey") + 100).alias("station_id"),
        F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("name"),
        (F.lit(40.5) + F.col("o_totalprice") / F.lit(1000000.0)).alias("lat"),
        F.lit(-73.9).alias("lon"),
        F.length("o_orderpriority").alias("capacity"),
    )


def cursors_from_customers(customers: DataFrame) -> DataFrame:
    """One consumer per station, somewhere in the first weeks of 2024."""
    return customers.select(
        F.col("c_custkey").alias("station_id"),
        (F.lit(1704067200) + F.col("c_nationkey").cast("long") * 86400).alias("last_time"),
    )


def requested_from_parts(parts: DataFrame) -> DataFrame:
    """Station ids asked for; about a quarter of them are unknown."""
    return parts.select(F.col("p_partkey").alias("station_id"))
