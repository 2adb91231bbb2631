"""Row-level ride operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemetrics.functions.expressions import minutes_between
from ridemetrics.functions.headers import require_columns


def derive(rides: DataFrame) -> DataFrame:
    """Add started_ts, ended_ts and ride_duration_minutes.

    Text that is no timestamp becomes NULL. Columns that are timestamps
    already keep their type.
    """
    types = dict(require_columns(rides).dtypes)

    def parsed(name):
        return F.try_to_timestamp(F.col(name)) if types[name] == "string" else F.col(name)

    return rides.withColumns(
        {"started_ts": parsed("started_at"), "ended_ts": parsed("ended_at")}
    ).withColumn("ride_duration_minutes", minutes_between("started_ts", "ended_ts"))


def valid_rides(rides: DataFrame) -> DataFrame:
    """Rides whose duration is known and not negative."""
    return rides.filter(F.col("ride_duration_minutes") >= 0)
