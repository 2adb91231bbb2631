"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_AVAILABLE = "N/A"


def is_blank(name: str) -> Column:
    """NULL or empty. White space counts as content."""
    return F.col(name).isNull() | (F.col(name) == "")


def is_filled(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Minutes between two times, each cut to its whole second first."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(60.0)


def count_where(condition: Column) -> Column:
    """Rows for which `condition` is true; NULL when there are no rows."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def as_flag(name: str) -> Column:
    """0/1 integer to boolean, keeping NULL."""
    return F.col(name) != 0


def to_millis(name: str) -> Column:
    return F.col(name).cast("long") * F.lit(1000).cast("long")


def utc_day(epoch_seconds: Column) -> Column:
    """Date of an epoch second in UTC, whatever the session time zone."""
    return F.date_from_unix_date(F.floor(epoch_seconds / 86400).cast("int"))


def local_time(name: str) -> Column:
    """Epoch seconds as text in the session time zone."""
    return F.from_unixtime(F.col(name), "yyyy-MM-dd HH:mm:ss")


def or_not_available(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(NOT_AVAILABLE))


def coordinate_text(name: str) -> Column:
    return F.when(F.col(name).isNull(), NOT_AVAILABLE).otherwise(F.format_string("%.5f", F.col(name)))


def feed_int(text: Column) -> Column:
    """Feed value as an int: booleans become 0/1, fractions are cut, other text is NULL."""
    number = text.try_cast("double").try_cast("int")
    return F.when(text == "true", 1).when(text == "false", 0).otherwise(number)
