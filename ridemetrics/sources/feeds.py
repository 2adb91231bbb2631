"""Station feeds landed as JSON files, one document per poll.

The same decoding serves batch and streaming readers: a document is one row,
so whether a poll is sound is decided inside that row, with no shuffle and no
state.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, DataFrameReader
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from ridemetrics.functions.expressions import feed_int
from ridemetrics.schema import STATUS_ADDED

# Stations stay text maps: that tells an absent field from an explicit null
# and keeps booleans apart from numbers.
FEED = "array<struct<data: struct<stations: array<map<string, string>>>>>"

# Fields without which a poll is refused.
STATUS_REQUIRED = ["num_bikes_available", "num_docks_available"]
STATION_REQUIRED = ["name", "lat", "lon", "capacity"]

# Fields that count as zero when absent.
STATUS_DEFAULTED = list(STATUS_ADDED)

# Rows of one document that an insertion id can number.
POLL_ROWS = 10**7


def read_polls(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """Landed documents with their arrival time in whole seconds.

    Arrival is the file's own time, so replaying a poll stamps it the same as
    long as that time is kept; a store that moves files by copying stamps an
    archived poll anew. A file is one document: in brackets it must be an array
    of one, so a cut file and a file with a second document are unreadable.
    """
    arrived = F.col("_metadata.file_modification_time")
    body = F.regexp_replace("value", "^\\uFEFF", "")
    documents = F.from_json(F.concat(F.lit("["), body, F.lit("]")), FEED)
    one = F.coalesce(F.size(documents) == 1, F.lit(False))
    return (
        reader.text(path, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("poll_id"),
            F.unix_millis(arrived).alias("arrived_ms"),
            F.unix_timestamp(arrived).alias("grab_time"),
            F.when(one, F.get(documents, 0)["data"]["stations"]).alias("stations"),
            (~one).alias("unreadable"),
        )
    )


def _has(station: Column, field: str) -> Column:
    return F.map_contains_key(station, F.lit(field))


def _text(station: Column, field: str) -> Column:
    return F.try_element_at(station, F.lit(field))


def _is_target(station: Column, targets: Sequence[str] | None) -> Column:
    if targets is None:
        return F.lit(True)
    return F.coalesce(_text(station, "station_id").isin(list(targets)), F.lit(False))


def _not_int(station: Column, field: str, null_allowed: bool) -> Column:
    text = _text(station, field)
    wrong = feed_int(text).isNull()
    return wrong & text.isNotNull() if null_allowed else wrong


def _bad_status(station: Column) -> Column:
    checks = [~_has(station, f) | _not_int(station, f, null_allowed=True) for f in STATUS_REQUIRED]
    checks += [_has(station, f) & _not_int(station, f, null_allowed=False) for f in STATUS_DEFAULTED]
    return _any(checks)


def _bad_station(station: Column) -> Column:
    return _any([~_has(station, f) for f in STATION_REQUIRED])


def _any(checks: list[Column]) -> Column:
    result = checks[0]
    for check in checks[1:]:
        result = result | check
    return result


def _sound(polls: DataFrame, targets, bad) -> Column:
    """A poll is refused whole for one nameless station or one bad target."""
    faulty = F.exists(
        "stations", lambda s: ~_has(s, "station_id") | (_is_target(s, targets) & bad(s))
    )
    return F.col("stations").isNotNull() & ~F.coalesce(faulty, F.lit(True))


def _stations(polls: DataFrame, targets, bad, on_bad: str) -> DataFrame:
    """One row per accepted target station: poll columns, `seq` and `station`."""
    if on_bad not in ("drop_poll", "drop_row"):
        raise ValueError(f"on_bad must be drop_poll or drop_row, not {on_bad}")
    kept = polls.filter(_sound(polls, targets, bad)) if on_bad == "drop_poll" else polls
    rows = kept.select(
        "poll_id", "arrived_ms", "grab_time", F.posexplode("stations").alias("seq", "station")
    )
    station = F.col("station")
    rows = rows.filter(_is_target(station, targets))
    if on_bad == "drop_row":
        rows = rows.filter(_has(station, "station_id") & ~bad(station))
    return rows


def insertion_id() -> Column:
    """A number that grows with arrival, then poll, then position in the poll.

    Fixed width, so "newest row" stays a hash aggregation, and the same when a
    poll is read again. Of its 38 digits 13 are the arrival in milliseconds, 18
    tell polls of one millisecond apart, and 7 are the position; a longer
    document is an error.
    """
    poll = F.pmod(F.xxhash64("poll_id"), F.lit(10**18)).cast("decimal(18,0)")
    seq = F.when(F.col("seq") < POLL_ROWS, F.col("seq")).otherwise(
        F.raise_error(F.concat(F.lit("More stations than an id can number in "), F.col("poll_id"))).cast("int")
    )
    return (
        F.col("arrived_ms").cast("decimal(13,0)") * F.lit(Decimal(10**25))
        + poll * F.lit(POLL_ROWS).cast("decimal(8,0)")
        + seq.cast("decimal(10,0)")
    ).cast("decimal(38,0)")


def decode_status(
    polls: DataFrame, targets: Sequence[str] | None = None, on_bad: str = "drop_poll"
) -> DataFrame:
    """Status rows of the target stations, all stations when `targets` is None."""
    rows = _stations(polls, targets, _bad_status, on_bad)
    station = F.col("station")
    return rows.select(
        insertion_id().alias("id"),
        _text(station, "station_id").alias("station_id"),
        *[feed_int(_text(station, f)).alias(f) for f in STATUS_REQUIRED],
        "grab_time",
        *[F.coalesce(feed_int(_text(station, f)), F.lit(0)).alias(f) for f in STATUS_DEFAULTED],
    )


def decode_stations(
    polls: DataFrame, targets: Sequence[str] | None = None, on_bad: str = "drop_poll"
) -> DataFrame:
    """Station rows with `feed_order`; a station may appear more than once."""
    rows = _stations(polls, targets, _bad_station, on_bad)
    station = F.col("station")
    return rows.select(
        insertion_id().alias("feed_order"),
        _text(station, "station_id").alias("station_id"),
        _text(station, "name").alias("name"),
        _text(station, "lat").try_cast("double").alias("lat"),
        _text(station, "lon").try_cast("double").alias("lon"),
        feed_int(_text(station, "capacity")).alias("capacity"),
    )


def refused_polls(polls: DataFrame, targets: Sequence[str] | None = None) -> DataFrame:
    """Polls `decode_status` drops, and whether the file could be read at all."""
    return polls.filter(~_sound(polls, targets, _bad_status)).select(
        "poll_id",
        "grab_time",
        F.when(F.col("unreadable"), "unreadable")
        .when(F.col("stations").isNull(), "no stations")
        .otherwise("bad station")
        .alias("reason"),
    )
