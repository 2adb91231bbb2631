import pytest

from ridemetrics.functions.headers import (
    aligned_names,
    align_columns,
    normalize_name,
    rename_columns,
    require_columns,
)


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("ride_id", "ride_id"),
        ("  Ride ID ", "ride_id"),
        ("Start--Time!!", "start_time"),
        ("__a__b__", "a_b"),
        ("start.lat", "start_lat"),
        ("Größe", "gr_e"),
        ("???", ""),
    ],
)
def test_normalize_name(raw, clean):
    assert normalize_name(raw) == clean


def test_rename_keeps_a_name_that_vanishes(spark):
    df = spark.createDataFrame([(1, 2)], "`Ride ID` int, `???` int")
    assert rename_columns(df).columns == ["ride_id", "???"]


def test_colliding_headers_are_refused(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Ride ID` int, `ride-id` int, other int")
    with pytest.raises(ValueError, match=r"\['Ride ID', 'ride-id'\]"):
        rename_columns(df)


def test_aliases(spark):
    names = ["ride_id", "start_time", "End Time", "from_station_name", "To Station ID", "member_or_casual_ride", "extra"]
    assert aligned_names(names) == [
        "ride_id",
        "started_at",
        "ended_at",
        "start_station_name",
        "end_station_id",
        "member_casual",
        "extra",
    ]
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6, 7)], ", ".join(f"`{n}` int" for n in names))
    assert align_columns(df).first().asDict()["started_at"] == 2


def test_existing_target_beats_alias():
    assert aligned_names(["start_time", "started_at"]) == ["start_time", "started_at"]


def test_first_alias_wins():
    assert aligned_names(["start_at", "start_time"]) == ["start_at", "started_at"]


def test_required_columns_are_named(spark):
    with pytest.raises(ValueError, match=r"\['started_at', 'ended_at'\]"):
        require_columns(spark.createDataFrame([("a",)], "ride_id string"))
