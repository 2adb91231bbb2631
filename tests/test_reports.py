import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridemetrics.operators import reports
from ridemetrics.operators.rides import derive
from ridemetrics.plans import catalog
from ridemetrics.schema import REPORT_COLUMNS

SCHEMA = (
    "ride_id string, rideable_type string, started_at string, ended_at string, start_station_name string, "
    "end_station_name string, start_lat double, start_lng double, end_lat double, end_lng double, member_casual string"
)


@pytest.fixture(scope="module")
def rides(spark):
    rows = [
        ("r1", "classic", "2026-03-01 08:00:00", "2026-03-01 08:10:00", "A", "B", 1.0, 2.0, 3.0, 4.0, "member"),
        ("r1", "classic", "2026-03-01 08:30:00", "2026-03-01 08:30:00", "A", "", 1.0, None, 3.0, 4.0, "member"),
        ("r2", "electric", "2026-03-01 23:59:59", "2026-03-02 00:20:29", " ", None, None, 2.0, None, None, None),
        ("r3", "electric", "bad", "2026-03-09 00:00:00", "", "B", 1.0, 2.0, None, 4.0, "casual"),
        ("r4", None, "2026-02-01 00:05:00", "2026-02-01 00:00:00", None, "C", None, None, 3.0, 4.0, "member"),
    ]
    return derive(spark.createDataFrame(rows, SCHEMA))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_overview_counts_bad_durations(rides):
    assert rows(reports.overview(rides)) == [
        (5, 4, dt.datetime(2026, 2, 1, 0, 5), dt.datetime(2026, 3, 9))
    ]


def test_duration_stats_over_valid_rides(rides):
    assert rows(reports.duration_stats(rides)) == [(10.17, 10.0, 20.5)]


@pytest.mark.parametrize("seed", range(4))
def test_median_is_exact_over_many_days(spark, seed):
    rng = random.Random(seed)
    spans = [rng.choice([0, 1, 59, 86399, 86400, 86401, rng.randrange(10**7)]) for _ in range(rng.choice([1, 2, 57, 200]))]
    start = dt.datetime(2026, 3, 1)
    rows_in = [("r", start, start + dt.timedelta(seconds=s)) for s in spans] + [("bad", start, None)]
    rides = derive(spark.createDataFrame(rows_in, "ride_id string, started_at timestamp, ended_at timestamp"))
    exact = reports.duration_stats(rides).first()
    assert exact.median_duration_min == pytest.approx(sorted(spans)[(len(spans) - 1) // 2] / 60, abs=0.00501)
    assert exact.avg_duration_min == pytest.approx(sum(spans) / len(spans) / 60, abs=0.00501)
    assert exact.max_duration_min == pytest.approx(max(spans) / 60, abs=0.00501)
    assert tuple(reports.duration_stats(rides, accuracy=10_000).first()) == tuple(exact)


def test_groups_keep_null(rides):
    assert rows(reports.rides_by_member_type(rides)) == [("member", 3), (None, 1), ("casual", 1)]
    assert rows(reports.rides_by_rideable_type(rides)) == [("classic", 2), ("electric", 2), (None, 1)]


def test_top_stations_skip_blank_and_break_ties_by_name(rides):
    assert rows(reports.top_start_stations(rides)) == [("A", 2), (" ", 1)]
    assert rows(reports.top_end_stations(rides, k=2)) == [("B", 2), ("C", 1)]


def test_hours(rides):
    assert rows(reports.hourly_distribution(rides)) == [(0, 1), (8, 2), (23, 1)]


def test_quality(rides):
    assert rows(reports.data_quality(rides)) == [(2, 2, 3, 2)]


def test_minimal_columns(spark):
    rides = derive(
        spark.createDataFrame(
            [("a", "2026-03-01 00:00:00", "2026-03-01 00:01:00")] * 3,
            "ride_id string, started_at string, ended_at string",
        )
    )
    built = reports.all_reports(rides)
    assert list(built) == list(REPORT_COLUMNS)
    for name in ["rides_by_member_type", "rides_by_rideable_type", "top_start_stations", "top_end_stations"]:
        assert built[name].count() == 0
    assert rows(built["data_quality"]) == [(None, None, None, None)]
    for name, ddl in REPORT_COLUMNS.items():
        assert ", ".join(f"{c} {'long' if t == 'bigint' else t}" for c, t in built[name].dtypes) == ddl


def test_no_rides(spark, rides):
    none = rides.limit(0)
    assert rows(reports.overview(none)) == [(0, 0, None, None)]
    assert rows(reports.duration_stats(none)) == [(None, None, None)]
    assert rows(reports.data_quality(none)) == [(None, None, None, None)]
    assert rows(reports.hourly_distribution(none)) == []


def test_sums_agree_on_a_larger_scale(spark):
    rides = catalog.rides(spark, "/root/testdata/sf0.1").cache()
    built = reports.all_reports(rides)
    whole = built["overview"].first()
    unstarted = rides.filter(F.col("started_ts").isNull()).count()

    def total(name):
        return built[name].agg(F.sum("rides")).first()[0]

    assert total("hourly_distribution") + unstarted == whole.total_rides
    assert total("rides_by_member_type") == whole.total_rides
    assert total("rides_by_rideable_type") == whole.total_rides
    assert whole.distinct_ride_ids <= whole.total_rides
    for name, count in [("top_start_stations", "rides_started"), ("top_end_stations", "rides_ended")]:
        counts = [r[count] for r in built[name].collect()]
        assert len(counts) <= 10 and counts == sorted(counts, reverse=True)
    assert all(0 <= missing <= whole.total_rides for missing in built["data_quality"].first())
    rides.unpersist()
