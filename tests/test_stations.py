import datetime as dt
import random
from collections import Counter

import pytest

from ridemetrics.functions.expressions import to_millis
from ridemetrics.operators import maintenance, series, stations
from ridemetrics.schema import STATION, STATUS
from ridemetrics.sinks.tables import store_status
from ridemetrics.sources.tables import read_status

STATUS_LONG = STATUS.replace("decimal(38,0)", "long")
FIELDS = [c.split()[0] for c in STATUS_LONG.split(", ")]


@pytest.fixture(scope="module")
def places(spark):
    rows = [
        ("s1", "Oak", 40.123456, -73.9, 20),
        ("s2", "Elm", None, None, None),
        ("s3", "Ash", 40.5, -73.95, 30),
        ("never", "Yew", 1.0, 2.0, 5),
    ]
    return spark.createDataFrame(rows, STATION)


@pytest.fixture(scope="module")
def history():
    """Half of all rows belong to one station; time may run backwards."""
    rng = random.Random(7)
    rows = []
    for i in range(1, 401):
        flag = rng.choice([None, 0, 1])
        rows.append((
            i,
            "s1" if rng.random() < 0.5 else rng.choice(["s2", "s3", "ghost"]),
            rng.choice([None, 0, 0, 5]),
            rng.randrange(20),
            1700000000 + 30 * (i // 5) - rng.choice([0, 0, 45]),
            flag,
            flag,
            None,
            rng.choice([None, 3]),
            1,
        ))
    return rows


@pytest.fixture(scope="module")
def status(spark, history):
    return spark.createDataFrame(history, STATUS_LONG).repartition(5)


def newest(history):
    best = {}
    for row in history:
        if row[1] not in best or row[0] > best[row[1]][0]:
            best[row[1]] = row
    return {k: dict(zip(FIELDS, v)) for k, v in best.items()}


def test_latest_status_matches_brute_force(places, status, history):
    got = stations.latest_status(places, status).collect()
    assert [r.name for r in got] == ["Ash", "Elm", "Oak", "Yew"]
    best = newest(history)
    for row in got:
        want = best.get(row.station_id)
        if want is None:
            assert row.station_id == "never" and row.latest_grab_time is None and row.is_renting is None
            continue
        flag = want["is_renting"]
        assert row.is_renting == (None if flag is None else bool(flag))
        assert row.is_returning is None
        assert row.num_bikes_available == want["num_bikes_available"]
        assert row.num_vehicles_disabled == row.num_bikes_disabled == want["num_bikes_disabled"]
        assert row.latest_grab_time_ms == want["grab_time"] * 1000


def test_station_latest_for_one_many_and_unknown(spark, places, status, history):
    best = newest(history)
    one = stations.station_latest("s1", places, status).collect()
    assert [(r.station_id, r.latest_grab_time, r.found) for r in one] == [("s1", best["s1"]["grab_time"], True)]
    ids = spark.createDataFrame([("s1",), ("never",), ("ghost",), ("nobody",), ("s1",)], "station_id string")
    by_relation = stations.station_latest(ids, places, status)
    by_list = stations.station_latest(["s1", "never", "ghost", "nobody"], places, status)
    assert "num_bikes_disabled" not in by_list.columns
    assert sorted(by_relation.collect()) == sorted(by_list.collect())
    found = {r.station_id: r.found for r in by_list.collect()}
    assert found == {"s1": True, "never": True, "ghost": False, "nobody": False}
    with pytest.raises(LookupError, match="nobody"):
        stations.latest_or_raise("nobody", places, status)
    assert "found" not in stations.latest_or_raise("never", places, status).columns


def test_station_detail_labels_unknown_ids(places, status, history):
    card, rows = stations.station_detail(["ghost", "s2"], places, status)
    names = {r.station_id: (r.station_name, r.station_lat) for r in card.collect()}
    assert names == {"ghost": ("ghost", None), "s2": ("Elm", None)}
    assert rows.count() == sum(r[1] in ("ghost", "s2") for r in history)


def test_card_text(places, status, history):
    card = {r.station_id: r for r in stations.station_card(stations.latest_status(places, status)).collect()}
    assert (card["s1"].lat, card["s3"].lon, card["s2"].lat) == ("40.12346", "-73.95000", "N/A")
    assert card["s2"].capacity == "N/A" and card["s1"].capacity == "20"
    assert card["never"].latest_update == card["never"].is_renting == card["never"].num_bikes_available == "N/A"
    flag = newest(history)["s1"]["is_installed"]
    assert card["s1"].is_installed == {None: "N/A", 0: "false", 1: "true"}[flag]


def test_zero_epoch_is_shown_as_missing(spark, places):
    row = (1, "s1", 1, 1, 0, 1, 1, 1, 0, 0)
    card = stations.station_card(stations.latest_status(places, spark.createDataFrame([row], STATUS_LONG)))
    assert card.filter("station_id = 's1'").first().latest_update == "N/A"


def test_empty_stations(status, history):
    got = {r.station_id for r in stations.empty_stations(status).collect()}
    assert got == {k for k, v in newest(history).items() if v["num_bikes_available"] == 0}


@pytest.mark.parametrize("build, field", [(series.bike_series, 2), (series.dock_series, 3)])
def test_series_since_is_strict(spark, status, history, build, field):
    moment = 1700000990
    nulls_first = lambda value: (value is not None, value or 0)
    want = [(r[1], r[4] * 1000, r[field]) for r in history if r[1] == "s1"]
    want.sort(key=lambda r: (r[1], nulls_first(r[2])))
    assert any(r[1] == moment * 1000 for r in want)
    assert [tuple(r) for r in build(status, "s1").collect()] == want
    assert [tuple(r) for r in build(status, "s1", since=0).collect()] == want
    assert [tuple(r) for r in build(status, "s1", since=-5).collect()] == want
    later = [r for r in want if r[1] > moment * 1000]
    assert [tuple(r) for r in build(status, "s1", since=moment).collect()] == later
    cursors = spark.createDataFrame([("s1", moment), ("s2", 0)], "station_id string, last_time long")
    got = build(status, ["s1", "s2"], since=cursors)
    assert [tuple(r) for r in got.filter("station_id = 's1'").collect()] == later
    assert got.filter("station_id = 's2'").count() == sum(r[1] == "s2" for r in history)


def test_history_order_and_text(status, history):
    got = stations.status_history(status, "s3").collect()
    want = sorted((r for r in history if r[1] == "s3"), key=lambda r: (r[4], r[0]))
    assert [(r.id, r.grab_time_ms) for r in got] == [(r[0], r[4] * 1000) for r in want]
    assert [r.local_time for r in got] == [
        dt.datetime.fromtimestamp(r[4], dt.UTC).strftime("%Y-%m-%d %H:%M:%S") for r in want
    ]
    assert stations.status_history(status, since=1700000990).count() == sum(r[4] > 1700000990 for r in history)


def test_counts(places, status, history):
    assert {r[0]: r[1] for r in stations.poll_counts(status).collect()} == Counter(r[4] for r in history)
    assert {r[0]: r[1] for r in stations.history_counts(status).collect()} == Counter(r[1] for r in history)
    assert stations.history_counts(status, "s2").count() == 1
    assert stations.station_count(places).first().stations == 4


def test_target_status_by_list_and_relation(places, status, history):
    listed = stations.target_status(status, ["s1", "s3"])
    related = stations.target_status(status, places.filter("capacity >= 20"))
    assert sorted(listed.collect()) == sorted(related.select(listed.columns).collect())
    assert listed.filter("is_returning is null").count() == 0
    assert listed.count() == sum(r[1] in ("s1", "s3") for r in history)


def test_millis_do_not_overflow(spark):
    assert spark.createDataFrame([(1700000000,)], "t int").select(to_millis("t")).first()[0] == 1700000000000


def test_upsert_without_order_and_old_columns(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "station_id int, name string")
    fresh = spark.createDataFrame([("B", 2), ("C", 3)], "name string, station_id int")
    got = maintenance.upsert(stored, fresh).select("station_id", "name").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "B"), (3, "C")]


def test_added_columns_are_null_and_present_ones_stay(spark, status):
    partly = status.drop("is_renting", "num_docks_disabled")
    moved = maintenance.add_missing_columns(partly)
    assert dict(moved.dtypes)["is_renting"] == "int"
    assert moved.filter("is_renting is not null").count() == 0
    assert moved.filter("num_bikes_disabled = 3").count() == status.filter("num_bikes_disabled = 3").count()
    both = maintenance.union_status(partly, status)
    assert both.columns == status.columns and both.count() == 2 * status.count()


def test_needs_loading(spark):
    assert maintenance.needs_loading(spark.range(2), 3)
    assert not maintenance.needs_loading(spark.range(3), 3)


def test_stored_status_reads_old_files_and_prunes(spark, status, history, tmp_path, capsys):
    path = str(tmp_path / "status")
    typed = status.withColumn("id", status.id.cast("decimal(38,0)"))
    store_status(typed.drop("is_installed", "is_renting", "is_returning", "num_bikes_disabled", "num_docks_disabled"), path)
    store_status(typed, path)
    back = read_status(spark, path)
    assert back.columns == FIELDS + ["grab_date"] and back.count() == 800
    assert back.filter("num_docks_disabled is null").count() == 400
    series.bike_series(back, "s1", since=1700001000).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(station_id,s1)" in plan and "GreaterThan(grab_time,1700001000)" in plan
    assert "PartitionFilters: [isnotnull(grab_date" in plan and ">= 2023-11-14)" in plan


def test_day_filter_keeps_every_later_row(spark, tmp_path):
    midnight = 1700006400
    rows = [(i, "s", i, 0, midnight + 7200 * i, 1, 1, 1, 0, 0) for i in range(-30, 30)]
    path = str(tmp_path / "days")
    status = spark.createDataFrame(rows, STATUS_LONG)
    store_status(status.withColumn("id", status.id.cast("decimal(38,0)")), path)
    back = read_status(spark, path)
    assert back.select("grab_date").distinct().count() == 6
    for since in [midnight - 1, midnight, midnight + 1, midnight - 86400, midnight + 43200]:
        want = sorted(r[4] * 1000 for r in rows if r[4] > since)
        for zone in ["UTC", "Pacific/Auckland", "America/Los_Angeles"]:
            spark.conf.set("spark.sql.session.timeZone", zone)
            try:
                got = [r.ts_ms for r in series.bike_series(back, "s", since=since).collect()]
                assert got == want
                assert stations.status_history(back, "s", since=since).count() == len(want)
            finally:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
