import json
import os

import pytest

from ridemetrics.operators.maintenance import upsert
from ridemetrics.schema import STATUS
from ridemetrics.sinks.tables import load_stations_once
from ridemetrics.sources.feeds import decode_stations, decode_status, read_polls, refused_polls


def land(folder, name, stations, arrived=None):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text(json.dumps({"last_updated": 1, "data": {"stations": stations}}, indent=1))
    if arrived is not None:
        os.utime(path, (arrived, arrived))
    return path


def station(station_id="a", bikes=3, docks=7, **more):
    return {"station_id": station_id, "num_bikes_available": bikes, "num_docks_available": docks, **more}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def decoded(spark, folder, **options):
    status = decode_status(read_polls(spark.read, str(folder)), **options)
    return rows(status.drop("id", "grab_time"))


def test_projection_and_defaults(spark, tmp_path):
    land(
        tmp_path,
        "p.json",
        [
            station("a", is_installed=True, is_renting=False, is_returning=1, num_bikes_disabled=2.7, extra={"x": []}),
            station("b", bikes=None, num_docks_disabled="4"),
        ],
        arrived=1700000000,
    )
    status = decode_status(read_polls(spark.read, str(tmp_path)))
    assert ", ".join(f"{n} {'long' if t == 'bigint' else t}" for n, t in status.dtypes) == STATUS
    assert {r.grab_time for r in status.collect()} == {1700000000}
    assert decoded(spark, tmp_path) == [("a", 3, 7, 1, 0, 1, 2, 0), ("b", None, 7, 0, 0, 0, 0, 4)]


def test_targets(spark, tmp_path):
    land(tmp_path, "p.json", [station("a"), station("b"), {"station_id": None}, {"station_id": "c"}])
    assert [r[0] for r in decoded(spark, tmp_path, targets=["a", "b"])] == ["a", "b"]


@pytest.mark.parametrize(
    "bad, reason",
    [
        ({"station_id": "a", "num_bikes_available": 1}, "bad station"),
        ({"num_bikes_available": 1, "num_docks_available": 1}, "bad station"),
        (station("a", is_renting=None), "bad station"),
        (station("a", is_renting="soon"), "bad station"),
    ],
)
def test_one_bad_target_refuses_the_poll(spark, tmp_path, bad, reason):
    land(tmp_path, "good.json", [station("a", bikes=1)])
    land(tmp_path, "bad.json", [station("a", bikes=2), bad])
    assert [r[1] for r in decoded(spark, tmp_path, targets=["a"])] == [1]
    assert [r[1] for r in decoded(spark, tmp_path, targets=["a"], on_bad="drop_row")] == [1, 2]
    refused = refused_polls(read_polls(spark.read, str(tmp_path)), ["a"]).collect()
    assert [(r.poll_id.rsplit("/", 1)[1], r.reason) for r in refused] == [("bad.json", reason)]


def test_bad_station_that_is_no_target_is_ignored(spark, tmp_path):
    land(tmp_path, "p.json", [station("a"), {"station_id": "z"}])
    assert len(decoded(spark, tmp_path, targets=["a"])) == 1
    assert decoded(spark, tmp_path) == []


def test_unreadable_polls(spark, tmp_path):
    land(tmp_path, "good.json", [station("a")])
    (tmp_path / "cut.json").write_text('{"data": {"stations": [{"station_id": "a"')
    (tmp_path / "other.json").write_text('{"status": "down"}')
    assert len(decoded(spark, tmp_path)) == 1
    refused = refused_polls(read_polls(spark.read, str(tmp_path)))
    assert rows(refused.select("reason")) == [("no stations",), ("unreadable",)]


def test_ids_follow_arrival_then_position(spark, tmp_path):
    land(tmp_path, "late.json", [station("c"), station("d")], arrived=1700000030)
    land(tmp_path, "early.json", [station("a"), station("b"), station("a", bikes=9)], arrived=1700000000)
    status = decode_status(read_polls(spark.read, str(tmp_path))).orderBy("id").collect()
    assert [(r.station_id, r.num_bikes_available) for r in status] == [("a", 3), ("b", 3), ("a", 9), ("c", 3), ("d", 3)]
    again = decode_status(read_polls(spark.read, str(tmp_path))).orderBy("id").collect()
    assert status == again


def test_on_bad_is_checked(spark, tmp_path):
    land(tmp_path, "p.json", [station("a")])
    with pytest.raises(ValueError, match="on_bad"):
        decoded(spark, tmp_path, on_bad="ignore")


def info(station_id, name="n", lat=40.5, lon=-73.9, capacity=20, **more):
    return {"station_id": station_id, "name": name, "lat": lat, "lon": lon, "capacity": capacity, **more}


def test_station_feed_last_entry_wins(spark, tmp_path):
    land(tmp_path, "i.json", [info("a", "old"), info("b"), info("a", "new", capacity=None), info("z")])
    feed = decode_stations(read_polls(spark.read, str(tmp_path)), ["a", "b"])
    stored = spark.createDataFrame([("a", "x", 0.0, 0.0, 1), ("k", "kept", 0.0, 0.0, 2)], feed.drop("feed_order").schema)
    assert rows(upsert(stored, feed, order="feed_order")) == [
        ("a", "new", 40.5, -73.9, None),
        ("b", "n", 40.5, -73.9, 20),
        ("k", "kept", 0.0, 0.0, 2),
    ]


def test_station_feed_needs_every_field(spark, tmp_path):
    entry = info("a")
    del entry["capacity"]
    land(tmp_path, "i.json", [entry, info("b")])
    polls = read_polls(spark.read, str(tmp_path))
    assert decode_stations(polls, ["a", "b"]).count() == 0
    assert decode_stations(polls, ["b"]).count() == 1
    assert decode_stations(polls, ["a", "b"], on_bad="drop_row").count() == 1


def test_first_load_only_while_stations_are_missing(spark, tmp_path):
    land(tmp_path / "f1", "i.json", [info("a"), info("b")])
    land(tmp_path / "f2", "i.json", [info("a", "renamed"), info("c")])
    first, second = (decode_stations(read_polls(spark.read, str(tmp_path / f))) for f in ("f1", "f2"))
    one, two, three = (str(tmp_path / f"stations{i}") for i in (1, 2, 3))
    assert load_stations_once(spark, None, first, one, wanted=3).count() == 2
    merged = load_stations_once(spark, one, second, two, wanted=3)
    assert [(r.station_id, r.name) for r in merged.orderBy("station_id").collect()] == [("a", "renamed"), ("b", "n"), ("c", "n")]
    assert load_stations_once(spark, two, first, three, wanted=3).filter("name = 'renamed'").count() == 1
    assert not os.path.exists(three)
    with pytest.raises(ValueError, match="new path"):
        load_stations_once(spark, two, first, two, wanted=4)
