import pytest
from pyspark.sql import functions as F

from ridemetrics.operators.stations import empty_stations, latest_rows
from ridemetrics.functions.expressions import utc_day
from ridemetrics.sinks.tables import compact_status, store_status, write_load
from ridemetrics.sources.feeds import decode_status, read_polls
from ridemetrics.sources.tables import follow_status, read_status
from ridemetrics.streaming.follow import deliver, new_points
from ridemetrics.streaming.ingest import append_status, ingest_status
from ridemetrics.streaming.live import keep_latest, merge_batch, read_live
from tests.test_feeds import land, station


def rows(df, *drop):
    return sorted((tuple(r) for r in df.drop(*drop).collect()), key=repr)


@pytest.fixture
def folders(tmp_path):
    return {n: str(tmp_path / n) for n in ["landing", "table", "live", "out", "ck1", "ck2", "ck3"]} | {"root": tmp_path}


def ingest(spark, f, **options):
    ingest_status(spark, f["landing"], f["table"], f["ck1"], interval=None, **options).awaitTermination()


def land_polls(f, first, count, **more):
    for i in range(first, first + count):
        land(
            f["root"] / "landing",
            f"poll{i}.json",
            [station("a", bikes=i % 3), station("b", bikes=i), station("z")] + more.get("extra", []),
            arrived=1700000000 + 30 * i,
        )


def test_ingest_equals_batch_and_survives_restart(spark, folders):
    f = folders
    land_polls(f, 0, 3)
    (f["root"] / "landing" / "cut.json").write_text('{"data": {"stations": [{')
    ingest(spark, f, targets=["a", "b"], max_files=1)
    assert read_status(spark, f["table"]).count() == 6
    land_polls(f, 3, 2)
    ingest(spark, f, targets=["a", "b"])
    ingest(spark, f, targets=["a", "b"])
    batch = decode_status(read_polls(spark.read, f["landing"]), ["a", "b"])
    assert rows(read_status(spark, f["table"]), "grab_date") == rows(batch)
    assert read_status(spark, f["table"]).select("id").distinct().count() == 10


def test_bad_poll_is_lost_whole(spark, folders):
    f = folders
    land_polls(f, 0, 1)
    land_polls(f, 1, 1, extra=[{"station_id": "a"}])
    land_polls(f, 2, 1)
    ingest(spark, f, targets=["a", "b"])
    assert read_status(spark, f["table"]).select("grab_time").distinct().count() == 2


def test_archive_moves_finished_files(spark, folders):
    f = folders
    land_polls(f, 0, 2)
    ingest(spark, f, targets=["a"], archive=f"{f['root']}/done", max_files=1)
    assert read_status(spark, f["table"]).count() == 2


def test_live_table_equals_batch_over_restarts(spark, folders):
    f = folders
    for step in range(3):
        land_polls(f, step * 2, 2)
        ingest(spark, f, targets=None)
        keep_latest(follow_status(spark, f["table"], max_files=1), f["live"], f["ck2"], interval=None).awaitTermination()
        batch = latest_rows(read_status(spark, f["table"]).drop("grab_date"))
        live = read_live(spark, f["live"])
        assert rows(live.select(batch.columns)) == rows(batch)
        assert {r.station_id for r in live.filter("is_empty").collect()} == {
            r.station_id for r in empty_stations(read_status(spark, f["table"])).collect()
        }


def test_files_with_old_times_are_not_skipped(spark, folders):
    f = folders
    land(f["root"] / "landing", "today.json", [station("a")])
    ingest(spark, f, targets=["a"])
    land_polls(f, 0, 2)
    ingest(spark, f, targets=["a"])
    assert read_status(spark, f["table"]).count() == 3


def test_late_file_does_not_turn_a_station_back(spark, folders):
    f = folders
    land_polls(f, 5, 1)
    ingest(spark, f, targets=["b"])
    keep_latest(follow_status(spark, f["table"]), f["live"], f["ck2"], interval=None).awaitTermination()
    land_polls(f, 1, 1)
    ingest(spark, f, targets=["b"])
    keep_latest(follow_status(spark, f["table"]), f["live"], f["ck2"], interval=None).awaitTermination()
    assert [(r.station_id, r.num_bikes_available) for r in read_live(spark, f["live"]).collect()] == [("b", 5)]


def test_a_batch_run_again_gives_the_same_table(spark, folders):
    f = folders
    schema = "id long, station_id string, num_bikes_available int"
    batches = [
        [(1, "a", 0), (2, "b", 2)],
        [(3, "a", 4)],
        [(4, "c", None), (5, "b", 0)],
    ]
    merge = merge_batch(f["live"])
    for i, batch in enumerate(batches):
        merge(spark.createDataFrame(batch, schema), i)
        once = rows(read_live(spark, f["live"]))
        merge(spark.createDataFrame(batch, schema), i)
        assert rows(read_live(spark, f["live"])) == once
    alerts = {r.station_id: (r.num_bikes_available, r.is_empty) for r in read_live(spark, f["live"]).collect()}
    assert alerts == {"a": (4, False), "b": (0, True), "c": (None, False)}
    # A batch cut off while writing is not read; the state before it is whole.
    (f["root"] / "live" / "batch=2" / "_FINISHED").unlink()
    part = next((f["root"] / "live" / "batch=2").glob("part-*"))
    part.unlink()
    assert {r.station_id for r in read_live(spark, f["live"]).collect()} == {"a", "b"}
    merge(spark.createDataFrame(batches[2], schema), 2)
    assert rows(read_live(spark, f["live"])) == once


def test_consumer_sees_each_row_once(spark, folders):
    f = folders
    total = []
    for step in range(2):
        land_polls(f, step * 3, 3)
        ingest(spark, f, targets=["a", "b"])
        deliver(new_points(spark, f["table"], "bikes", ids="b"), f["out"], f["ck3"]).awaitTermination()
        total.append(spark.read.parquet(f["out"]).count())
    assert total == [3, 6]
    points = spark.read.parquet(f["out"]).orderBy("ts_ms").collect()
    assert [(r.station_id, r.ts_ms, r.value) for r in points] == [
        ("b", (1700000000 + 30 * i) * 1000, i) for i in range(6)
    ]


def test_timed_trigger_runs_until_stopped(spark, folders):
    f = folders
    land_polls(f, 0, 1)
    status = decode_status(read_polls(spark.readStream, f["landing"]), ["a"])
    query = append_status(status, f["table"], f["ck1"], interval="1 second")
    try:
        query.processAllAvailable()
        land_polls(f, 1, 1)
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert read_status(spark, f["table"]).count() == 2


def test_a_held_live_table_survives_the_next_batches(spark, folders):
    merge = merge_batch(folders["live"])
    schema = "id long, station_id string, num_bikes_available int"
    merge(spark.createDataFrame([(1, "a", 3)], schema), 0)
    held = read_live(spark, folders["live"])
    merge(spark.createDataFrame([(2, "a", 5)], schema), 1)
    merge(spark.createDataFrame([(3, "b", 0)], schema), 2)
    assert [r.num_bikes_available for r in held.collect()] == [3]
    for n in range(3, 8):
        merge(spark.createDataFrame([(n + 1, "b", n)], schema), n)
    assert len([p for p in (folders["root"] / "live").iterdir() if p.name.startswith("batch=")]) == 3
    with pytest.raises(ValueError, match="finished"):
        read_live(spark, folders["out"])


@pytest.mark.parametrize("stream_first", [True, False])
def test_streams_and_batches_share_a_table(spark, folders, stream_first):
    f = folders
    land_polls(f, 0, 2)
    more = decode_status(read_polls(spark.read, f["landing"]), ["a"]).limit(100)
    stored = more.withColumn("id", F.col("id") + 1)
    if not stream_first:
        store_status(stored, f["table"])
    ingest(spark, f, targets=["a", "b"])
    if stream_first:
        store_status(stored, f["table"])
    assert read_status(spark, f["table"]).count() == 4 + 2
    # Nothing new: a restart adds no row; new polls add theirs.
    ingest(spark, f, targets=["a", "b"])
    land_polls(f, 2, 1)
    ingest(spark, f, targets=["a", "b"])
    assert read_status(spark, f["table"]).count() == 8
    before = rows(read_status(spark, f["table"]))
    deliver(new_points(spark, f["table"]), f["out"], f["ck3"]).awaitTermination()
    compact_status(spark, f["table"], "2023-11-14")
    compact_status(spark, f["table"], "2023-11-14")
    compact_status(spark, f["table"], "1999-01-01")
    assert rows(read_status(spark, f["table"])) == before
    day = f["root"] / "table" / "grab_date=2023-11-14"
    assert [p.name[:13] for p in day.iterdir()] == ["load=compact-"]
    store_status(stored.withColumn("id", F.col("id") + 1), f["table"])
    deliver(new_points(spark, f["table"]), f["out"], f["ck3"]).awaitTermination()
    assert spark.read.parquet(f["out"]).count() == 8 + 2


def test_a_status_batch_run_again_replaces_itself(spark, folders):
    f = folders
    land_polls(f, 0, 2)
    dated = decode_status(read_polls(spark.read, f["landing"]), ["a", "b"]).withColumn("grab_date", utc_day(F.col("grab_time")))
    for _ in range(2):
        write_load(dated, f["table"], "stream-x-0")
    write_load(dated, f["table"], "stream-x-1")
    assert read_status(spark, f["table"]).count() == 8
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        store_status(dated.drop("grab_date"), f["table"], mode="overwrite")
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert read_status(spark, f["table"]).count() == 4
