"""Each row once to a consumer, newest rows without a full scan, state without a copy."""

import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ridemetrics.functions.expressions import utc_day
from ridemetrics.operators.stations import latest_rows
from ridemetrics.plans import streamed
from ridemetrics.schema import STATUS_PARTITION
from ridemetrics.sinks.latest import latest_so_far, refresh_latest
from ridemetrics.sinks.tables import compact_status, store_status, write_load
from ridemetrics.sources import generations
from ridemetrics.sources.feeds import POLL_ROWS, decode_status, insertion_id, read_polls
from ridemetrics.sources.tables import follow_status, list_loads, read_loads, read_status
from ridemetrics.streaming.follow import deliver, each_once, new_points
from ridemetrics.streaming.ingest import ingest_status, landed_polls, load_writer
from ridemetrics.streaming.live import keep_latest, keep_latest_state, read_latest_state, read_live
from tests.test_alerts import full
from tests.test_feeds import land, station
from tests.test_streaming import folders, ingest, land_polls, rows  # noqa: F401


def stop_between_write_and_commit(spark, f, batch=0, **options):
    write = load_writer(spark, f["table"], f["ck1"])

    def stop(batch_rows, batch_id):
        write(batch_rows, batch_id)
        if batch_id >= batch:
            raise InterruptedError("between write and commit")

    polls = decode_status(landed_polls(spark, f["landing"], **options), ["a", "b"])
    writer = polls.writeStream.option("checkpointLocation", f["ck1"]).foreachBatch(stop)
    with pytest.raises(StreamingQueryException, match="between write and commit"):
        writer.trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("within", ["1 day", None])
def test_a_load_written_again_reaches_a_follower_once(spark, folders, within):  # noqa: F811
    f = folders
    land_polls(f, 0, 3)
    stop_between_write_and_commit(spark, f)
    points = [new_points(spark, f["table"], ids="b", within=within) for _ in range(2)]
    deliver(points[0], f["out"], f["ck3"]).awaitTermination()
    assert spark.read.parquet(f["out"]).count() == 3
    land_polls(f, 3, 1)
    ingest(spark, f, targets=["a", "b"])
    assert read_status(spark, f["table"]).filter("station_id = 'b'").count() == 4
    deliver(points[1], f["out"], f["ck3"]).awaitTermination()
    # Without the memory the rows of the load come a second time.
    assert spark.read.parquet(f["out"]).count() == (4 if within else 7)
    if within:
        assert spark.read.parquet(f["out"]).distinct().count() == 4


def test_what_a_consumer_remembers_is_bounded(spark, tmp_path):
    table = f"{tmp_path}/status"
    held = []
    for step in range(3):
        # Old times, older with every step: none of them is late.
        new = [(100 * step + i, "a", 5000 - 1000 * step + i, i) for i in range(50)]
        store_status(full(spark, new), table)
        query = deliver(each_once(follow_status(spark, table), "1 second"), f"{tmp_path}/out", f"{tmp_path}/ck")
        query.awaitTermination()
        held.append([p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators])
        time.sleep(2)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 150
    # What was read is forgotten in time: the state never holds all 150 rows at the end.
    assert max(max(h) for h in held) <= 100 and held[-1][-1] <= 50


def test_ingest_of_a_few_files_at_a_time_with_a_stop_equals_one_batch(spark, folders):  # noqa: F811
    f = folders
    land_polls(f, 0, 7)
    stop_between_write_and_commit(spark, f, batch=1, max_files=2)
    assert read_status(spark, f["table"]).count() == 8
    ingest(spark, f, targets=["a", "b"], max_files=2)
    batch = decode_status(read_polls(spark.read, f["landing"]), ["a", "b"])
    assert rows(read_status(spark, f["table"]), "grab_date") == rows(batch)
    # Four loads of two, two, two and one document.
    loads = read_status(spark, f["table"]).select(F.count("*"), F.countDistinct("grab_time")).first()
    assert tuple(loads) == (14, 7)
    assert list_loads(spark, f["table"]).select("load").distinct().count() == 4


def test_many_landed_documents_make_no_more_batches(spark, tmp_path, monkeypatch):
    # Documents of one row each.
    times = F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit("2024-01-02").cast("timestamp_ntz")).alias("ts")
    ids = spark.range(110).select((F.col("id") * 2000).alias("event_id"), (F.col("id") % 9).alias("user_id"), times)
    events = ids.withColumns({"event_type": F.lit("view"), "value": F.lit(1.0), "props": F.lit('{"k": 3}')})
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streamed, "scratch_dir", lambda spark, purpose: f"{tmp_path}/{purpose}")
    assert streamed.ingest_restarted(spark, str(tmp_path)).count() == 110
    loads = list_loads(spark, f"{tmp_path}/restarted/status").select("load").distinct().count()
    assert 2 < loads <= streamed.MOST_BATCHES


def polls(first, count, day=0):
    return [(1000 * day + i, s, 86400 * day + 60 * i, (i * 7 + len(s)) % 5) for i in range(first, first + count) for s in ("a", "bb")]


def newest(spark, table):
    return rows(latest_rows(read_status(spark, table).drop(STATUS_PARTITION)))


def test_latest_so_far_reads_only_loads_after_the_snapshot(spark, tmp_path):
    table, root = f"{tmp_path}/status", f"{tmp_path}/latest"

    def check(want=None):
        got = latest_so_far(spark, table, root)
        assert rows(got.select(latest_rows(read_loads(spark, table)).columns)) == (want or newest(spark, table))
        return got._jdf.queryExecution().executedPlan().toString()

    for day in range(1, 5):
        store_status(full(spark, polls(0, 6, day)), table)
    check()  # no snapshot yet: all days
    refresh_latest(spark, table, root)
    assert "/status" not in check()
    # A load on a new day, and one that comes late to an old day and holds nothing newer.
    old = {p for p in tmp_path.glob("status/*/*/part-*")}
    store_status(full(spark, polls(0, 2, 6)), table)
    store_status(full(spark, polls(6, 2, 2)), table)
    assert "PartitionFilters: [grab_date" in check()
    # Nothing else is opened: what the snapshot holds may be unreadable by now.
    want = newest(spark, table)
    kept = {p: p.read_bytes() for p in old}
    for p in old:
        p.write_bytes(b"not parquet")
    check(want)
    for p, content in kept.items():
        p.write_bytes(content)
        p.with_name(f".{p.name}.crc").unlink()
    refresh_latest(spark, table, root)
    assert "/status" not in check()
    # A compacted day counts as new once.
    compact_status(spark, table, "1970-01-05")
    assert "/status" in check()
    refresh_latest(spark, table, root)
    assert "/status" not in check()


def test_a_refresh_that_fails_leaves_the_snapshot(spark, tmp_path):
    table, root = f"{tmp_path}/status", f"{tmp_path}/latest"
    store_status(full(spark, polls(0, 3, 1)), table)
    refresh_latest(spark, table, root)
    store_status(full(spark, polls(3, 3, 1)), table)
    # Cut off after its rows: no mark.
    refresh_latest(spark, table, root)
    os.remove(f"{generations.newest(spark, root)}/_FINISHED")
    assert generations.newest(spark, root).endswith("generation=1")
    assert rows(latest_so_far(spark, table, root)) == rows(latest_rows(read_loads(spark, table)).select(latest_so_far(spark, table, root).columns))
    for _ in range(4):
        refresh_latest(spark, table, root)
    assert sorted(n for n in os.listdir(root)) == ["generation=4", "generation=5", "generation=6"]


def test_live_state_equals_the_live_table_and_is_the_only_copy(spark, folders):  # noqa: F811
    f = folders
    for step in range(2):
        land_polls(f, step * 2, 2)
        ingest(spark, f, targets=None)
        keep_latest(follow_status(spark, f["table"]), f["live"], f["ck2"], interval=None).awaitTermination()
        keep_latest_state(follow_status(spark, f["table"]), f"{f['root']}/state", interval=None).awaitTermination()
        live = read_live(spark, f["live"])
        state = read_latest_state(spark, f"{f['root']}/state")
        assert rows(state.select(live.columns)) == rows(live)
        assert dict(state.dtypes) == dict(live.dtypes)
    # Only the checkpoint was written.
    assert {p.name for p in (f["root"] / "state").iterdir() if p.is_dir()} == {"commits", "offsets", "sources", "state"}


def test_loads_that_were_written_again_and_plain_ones_are_listed(spark, tmp_path):
    table = f"{tmp_path}/status"
    dated = full(spark, polls(0, 2, 1) + polls(0, 2, 2)).withColumn(STATUS_PARTITION, utc_day(F.col("grab_time")))
    for _ in range(2):
        write_load(dated, table, "stream-x-0")
    write_load(dated, table, "7")  # a name that looks like a number stays text
    got = sorted((str(r.grab_date), r.load) for r in list_loads(spark, table).collect())
    assert got == [(d, n) for d in ("1970-01-02", "1970-01-03") for n in ("7", "stream-x-0")]
    assert read_loads(spark, table, [(dated.first().grab_date, "7")]).count() == 4
    assert read_loads(spark, table).count() == 16


def test_ids_number_polls_and_places(spark, tmp_path):
    a = land(tmp_path, "a.json", [station("x"), station("y")], arrived=1700000000.125)
    land(tmp_path, "b.json", [station("x")], arrived=1700000000.125)
    got = decode_status(read_polls(spark.read, str(tmp_path))).collect()
    ids = [int(r.id) for r in got]
    assert len(set(ids)) == 3 and {i // 10**25 for i in ids} == {1700000000125}
    assert sorted(i % POLL_ROWS for i in ids) == [0, 0, 1]
    # The same when read again, whatever else lies there.
    again = decode_status(read_polls(spark.read, str(a))).collect()
    assert {int(r.id) for r in again} <= set(ids)
    widest = spark.createDataFrame([("p", 9_999_999_999_999, POLL_ROWS - 1)], "poll_id string, arrived_ms long, seq int")
    assert widest.select(insertion_id()).first()[0] < 10**38
    over = spark.createDataFrame([("p", 1, POLL_ROWS)], "poll_id string, arrived_ms long, seq int")
    with pytest.raises(Exception, match="More stations than an id can number"):
        over.select(insertion_id()).collect()
