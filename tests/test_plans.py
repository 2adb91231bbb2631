"""Plan shapes that must hold at scale."""

import pytest
from pyspark.sql import functions as F

from ridemetrics.operators import maintenance, reports, series, stations
from ridemetrics.operators.rides import derive
from ridemetrics.plans import bridge, catalog
from ridemetrics.schema import STATUS
from ridemetrics.sinks.tables import store_rides, store_status
from ridemetrics.sources.rides import file_headers
from ridemetrics.sources.tables import read_status

SF_DIR = "/root/testdata/sf0.001"
THROUGH_FILES = {"stream_status", "stream_latest_status", "stream_new_points", "csv_rides", "published_counts", "csv_mixed_layouts", "status_mixed_writes", "feed_status", "feed_refused", "feed_stations", "first_load", "published_reports", "published_fallback", "cursor_series",
                 "published_corrupt", "published_whole", "stream_station_alerts", "stream_points_once", "latest_incremental", "live_state", "ingest_restarted", "feed_stamps"}


@pytest.fixture
def plan(capsys):
    def formatted(df):
        capsys.readouterr()
        df.explain("formatted")
        return capsys.readouterr().out

    return formatted


@pytest.fixture(scope="module")
def stored_rides(spark, tmp_path_factory):
    rides = catalog.rides(spark, SF_DIR).withColumns({"started_at": F.col("started_ts"), "ended_at": F.col("ended_ts")})
    return store_rides(derive(rides), str(tmp_path_factory.mktemp("rides") / "t"))


@pytest.fixture(scope="module")
def stored_status(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("status") / "t")
    types = [c.split() for c in STATUS.split(", ")]
    status = bridge.status_from_events(bridge.table(spark, SF_DIR, "events"))
    store_status(status.select(*[F.col(n).cast(t).alias(n) for n, t in types]), path)
    return read_status(spark, path)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - THROUGH_FILES))
def test_no_cross_join_and_no_python(spark, plan, name):
    text = plan(catalog.QUERIES[name](spark, SF_DIR))
    for operator in ["CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"]:
        assert operator not in text


@pytest.mark.parametrize(
    "name, columns",
    [
        ("rides_by_member_type", "member_casual:string"),
        ("rides_by_rideable_type", "rideable_type:string"),
        ("top_start_stations", "start_station_name:string"),
        ("hourly_distribution", "started_ts:timestamp_ntz"),
        ("duration_stats", "ride_duration_minutes:double"),
    ],
)
def test_reports_read_only_their_columns(stored_rides, plan, name, columns):
    text = plan(reports.all_reports(stored_rides)[name])
    assert f"ReadSchema: struct<{columns}>" in text


def test_distinct_ids_travel_alone(stored_rides, plan):
    text = plan(reports.overview(stored_rides))
    assert "ReadSchema: struct<ride_id:bigint>" in text
    assert "ReadSchema: struct<started_ts:timestamp_ntz,ended_ts:timestamp_ntz>" in text


def test_top_stations_need_no_full_sort(stored_rides, plan):
    text = plan(reports.top_start_stations(stored_rides))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
    assert "partial_count" in text


def test_duration_histogram_is_scanned_once(stored_rides):
    stats = reports.duration_stats(stored_rides)
    stats.collect()
    final = str(stats._jdf.queryExecution().executedPlan()).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_latest_rows_hash_aggregate_one_scan(stored_status, plan):
    text = plan(stations.latest_rows(stored_status))
    assert "HashAggregate" in text and "SortAggregate" not in text and "Sort " not in text
    assert text.count("\n(1) Scan parquet") == 1 and "(2) Scan" not in text
    assert "partial_max_by" in text


def test_one_station_reaches_the_scan(stored_status, plan):
    text = plan(series.bike_series(stored_status, "7", since=1704153600))
    assert "EqualTo(station_id,7)" in text and "GreaterThan(grab_time,1704153600)" in text
    assert "ReadSchema: struct<station_id:string,num_bikes_available:int,grab_time:bigint>" in text


def test_literal_ids_cut_the_fact_table_before_aggregation(stored_status, spark, plan):
    places = catalog.station(spark, SF_DIR).withColumn("station_id", F.col("station_id").cast("string"))
    text = plan(stations.station_latest(["3", "4"], places, stored_status))
    assert "In(station_id, [3,4])" in text


def test_relation_of_ids_never_shuffles_the_fact_table(spark, stored_status, plan):
    places = catalog.station(spark, SF_DIR).withColumn("station_id", F.col("station_id").cast("string"))
    ids = places.select("station_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(stations.station_latest(ids, places, stored_status))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # In the tree the status scan has its partial aggregation for a parent,
    # before any exchange.
    tree = [line.lstrip(" :+-*").split(" (")[0] for line in text.splitlines() if "+- " in line or ":- " in line]
    below_last_exchange = tree[len(tree) - 1 - tree[::-1].index("Exchange") :]
    assert below_last_exchange[1] == "HashAggregate" and "Join" not in " ".join(below_last_exchange)
    assert "partial_max_by" in text and "LeftSemi" not in text


@pytest.fixture
def shuffled_joins(spark):
    """No broadcasts, and every uneven partition counts as skewed."""
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "100KB",
    }
    for key, value in options.items():
        spark.conf.set(key, value)
    yield
    for key in options:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("kind", ["cursors", "targets"])
def test_hot_station_is_split_when_nothing_is_broadcast(spark, tmp_path, shuffled_joins, kind):
    path = str(tmp_path / "hot")
    rows = spark.range(60_000, numPartitions=6).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 500).cast("string").alias("station_id"),
        F.col("id").alias("grab_time"),
        F.xxhash64("id").cast("string").alias("note"),
        (F.col("id") % 20).cast("int").alias("num_bikes_available"),
    )
    rows.write.parquet(path)
    status = spark.read.parquet(path)
    dimension = spark.range(400).select(F.col("id").cast("string").alias("station_id"), F.lit(30_000).alias("last_time"))
    if kind == "cursors":
        got = series.after_cursor(status, dimension)
        want = rows.filter((F.col("grab_time") > 30_000) | (F.col("station_id").cast("long") >= 400)).count()
    else:
        got = stations.only_stations(status, dimension)
        want = rows.filter(F.col("station_id").cast("long") < 400).count()
    got = got.select("station_id", "note")
    assert len(got.collect()) == want
    final = got._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in final


def test_upsert_hashes_narrow_keys_and_reads_text_once(spark, tmp_path, plan):
    feed = bridge.station_updates_from_orders(bridge.table(spark, SF_DIR, "orders"))
    feed.write.parquet(str(tmp_path / "feed"))
    feed = spark.read.parquet(str(tmp_path / "feed"))
    text = plan(maintenance.upsert(catalog.station(spark, SF_DIR), feed, order="seq"))
    assert "SortAggregate" not in text and "partial_max(seq" in text
    # The feed's text is read by one scan; the others read keys alone.
    schemas = [line for line in text.splitlines() if "ReadSchema" in line and "seq:" in line or "ReadSchema: struct<station_id:bigint>" in line]
    assert sum("name:string" in line for line in schemas) == 1


def test_known_cursors_skip_older_days(spark, stored_status, plan):
    cursors = spark.createDataFrame([("1", 1704153600), ("2", 1704240000)], "station_id string, last_time long")
    got = series.bike_series(stored_status, since=cursors, ordered=False, known_only=True)
    text = plan(got)
    filters = [line for line in text.splitlines() if "PartitionFilters" in line and "grab_date" in line]
    assert filters and "subquery" in filters[0].lower()
    want = series.bike_series(stored_status, ids=["1", "2"], since=cursors, ordered=False)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_each_consumer_gets_its_rows(spark, stored_status):
    rows = [("x", "1", 1704153600), ("y", "1", 0), ("y", "2", 1704240000)]
    cursors = spark.createDataFrame(rows, "consumer_id string, station_id string, last_time long")
    got = series.bike_series(stored_status, ids=["1", "2"], since=cursors, ordered=False)
    assert got.columns == ["consumer_id", "station_id", "ts_ms", "value"]
    one = series.bike_series(stored_status, "1", since=1704153600).count()
    everything = series.bike_series(stored_status, "1").count()
    counts = {(r.consumer_id, r.station_id): r["count"] for r in got.groupBy("consumer_id", "station_id").count().collect()}
    assert counts[("x", "1")] == one and counts[("y", "1")] == everything


def test_headers_come_without_python_and_without_a_sort(spark, plan, tmp_path):
    (tmp_path / "a.csv").write_text("ride_id,started_at,ended_at\nr1,x,y\n")
    text = plan(file_headers(spark, str(tmp_path)))
    assert "ObjectHashAggregate" in text and "Scan text" in text
    for operator in ["Python", "Pandas", "Arrow", "SortAggregate"]:
        assert operator not in text
    for name in ("csv_mixed_layouts", "csv_rides"):
        text = plan(catalog.QUERIES[name](spark, SF_DIR))
        assert not any(operator in text for operator in ["Python", "Pandas", "InArrow"])
