import datetime as dt
import gzip

import pytest

from ridemetrics.operators.rides import derive, valid_rides
from ridemetrics.sources.rides import check_uri, file_headers, header_columns, read_rides

HEADER = "ride_id,rideable_type,started_at,ended_at,start_station_name,start_station_id,end_station_name,end_station_id,start_lat,start_lng,end_lat,end_lng,member_casual"


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def ids(df):
    return sorted(row.ride_id for row in df.select("ride_id").collect())


def test_types_and_text_station_ids(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        HEADER,
        "r1,bike,2026-03-01 00:00:00.500,2026-03-01 00:10:00.250,A,0012.10,B,7,40.5,-73.9,x,,member",
    )
    rides = derive(read_rides(spark, path))
    types = dict(rides.dtypes)
    assert types["start_lat"] == types["end_lng"] == "double"
    assert types["start_station_id"] == "string"
    assert types["started_ts"] == "timestamp"
    row = rides.first()
    assert row.start_station_id == "0012.10"
    assert row.end_lat is None and row.end_lng is None
    assert row.ride_duration_minutes == 10.0


def test_folder_is_searched_for_csv_of_any_case(spark, tmp_path):
    write(tmp_path / "a.csv", HEADER, "r1" + "," * 12)
    write(tmp_path / "deep" / "er" / "b.CSV", HEADER, "r2" + "," * 12)
    write(tmp_path / "notes.txt", "not a ride")
    assert ids(read_rides(spark, str(tmp_path))) == ["r1", "r2"]
    assert ids(read_rides(spark, f"file:{tmp_path}")) == ["r1", "r2"]
    assert ids(read_rides(spark, str(tmp_path), mixed_headers=False)) == ["r1", "r2"]


def test_glob_and_single_file(spark, tmp_path):
    one = write(tmp_path / "202603_1.csv", HEADER, "r1" + "," * 12)
    write(tmp_path / "202603_2.csv", HEADER, "r2" + "," * 12)
    write(tmp_path / "202604_1.csv", HEADER, "r3" + "," * 12)
    assert ids(read_rides(spark, f"{tmp_path}/202603_*.csv")) == ["r1", "r2"]
    assert ids(read_rides(spark, one)) == ["r1"]


def test_mixed_headers_are_bound_by_name(spark, tmp_path):
    write(tmp_path / "a b[1].csv", "ride_id,started_at,ended_at,start_lat", "r1,2026-03-01 00:00:00,2026-03-01 00:01:00,1.5")
    write(tmp_path / "b.csv", "End Time,Start Time,Ride ID,member_casual", "2026-03-01 00:03:00,2026-03-01 00:01:00,r2,casual")
    write(tmp_path / "c.csv", "ended_at,started_at,ride_id,member_casual", "2026-03-01 00:05:00,2026-03-01 00:01:00,r3,member")
    rows = {r.ride_id: r for r in derive(read_rides(spark, str(tmp_path))).collect()}
    assert {k: r.ride_duration_minutes for k, r in rows.items()} == {"r1": 1.0, "r2": 2.0, "r3": 4.0}
    assert rows["r1"].start_lat == 1.5 and rows["r2"].start_lat is None
    assert rows["r2"].member_casual == "casual" and rows["r1"].member_casual is None


def test_uniform_read_fails_on_a_different_header(spark, tmp_path):
    write(tmp_path / "a.csv", "ride_id,started_at,ended_at", "r1,x,y")
    write(tmp_path / "b.csv", "ended_at,started_at,ride_id", "x,y,r2")
    with pytest.raises(Exception, match="header"):
        read_rides(spark, str(tmp_path), mixed_headers=False).collect()


def test_header_probe_skips_blank_lines_marks_and_compression(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeff\n\nride_id,x\n1,2\n".encode())
    (tmp_path / "blank.csv").write_bytes(b"\n\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write("ride_id,y\r\n1,2\r\n")
    got = {r.path.rsplit("/", 1)[1]: r.header for r in file_headers(spark, f"{tmp_path}/*.csv*").collect()}
    assert got == {"a.csv": "ride_id,x", "blank.csv": None, "b.csv.gz": "ride_id,y"}


def test_header_cells_follow_the_csv_reader(spark, tmp_path):
    line = 'a,,"b, c",A,d'
    path = write(tmp_path / "x.csv", line, "1,2,3,4,5")
    assert header_columns(line) == ["a0", "_c1", "b, c", "A3", "d"]
    assert spark.read.option("header", True).csv(path).columns == header_columns(line)


def test_no_files(spark, tmp_path):
    write(tmp_path / "notes.txt", "nothing")
    with pytest.raises(ValueError, match="No CSV files"):
        read_rides(spark, str(tmp_path))


def test_missing_required_column(spark, tmp_path):
    path = write(tmp_path / "a.csv", "ride_id,started_at", "r1,x")
    with pytest.raises(ValueError, match="ended_at"):
        read_rides(spark, path)


@pytest.mark.parametrize("uri", ["s3://", "s3:///key", "S3A:///key"])
def test_store_uri_needs_a_bucket(uri):
    with pytest.raises(ValueError):
        check_uri(uri)


def test_store_uri_passes():
    assert check_uri("s3://bucket/key") == "s3://bucket/key"


def test_times_and_valid_durations(spark):
    rides = derive(
        spark.createDataFrame(
            [
                ("zero", "2026-03-01 00:00:10.900", "2026-03-01 00:00:10.200"),
                ("back", "2026-03-01 00:01:00", "2026-03-01 00:00:00"),
                ("bad", "6/1/2013 00:00:01", "2026-03-01 00:00:00"),
                ("null", None, "2026-03-01 00:00:00"),
                ("ok", "2026-03-01T00:00:00Z", "2026-03-01 00:01:30"),
            ],
            "ride_id string, started_at string, ended_at string",
        )
    )
    minutes = {r.ride_id: r.ride_duration_minutes for r in rides.collect()}
    assert minutes == {"zero": 0.0, "back": -1.0, "bad": None, "null": None, "ok": 1.5}
    assert ids(valid_rides(rides)) == ["ok", "zero"]


def test_typed_times_keep_their_type(spark):
    rows = [("a", dt.datetime(2026, 3, 1), dt.datetime(2026, 3, 1, 0, 2))]
    rides = derive(spark.createDataFrame(rows, "ride_id string, started_at timestamp_ntz, ended_at timestamp_ntz"))
    assert dict(rides.dtypes)["started_ts"] == "timestamp_ntz"
    assert rides.first().ride_duration_minutes == 2.0


def test_dotted_folders_hold_rides_only(spark, tmp_path):
    write(tmp_path / "v1.2" / "a.csv", HEADER, "r1" + "," * 12)
    write(tmp_path / "v1.2" / "notes.txt", "not a ride", "nor this")
    assert ids(read_rides(spark, f"{tmp_path}/v1.2")) == ["r1"]
    write(tmp_path / "rides.txt", HEADER, "r2" + "," * 12)
    assert ids(read_rides(spark, f"{tmp_path}/rides.txt")) == ["r2"]


def test_foreign_layout_is_refused_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", HEADER, "r1" + "," * 12)
    write(tmp_path / "stations.csv", "station_id,name", "1,A", "2,B")
    with pytest.raises(ValueError, match="stations.csv.*ride_id"):
        read_rides(spark, str(tmp_path))


def test_compressed_files_of_a_folder(spark, tmp_path):
    write(tmp_path / "a.csv", HEADER, "r1" + "," * 12)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as out:
        out.write("ended_at,started_at,ride_id\nx,y,r2\n")
    assert ids(read_rides(spark, str(tmp_path))) == ["r1", "r2"]


def test_mixed_layouts_keep_rows_that_look_like_headers(spark, tmp_path):
    write(tmp_path / "a.csv", "ride_id,started_at,ended_at", "ride_id,started_at,ended_at", 'r1,"x, y",z')
    write(tmp_path / "sub" / "b.csv", "", "Ended At,ride id,start_time,member_casual", "e,r2,s,casual,extra", "e2,r3")
    (tmp_path / "empty.csv").write_text("")
    got = {r.ride_id: (r.started_at, r.ended_at, r.member_casual) for r in read_rides(spark, str(tmp_path)).collect()}
    assert got == {
        "ride_id": ("started_at", "ended_at", None),
        "r1": ("x, y", "z", None),
        "r2": ("s", "e", "casual"),
        "r3": (None, "e2", None),
    }
