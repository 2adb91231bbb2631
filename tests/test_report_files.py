import os
import shutil
import time

import pytest

from ridemetrics.plans.ride_analysis import analyze, main
from ridemetrics.schema import REPORT_COLUMNS
from ridemetrics.sinks.reports import publish_reports, write_report, write_reports
from ridemetrics.sources.reports import freshest, read_report, read_reports
from tests.test_ride_csv import HEADER, write


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("job")
    write(
        base / "in" / "march.csv",
        HEADER,
        "r1,classic_bike,2026-03-01 08:00:00.769,2026-03-01 08:10:00.500,A,1,B,2,1,2,3,4,member",
        "r2,electric_bike,2026-03-01 09:00:00,2026-03-01 09:30:00,A,1,,,1,2,,,casual",
        "r3,electric_bike,2026-03-01 09:00:00,2026-03-01 08:30:00,,,B,2,,,3,4,casual",
    )
    write(
        base / "in" / "old" / "2013.csv",
        "member_or_casual_ride,start_time,end_time,ride_id,from_station_name",
        "member,2026-03-02 08:00:00,2026-03-02 08:01:00,r4,A",
    )
    out = f"{base}/out"
    analyze(spark, f"{base}/in", out, stage=f"{base}/stage")
    return out


def text(df):
    return [tuple(r) for r in df.collect()]


def test_one_headed_csv_per_report(published):
    for name, ddl in REPORT_COLUMNS.items():
        parts = [f for f in os.listdir(f"{published}/{name}") if f.endswith(".csv")]
        assert len(parts) == 1
        with open(f"{published}/{name}/{parts[0]}") as f:
            assert f.readline().strip() == ",".join(c.split()[0] for c in ddl.split(", "))


def test_report_values_as_text(spark, published):
    tables = read_reports(spark, [published]).tables
    assert list(tables) == list(REPORT_COLUMNS)
    assert text(tables["overview"]) == [("4", "4", "2026-03-01T08:00:00.769Z", "2026-03-02T08:01:00.000Z")]
    assert text(tables["duration_stats"]) == [("13.67", "10.0", "30.0")]
    assert text(tables["rides_by_member_type"]) == [("casual", "2"), ("member", "2")]
    assert text(tables["rides_by_rideable_type"]) == [("electric_bike", "2"), (None, "1"), ("classic_bike", "1")]
    assert text(tables["top_start_stations"]) == [("A", "3")]
    assert text(tables["hourly_distribution"]) == [("8", "2"), ("9", "2")]
    assert text(tables["data_quality"]) == [("1", "2", "2", "2")]


def test_unstaged_run_gives_the_same(spark, published, tmp_path, monkeypatch):
    monkeypatch.setattr("ridemetrics.plans.ride_analysis.shared_dir", lambda spark: None)
    source = f"{published}/../in"
    analyze(spark, source, str(tmp_path / "out"))
    a, b = (read_reports(spark, [p]).tables for p in (published, str(tmp_path / "out")))
    assert {n: text(t) for n, t in a.items()} == {n: text(t) for n, t in b.items()}


def test_command_line(spark, published, tmp_path):
    main(["--input", f"{published}/../in/march.csv", "--output", f"file:{tmp_path}/out", "--uniform-headers"])
    assert text(read_report(spark, f"{tmp_path}/out", "overview"))[0][0] == "3"


def test_absent_and_empty_reports(spark, tmp_path):
    table = read_report(spark, str(tmp_path), "hourly_distribution")
    assert table.columns == ["hour_of_day", "rides"] and table.count() == 0
    write_report(spark.createDataFrame([], "member_casual string, rides long"), f"{tmp_path}/rides_by_member_type")
    table = read_report(spark, str(tmp_path), "rides_by_member_type")
    assert table.columns == ["member_casual", "rides"] and table.count() == 0


def test_every_part_is_read_and_overwrite_replaces(spark, tmp_path):
    path = f"{tmp_path}/hourly_distribution"
    write_report(spark.range(8).repartition(4), path, single_file=False)
    assert read_report(spark, str(tmp_path), "hourly_distribution").count() == 8
    write_report(spark.range(3), path)
    assert read_report(spark, str(tmp_path), "hourly_distribution").count() == 3


def test_freshest_candidate(spark, tmp_path):
    for name in ["one", "two"]:
        write_reports({"overview": spark.range(1)}, f"{tmp_path}/{name}")
    past = time.time() - 1000
    for folder, _, files in os.walk(tmp_path / "two"):
        for f in files:
            os.utime(os.path.join(folder, f), (past, past))
    assert freshest(spark, [f"{tmp_path}/none", f"{tmp_path}/two", f"{tmp_path}/one"]) == f"{tmp_path}/one"
    assert freshest(spark, [f"{tmp_path}/none"]) is None


def test_store_first_then_candidates(spark, published, tmp_path):
    got = read_reports(spark, [str(tmp_path)], store_uri=f"file:{published}")
    assert got.available and got.output_dir == f"file:{published}"
    got = read_reports(spark, [published], store_uri="s3:///no-bucket")
    assert got.available and got.output_dir == published and "ValueError" in got.message
    got = read_reports(spark, [f"{tmp_path}/none"])
    assert not got.available and got.output_dir is None and got.tables == {}


def test_no_copy_of_the_rides_is_left(spark, published, tmp_path):
    source = f"{published}/../in"
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(f"{shared}/ridemetrics")) if os.path.isdir(f"{shared}/ridemetrics") else set()
    analyze(spark, source, str(tmp_path / "out"))
    after = set(os.listdir(f"{shared}/ridemetrics")) if os.path.isdir(f"{shared}/ridemetrics") else set()
    assert before == after
    assert sorted(os.listdir(tmp_path / "out")) == sorted(REPORT_COLUMNS)


def test_output_and_stage_may_not_hold_the_input(spark, published, tmp_path):
    source = f"{published}/../in"
    for target in (source, f"{source}/..", "/"):
        with pytest.raises(ValueError, match="overwrite the input"):
            analyze(spark, source, target)
        with pytest.raises(ValueError, match="overwrite the input"):
            analyze(spark, f"{source}/*.csv", str(tmp_path / "o"), stage=target)


def test_a_programming_error_is_no_unreachable_store(spark, published, monkeypatch):
    def broken(*_):
        raise TypeError("a bug")

    monkeypatch.setattr("ridemetrics.sources.reports.read_report", broken)
    with pytest.raises(TypeError):
        read_reports(spark, [published], store_uri=f"file:{published}")


def test_a_report_that_cannot_be_read_to_its_end_falls_back(spark, published, tmp_path):
    for damage in ("gzip", "checksum"):
        store = tmp_path / damage
        shutil.copytree(published, store)
        part = next(p for p in (store / "top_end_stations").iterdir() if p.suffix == ".csv")
        if damage == "gzip":
            part.rename(part.with_name(part.name + ".gz"))
        else:
            part.write_bytes(part.read_bytes()[:-3] + b"zzz")  # its .crc file tells
        got = read_reports(spark, [published], store_uri=f"file:{store}")
        assert got.available and got.output_dir == published and "Object store failed" in got.message
        assert text(got.tables["overview"])[0][0] == "4"
        # Without a set to fall back to there is none.
        assert not read_reports(spark, [], store_uri=f"file:{store}").available


def test_a_failing_report_leaves_the_old_set(spark, tmp_path):
    base = str(tmp_path / "sets")
    frame = lambda n: spark.createDataFrame([(str(n),)], "rides string")
    names = list(REPORT_COLUMNS)
    publish_reports({name: frame(1) for name in names}, base)
    held = read_reports(spark, [base])
    bad = {name: frame(2) for name in names}
    bad[names[4]] = spark.range(3).selectExpr("cast(raise_error('fifth') as string) AS rides")
    with pytest.raises(Exception, match="fifth"):
        publish_reports(bad, base)
    for got in (held, read_reports(spark, [base])):
        assert {name: text(table) for name, table in got.tables.items()} == {name: [("1",)] for name in names}
    publish_reports({name: frame(3) for name in names}, base)
    assert text(read_reports(spark, [], store_uri=f"file:{base}").tables[names[4]]) == [("3",)]
    # The set before the newest stays for those who read it; the broken one is gone.
    assert text(held.tables[names[0]]) == [("1",)]
    assert sorted(n for n in os.listdir(base)) == ["generation=1", "generation=3"]
    assert freshest(spark, [base]) == base


def test_job_publishes_a_whole_set(spark, published, tmp_path):
    out = str(tmp_path / "out")
    main(["--input", f"{published}/../in", "--output", out, "--whole-set"])
    assert os.listdir(out) == ["generation=1"]
    a, b = (read_reports(spark, [p]).tables for p in (published, out))
    assert {n: text(t) for n, t in a.items()} == {n: text(t) for n, t in b.items()}
