"""The empty-station alert: changes over history and from a stream."""

import os
import random
import subprocess
import sys
from decimal import Decimal

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ridemetrics.operators.alerts import alert_edges
from ridemetrics.sinks.tables import store_status
from ridemetrics.sources.tables import follow_status
from ridemetrics.schema import STATUS
from ridemetrics.streaming.alerts import _machine, alert_changes
from ridemetrics.streaming.follow import deliver

SHORT = "id decimal(38,0), station_id string, grab_time long, num_bikes_available int"


def short(spark, rows):
    return spark.createDataFrame([(i if i is None else Decimal(i), *rest) for i, *rest in rows], SHORT)


def brute(rows):
    """(station, time, on or off) by walking each station's rows in order."""
    alert, out = {}, []
    for number, station, time, bikes in sorted(rows, key=lambda r: (r[2], r[0])):
        if (bikes == 0) != alert.get(station, False):
            alert[station] = bikes == 0
            out.append((station, time, bikes == 0))
    return sorted(out)


def history(seed, stations=("a", "b", "c")):
    r = random.Random(seed)
    # Times repeat, so ids decide; some stretches are empty, some flap.
    rows = [(10**25 * i + i, r.choice(stations), 1000 + i // 2 * 7, r.choice([0, 0, 0, 5, None])) for i in range(400)]
    rows += [(10**25 * 500 + i, "flapping", 3000 + i, i % 2) for i in range(100)]
    rows += [(10**25 * 700 + i, "never", 5000 + i, 3) for i in range(20)] + [(1, "at once", 7, 0)]
    return rows


def found(df):
    return sorted((r.station_id, r.grab_time, r.is_empty) for r in df.collect())


@pytest.mark.parametrize("block", [1, 50, 86400])
def test_edges_equal_a_walk_whatever_the_blocks(spark, block):
    rows = history(1)
    r = random.Random(2)
    r.shuffle(rows)
    status = short(spark, rows).repartition(5)
    assert found(alert_edges(status, block)) == brute(rows)
    # Rows stored twice change nothing.
    assert found(alert_edges(status.unionAll(status), block)) == brute(rows)


def test_edges_of_nothing_and_of_rows_without_a_place(spark):
    assert alert_edges(short(spark, [])).count() == 0
    rows = [(None, "a", 5, 0), (1, "a", None, 0), (2, "a", 9, 0)]
    assert found(alert_edges(short(spark, rows))) == [("a", 9, True)]


def test_a_hot_station_is_spread_over_tasks(spark):
    """No window takes all rows of a station: both are partitioned by something besides."""
    status = short(spark, [(1, "a", 1, 0)])
    plan = alert_edges(status)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    assert all("block" in line or "at#" in line for line in windows)


def full(spark, rows):
    few = short(spark, rows)
    return few.select(*[
        (F.col(name) if name in few.columns else F.lit(1)).cast(kind).alias(name)
        for name, kind in (column.split() for column in STATUS.split(", "))
    ])


def run(spark, folder):
    changes = alert_changes(follow_status(spark, f"{folder}/status"))
    query = deliver(changes, f"{folder}/alerts", f"{folder}/cursor")
    query.awaitTermination()
    return query


def test_stream_equals_history_over_restarts(spark, tmp_path):
    rows = sorted(history(3), key=lambda r: (r[2], r[0]))
    told = []
    for part in (rows[:150], rows[150:160], rows[160:]):
        store_status(full(spark, part), f"{tmp_path}/status")
        query = run(spark, tmp_path)
        told.append(spark.read.parquet(f"{tmp_path}/alerts").count())
    assert found(spark.read.parquet(f"{tmp_path}/alerts")) == brute(rows)
    assert told == sorted(told) and told[-1] == len(brute(rows))
    # One row of state per station.
    assert query.lastProgress.stateOperators[0].numRowsTotal == len({r[1] for r in rows})


def test_late_and_repeated_rows_tell_nothing_new(spark, tmp_path):
    first = [(10, "a", 100, 0), (11, "b", 100, 4)]
    store_status(full(spark, first), f"{tmp_path}/status")
    run(spark, tmp_path)
    # The same rows again, an older one that would turn `a` off, a later one that does.
    store_status(full(spark, [*first, (5, "a", 50, 9)]), f"{tmp_path}/status")
    run(spark, tmp_path)
    assert found(spark.read.parquet(f"{tmp_path}/alerts")) == [("a", 100, True)]
    store_status(full(spark, [(12, "a", 100, 1)]), f"{tmp_path}/status")
    run(spark, tmp_path)
    assert found(spark.read.parquet(f"{tmp_path}/alerts")) == [("a", 100, False), ("a", 100, True)]


def test_the_state_machine_travels_to_workers_that_lack_the_package(tmp_path):
    (tmp_path / "step").write_bytes(cloudpickle.dumps(_machine()))
    script = """
import importlib.util, pickle, pandas as pd
assert importlib.util.find_spec("ridemetrics") is None
step = pickle.load(open("step", "rb"))
class State:
    exists = False
    def update(self, value): self.value = value
state = State()
batch = pd.DataFrame({"grab_time": [5, 4], "id_high": 0, "id_middle": 0, "id_low": [2, 1], "is_empty": [False, True]})
(out,) = step(("a",), [batch], state)
print(out.values.tolist(), state.value)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.strip() == "[['a', 4, True], ['a', 5, False]] (5, 0, 0, 2, False)", done.stderr
