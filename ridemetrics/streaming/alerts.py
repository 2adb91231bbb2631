"""The empty-station alert as a stream: one row each time it goes on or off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ridemetrics.operators.alerts import is_empty

_ORDER = ["grab_time", "id_high", "id_middle", "id_low"]
_STATE = f"{', '.join(f'{c} long' for c in _ORDER)}, is_empty boolean"


def _machine():
    """The state machine of one station. Local to this function, so that it
    travels to workers that lack this package."""
    order = list(_ORDER)

    def step(key, batches, state):
        import numpy as np
        import pandas as pd

        rows = pd.concat([batch[[*order, "is_empty"]] for batch in batches]).to_numpy(dtype=np.int64)
        rows = rows[np.lexsort(rows.T[-2::-1])]
        seen, alert = None, 0
        if state.exists:
            *seen, alert = state.get
            later = [tuple(row) > tuple(seen) for row in rows[:, :-1].tolist()]
            rows = rows[np.array(later, bool)]
        if len(rows):
            state.update((*rows[-1, :-1].tolist(), bool(rows[-1, -1])))
        rows = rows[rows[:, -1] != np.r_[int(alert), rows[:-1, -1]]] if len(rows) else rows
        yield pd.DataFrame({"station_id": [key[0]] * len(rows), "grab_time": rows[:, 0], "is_empty": rows[:, -1] == 1})

    return step


def alert_changes(status: DataFrame) -> DataFrame:
    """Changes of each station's alert in a status stream: station_id, grab_time, is_empty.

    State is one row per station: its newest row and whether the alert is on, so
    the stream goes on where it stopped. Equal to `alert_edges` over the history
    when a station's rows come in order; a row that comes after later ones of
    its station cannot take back what was told, and is passed over, as is one
    that comes twice. Of one micro-batch a task holds five numbers per row of a
    station; `max_files` of the source bounds them.
    """
    # An id has up to 38 digits: 13, 18 and 7 of them in a whole number each.
    wide = F.col("id").cast("decimal(38,0)")
    low = wide % F.lit(10**7)
    upper = ((wide - low) / F.lit(10**7)).cast("decimal(31,0)")
    middle = upper % F.lit(10**18)
    rows = status.filter("grab_time IS NOT NULL AND id IS NOT NULL").select(
        "station_id",
        F.col("grab_time").cast("long").alias("grab_time"),
        ((upper - middle) / F.lit(10**18)).cast("long").alias("id_high"),
        middle.cast("long").alias("id_middle"),
        low.cast("long").alias("id_low"),
        is_empty().alias("is_empty"),
    )
    kind = status.schema["station_id"].dataType.simpleString()
    return rows.groupBy("station_id").applyInPandasWithState(
        _machine(),
        f"station_id {kind}, grab_time long, is_empty boolean",
        _STATE,
        "append",
        GroupStateTimeout.NoTimeout,
    )
