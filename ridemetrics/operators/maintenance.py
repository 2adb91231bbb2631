"""Table maintenance expressed as DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemetrics.schema import STATUS_ADDED


def last_per_key(rows: DataFrame, order: str, key: str = "station_id") -> DataFrame:
    """The last row of each key in `order`, without the ordering column.

    The winning order is found first, over two narrow columns in a hash
    aggregation that combines on the map side; text would turn it into a sort of
    the whole feed. Only winners then meet their rows. Orders must not repeat
    within a key.
    """
    last = rows.groupBy(key).agg(F.max(order).alias(order))
    return rows.join(last, [key, order], "left_semi").drop(order)


def upsert(
    stored: DataFrame, incoming: DataFrame, key: str = "station_id", order: str | None = None
) -> DataFrame:
    """`stored` with the rows of `incoming` inserted or put in place of their key.

    With `order`, `incoming` may repeat a key and its last row wins. Without
    it, keys in `incoming` must be unique. The keys alone decide which stored rows
    stay, so no text is read for that.
    """
    fresh = last_per_key(incoming, order, key) if order else incoming
    return fresh.unionByName(stored.join(incoming.select(key).distinct(), key, "left_anti"))


def needs_loading(stored: DataFrame, wanted: int) -> bool:
    """True while fewer than `wanted` rows are stored; reads no more than that."""
    return stored.limit(wanted).count() < wanted


def add_missing_columns(status: DataFrame, columns: dict[str, str] = STATUS_ADDED) -> DataFrame:
    """Old status rows under the current schema; new columns are NULL."""
    absent = {n: F.lit(None).cast(t) for n, t in columns.items() if n not in status.columns}
    return status.withColumns(absent) if absent else status


def union_status(older: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of both generations of the table, in the current column order."""
    return current.unionByName(add_missing_columns(older))
