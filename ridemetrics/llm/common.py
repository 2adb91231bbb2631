"""Shared by the operators of this folder: row keys, scratch tables, packed arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridemetrics.session import scratch_dir

#: Stands for a NULL id inside an operator; sorts before every other id.
NULL_ID = -(2**63)

#: Where NULL ids are spread, for operators that send documents to tasks by id:
#: so many numbers from NULL_ID on stand for it.
NULL_SPREAD = 1 << 40

#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 8 << 20


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *others: str) -> DataFrame:
    """Columns doc_id, row_hash, text, without NULLs; `others` as they are.

    A row's key is its id and a hash of its text, so rows that share an id but
    not a text stay apart, and whole repetitions of a row share a key.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.xxhash64(text).alias("row_hash"),
        text.alias("text"),
        *others,
    )


def spread_nulls(rows: DataFrame) -> DataFrame:
    """Keyed rows whose NULL ids differ by their text, still below all other ids."""
    own = F.lit(NULL_ID) + F.pmod("row_hash", F.lit(NULL_SPREAD))
    return rows.withColumn("doc_id", F.when(F.col("doc_id") == NULL_ID, own).otherwise(F.col("doc_id")))


def public_id(column: str = "doc_id") -> Column:
    """The id as callers know it: NULL again where it was."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias(column)


def public_spread_id(column: str = "doc_id") -> Column:
    """The same after `spread_nulls`."""
    return F.when(F.col(column) >= NULL_ID + NULL_SPREAD, F.col(column)).alias(column)


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that `df` does not use."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the cluster's shared folder and read back.

    Cuts the plan where two later steps read one result. The folder goes when
    the driver's Python ends (see scratch_dir).
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered_rows(docs: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """`docs` written out with a number of its own for each row, and that column's name.

    Rows of one task get numbers that follow each other.
    """
    (row,) = spare_names(docs, "row_number")
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), purpose), row


def utf8_slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(text_lengths(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_lengths(column: pa.Array) -> np.ndarray:
    return pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def joined_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the n + 1 offsets into it."""
    lengths = text_lengths(column)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    width = 64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else 32
    places = np.frombuffer(column.buffers()[1], np.int64 if width == 64 else np.int32)
    first = int(places[column.offset])
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(data, np.uint8)[first : first + int(offsets[-1])], offsets


def unpack(blobs: list[bytes], dtype) -> np.ndarray:
    """Arrays that travelled as bytes, end to end."""
    return np.frombuffer(b"".join(blobs), dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def run_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
