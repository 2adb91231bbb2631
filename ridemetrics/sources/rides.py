"""Ride CSV reader for a file, a glob, a folder or an object-store prefix."""

from __future__ import annotations

import csv
import re
from collections import Counter
from urllib.parse import urlparse

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridemetrics.functions.headers import align_columns, aligned_names, missing_columns, require_columns
from ridemetrics.schema import RIDE_COORDINATES
from ridemetrics.sources import files

CSV_GLOB = "*.[cC][sS][vV]{,.gz,.bz2,.zst}"
CSV_NAME = re.compile(r"\.csv(\.(gz|bz2|zst))?$", re.IGNORECASE)

# Distinct header lines that one set of ride files may have.
MOST_LAYOUTS = 1000


def check_uri(path: str) -> str:
    """`path` unchanged; an object-store URI must name a bucket."""
    parsed = urlparse(path)
    if parsed.scheme.lower() in ("s3", "s3a") and not parsed.netloc:
        raise ValueError(f"Object-store URI without a bucket: {path}")
    return path


def _names_files(spark: SparkSession, path: str) -> bool:
    """True for a file or a file pattern, false for a folder."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    return bool(re.search(r"[*?\[{]", last) or CSV_NAME.search(last)) or files.is_file(spark, path)


def _searching(reader: DataFrameReader, spark: SparkSession, path: str) -> DataFrameReader:
    reader = reader.option("recursiveFileLookup", True)
    return reader if _names_files(spark, path) else reader.option("pathGlobFilter", CSV_GLOB)


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """File and first line with content, of files that have one.

    Lines come through Spark's own text reader, so any store and compression it
    reads will do. Only the split at the start of a file counts, and a task
    keeps one line per file; nothing but those is shuffled.
    """
    text = F.regexp_replace("value", "^\uFEFF", "")
    lines = (
        _searching(spark.read, spark, path)
        .text(path)
        .filter(F.col("_metadata.file_block_start") == 0)
        .select(F.col("_metadata.file_path").alias("file_path"), text.alias("header"))
        .filter(F.trim("header") != "")
        # Grows along the lines of a split.
        .withColumn("place", F.monotonically_increasing_id())
    )
    # A least text by itself would have all lines sorted by file first. Beside a
    # collected set, which stays empty here, there is one entry per file in a hash map.
    odd = F.collect_set(F.when(F.col("place") < 0, F.col("place")))
    first = lines.groupBy("file_path").agg(F.min_by("header", "place").alias("header"), odd.alias("odd"))
    return first.select("file_path", F.when(F.size("odd") == 0, F.col("header")).alias("header"))


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """Path, its encoded form and header line of every ride file; NULL for one without content."""
    listed = _searching(spark.read.format("binaryFile"), spark, path).load(path)
    found = listed.select("path", F.col("_metadata.file_path").alias("file_path"))
    return found.join(_first_lines(spark, path), "file_path", "left").select("path", "file_path", "header")


def header_columns(header: str) -> list[str]:
    """Column names as the CSV reader would give them."""
    cells = next(csv.reader([header]))
    seen = Counter(cell.lower() for cell in cells)
    return [
        f"_c{i}" if not cell else f"{cell}{i}" if seen[cell.lower()] > 1 else cell
        for i, cell in enumerate(cells)
    ]


def _all_strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def _check_layouts(headers: DataFrame, layouts: dict[str, list[str]]) -> None:
    """Every layout must hold the required columns; the error names a file of each that does not."""
    bad = {header: missing for header, names in layouts.items() if (missing := missing_columns(names))}
    if bad:
        # One row per layout.
        named = headers.filter(F.col("header").isin(list(bad))).groupBy("header").agg(F.min("path").alias("path"))
        found = "; ".join(f"{row.path}: {bad[row.header]}" for row in named.take(len(bad)))
        raise ValueError(f"Files without required ride columns: {found}")


def _read_by_layout(spark: SparkSession, path: str) -> DataFrame:
    # One row per file; the files are read through once for it, and then it is at hand.
    headers = file_headers(spark, path).filter(F.col("header").isNotNull()).persist()
    rows = headers.groupBy("header").agg(F.count("*")).take(MOST_LAYOUTS + 1)
    if not rows:
        raise ValueError(f"No CSV files found at {path}")
    if len(rows) > MOST_LAYOUTS:
        raise ValueError(f"More than {MOST_LAYOUTS} different header lines at {path}")
    layouts = {row.header: aligned_names(header_columns(row.header)) for row in rows}
    _check_layouts(headers, layouts)
    first, *others = layouts.values()
    if all(names == first for names in others):
        headers.unpersist()
        reader = spark.read.schema(_all_strings(first)).option("header", True)
        return _searching(reader, spark, path).csv(path)
    return _read_mixed(spark, path, headers, layouts)


def _read_mixed(spark: SparkSession, path: str, headers: DataFrame, layouts: dict[str, list[str]]) -> DataFrame:
    """All files in one read by position; each row's file says what its positions mean.

    The reader drops the first line of every file, wherever it is split. Paths
    stay in the cluster: they meet their rows in a join, whose form follows the
    size of the list.
    """
    width = max(map(len, layouts.values()))
    places = [f"_place{i}" for i in range(width)]
    reader = spark.read.schema(_all_strings(places)).option("header", True)
    values = _searching(reader, spark, path).csv(path).select("*", F.col("_metadata.file_path").alias("_file"))
    numbers = {header: i for i, header in enumerate(sorted(layouts))}
    number = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[F.col("header")]
    files_of = headers.select(F.col("file_path").alias("_file"), number.alias("_layout"))
    joined = values.join(files_of, "_file")
    names = list(dict.fromkeys(name for names in layouts.values() for name in names))

    def under(name: str):
        """The column of that name, from the place each layout has it at."""
        at: dict[str, list[int]] = {}
        for header, own in layouts.items():
            if name in own:
                at.setdefault(places[own.index(name)], []).append(numbers[header])
        cases = [F.when(F.col("_layout").isin(of), F.col(place)) for place, of in at.items()]
        return F.coalesce(*cases).alias(name)

    return joined.select(*[under(name) for name in names])


def read_rides(spark: SparkSession, path: str, mixed_headers: bool = True) -> DataFrame:
    """Rides under canonical names, all text but the coordinates.

    CSV columns are bound by position, so files whose headers differ are read
    apart and united by name. `mixed_headers=False` skips the look at each
    header and fails during the read if one differs from the first.
    """
    check_uri(path)
    if mixed_headers:
        rides = _read_by_layout(spark, path)
    else:
        reader = spark.read.option("header", True).option("enforceSchema", False)
        rides = align_columns(_searching(reader, spark, path).csv(path))
    require_columns(rides)
    return rides.withColumns(
        {c: F.col(c).try_cast("double") for c in RIDE_COORDINATES if c in rides.columns}
    )
