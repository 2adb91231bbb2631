"""Readers for published report sets."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridemetrics.schema import REPORT_COLUMNS
from ridemetrics.sources import generations
from ridemetrics.sources.rides import check_uri


@dataclass
class ReportSet:
    available: bool
    message: str
    output_dir: str | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)


def _empty(spark: SparkSession, name: str) -> DataFrame:
    columns = T.StructType.fromDDL(REPORT_COLUMNS[name]).fieldNames()
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def read_report(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One report, every value as text; empty when it was never written."""
    try:
        return spark.read.option("header", True).csv(f"{base.rstrip('/')}/{name}")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return _empty(spark, name)
        raise


def last_written(spark: SparkSession, base: str):
    """Newest file time under `base`, or None where there is nothing."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
        return files.agg(F.max("modificationTime")).first()[0]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def freshest(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """The candidate written last; the earlier in the list wins a tie.

    Of a candidate published in generations the finished one counts.
    """
    written = [(last_written(spark, _whole_set(spark, base)), base) for base in candidates]
    written = [(when, base) for when, base in written if when is not None]
    return max(written, key=lambda pair: pair[0])[1] if written else None


def _whole_set(spark: SparkSession, base: str) -> str:
    """Where the reports of `base` lie: in its newest finished generation, else right there."""
    return generations.newest(spark, base) or base


def _load(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    base = _whole_set(spark, base)
    return {name: read_report(spark, base, name) for name in REPORT_COLUMNS}


def _read_through(tables: dict[str, DataFrame], at_once: int = 4) -> None:
    """Read every row of every table once, so that what cannot be read fails here.

    Reports are small: published by the job, they hold at most a row per group.
    """
    spark = next(iter(tables.values())).sparkSession

    def read(table: DataFrame) -> None:
        table.write.format("noop").mode("overwrite").save()

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(inheritable_thread_target(spark)(read), tables.values()))


def read_reports(
    spark: SparkSession, candidates: Sequence[str], store_uri: str | None = None
) -> ReportSet:
    """The report set at `store_uri`, else the freshest of `candidates`.

    A bad URI, a store that cannot be reached, and a report whose rows cannot
    all be read fall back to the candidates, all reports together.
    """
    problem = ""
    if store_uri:
        try:
            check_uri(store_uri)
            tables = _load(spark, store_uri)
            _read_through(tables)
            return ReportSet(True, "Reports loaded from the object store.", store_uri, tables)
        except (ValueError, PySparkException, Py4JJavaError) as error:
            problem = f" Object store failed: {type(error).__name__}."
    base = freshest(spark, candidates)
    if base is None:
        return ReportSet(False, f"No reports found. Run the ride analysis first.{problem}")
    return ReportSet(True, f"Reports loaded.{problem}", base, _load(spark, base))
