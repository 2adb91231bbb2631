"""CSV sinks for aggregated reports, on any path Spark can write."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from ridemetrics.sources import generations
from ridemetrics.sources.rides import check_uri

# Reports with one row per distinct value found in the data. They are range
# sorted, and adaptive execution merges small results into one file; an
# unexpectedly large one is written by many tasks, its files in order.
UNBOUNDED = {"rides_by_member_type", "rides_by_rideable_type"}


def write_report(report: DataFrame, path: str, single_file: bool = True) -> None:
    """Overwrite `path` with a headed CSV, one file for results of bounded size."""
    out = report.coalesce(1) if single_file else report
    out.write.mode("overwrite").option("header", True).csv(path)


def write_reports(reports: dict[str, DataFrame], base: str, at_once: int = 4) -> None:
    """One folder per report under `base`, local or object store.

    A few reports run at once, so that the short last stages of one leave no
    executors idle.
    """
    base = check_uri(base).rstrip("/")

    def write(item):
        name, report = item
        write_report(report, f"{base}/{name}", single_file=name not in UNBOUNDED)

    spark = next(iter(reports.values())).sparkSession
    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(inheritable_thread_target(spark)(write), reports.items()))


def publish_reports(reports: dict[str, DataFrame], base: str) -> str:
    """Write the reports as one whole set under `base`, and give it to readers at the end.

    Readers see the set before it until every report is written, and for good if
    one fails. The set before stays too, for those who read it. Returns the set's folder.
    """
    spark = next(iter(reports.values())).sparkSession
    folder = generations.begin(spark, check_uri(base))
    write_reports(reports, folder)
    generations.finish(spark, folder, keep=1)
    return folder
