"""The batch job: ride CSV in, eight CSV reports out.

    python -m ridemetrics.plans.ride_analysis --input PATH --output PATH [--stage PATH]
"""

from __future__ import annotations

import argparse
import re
import uuid

from pyspark.sql import SparkSession

from ridemetrics.operators.reports import all_reports
from ridemetrics.operators.rides import derive
from ridemetrics.session import configure, scratch_dir, shared_dir
from ridemetrics.sinks.reports import publish_reports, write_reports
from ridemetrics.sinks.tables import store_rides
from ridemetrics.sources import files
from ridemetrics.sources.rides import check_uri, read_rides


def analyze(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    stage: str | None = None,
    mixed_headers: bool = True,
    accuracy: int | None = None,
    whole_set: bool = False,
) -> None:
    """Read rides, stage them as Parquet, write the reports, as one whole set if asked to.

    Staging parses the text once. Without a stage path the copy lies in the shared
    folder, or beside the output, and goes when the reports are written.
    """
    check_uri(output_path)
    for name, path in (("output", output_path), ("stage", stage)):
        if path and _holds(spark, path, input_path):
            raise ValueError(f"The {name} folder {path} would overwrite the input {input_path}")
    rides = derive(read_rides(spark, input_path, mixed_headers))
    own = stage is None
    if own:
        stage = scratch_dir(spark, "rides") if shared_dir(spark) else f"{output_path.rstrip('/')}/_rides-{uuid.uuid4().hex}"
    try:
        write = publish_reports if whole_set else write_reports
        write(all_reports(store_rides(rides, stage), accuracy), output_path)
    finally:
        if own:
            files.delete(spark, stage)


def _holds(spark: SparkSession, folder: str, path: str) -> bool:
    """True where `folder` is `path` or lies above it."""
    fixed = re.split(r"[*?\[{]", path, maxsplit=1)[0]
    return f"{files.qualified(spark, fixed or '.')}/".startswith(f"{files.qualified(spark, folder)}/")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Ride reports from CSV files")
    parser.add_argument("--input", required=True, help="CSV file, glob, folder or object-store prefix")
    parser.add_argument("--output", required=True, help="folder or object-store URI for the reports")
    parser.add_argument("--stage", help="folder that keeps the typed rides as Parquet")
    parser.add_argument("--uniform-headers", action="store_true", help="all files share one header")
    parser.add_argument("--whole-set", action="store_true", help="readers see all eight reports change at once")
    args = parser.parse_args(argv)

    spark = configure(SparkSession.builder.appName("ridemetrics")).getOrCreate()
    analyze(spark, args.input, args.output, args.stage, mixed_headers=not args.uniform_headers, whole_set=args.whole_set)


if __name__ == "__main__":
    main()
