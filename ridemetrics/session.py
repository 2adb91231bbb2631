"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from ridemetrics.sources import files

_scratch: list[tuple[SparkSession, str]] = []


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the library expects; sizing is left to the cluster."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # One state row per station: keep it on disk, not on the executor heap.
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )


def shared_dir(spark: SparkSession) -> str | None:
    """The cluster's shared folder, or None where the session names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or None


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path for one run under the shared folder; deleted when Python ends.

    A session that names no shared folder gets a machine-local one, which is
    only right for local mode.
    """
    base = shared_dir(spark)
    if base is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="ridemetrics-")
        _scratch.append((spark, base))
    path = f"{base.rstrip('/')}/ridemetrics/{purpose}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in reversed(_scratch):
        try:
            files.delete(spark, path)
        except Exception:  # the session is gone, and with it the way to reach the store
            pass


atexit.register(_clean)
