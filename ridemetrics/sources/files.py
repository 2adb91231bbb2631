"""Folders and marker files, through the file layer that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _at(spark, path)
    return store.exists(target)


def is_file(spark: SparkSession, path: str) -> bool:
    store, target = _at(spark, path)
    return store.exists(target) and store.getFileStatus(target).isFile()


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right under `path`; none where there is nothing."""
    store, target = _at(spark, path)
    if not store.exists(target):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(target) if s.isDirectory())


def child_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files right under `path`; none where there is nothing."""
    store, target = _at(spark, path)
    if not store.exists(target):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(target) if s.isFile())


def touch(spark: SparkSession, path: str) -> None:
    store, target = _at(spark, path)
    store.create(target, True).close()


def set_time(spark: SparkSession, path: str, millis: int) -> None:
    """Give a file a modification time, where the store allows it."""
    store, target = _at(spark, path)
    store.setTimes(target, millis, -1)


def delete(spark: SparkSession, path: str) -> None:
    store, target = _at(spark, path)
    store.delete(target, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    store, target = _at(spark, old)
    if not store.rename(target, _at(spark, new)[1]):
        raise OSError(f"Could not move {old} to {new}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, without a slash at its end."""
    store, target = _at(spark, path)
    return target.makeQualified(store.getUri(), store.getWorkingDirectory()).toString().rstrip("/")
