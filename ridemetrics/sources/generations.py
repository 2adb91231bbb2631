"""Folders that are written whole under a number of their own; readers take the newest finished one.

A generation is written out of sight of readers and marked last, with one empty
file. One that was cut off has no mark and is never read; the next writer takes a
higher number.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ridemetrics.sources import files

_PREFIX = "generation="
_MARK = "_FINISHED"


def _folder(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/{_PREFIX}{number}"


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.removeprefix(_PREFIX)) for n in files.child_folders(spark, root) if n.startswith(_PREFIX))


def _finished(spark: SparkSession, root: str, number: int) -> bool:
    return files.exists(spark, f"{_folder(root, number)}/{_MARK}")


def newest(spark: SparkSession, root: str) -> str | None:
    """The newest finished generation under `root`."""
    for number in reversed(_numbers(spark, root)):
        if _finished(spark, root, number):
            return _folder(root, number)
    return None


def begin(spark: SparkSession, root: str) -> str:
    """The folder of a new generation; one writer at a time."""
    return _folder(root, max(_numbers(spark, root), default=0) + 1)


def finish(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Give `folder` to readers; of those before it the last `keep` finished ones stay, for who still reads them."""
    files.touch(spark, f"{folder}/{_MARK}")
    root, name = folder.rsplit("/", 1)
    before = [n for n in _numbers(spark, root) if n < int(name.removeprefix(_PREFIX))]
    kept = [n for n in before if _finished(spark, root, n)][-keep:]
    for old in before:
        if old not in kept:
            files.delete(spark, _folder(root, old))
