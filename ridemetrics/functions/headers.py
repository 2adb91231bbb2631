"""Ride header clean-up. Works on column names only, never on rows."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from ridemetrics.schema import RIDE_ALIASES, RIDE_REQUIRED


def normalize_name(name: str) -> str:
    """Lower-case words of `name` joined by single underscores."""
    words = re.split(r"[^a-z0-9]+", name.lower())
    return "_".join(word for word in words if word)


def normalized_names(columns: list[str]) -> list[str]:
    """Normalised names in column order; a name with no letters or digits stays."""
    names = [normalize_name(column) or column for column in columns]
    repeated = {name for name, n in Counter(names).items() if n > 1}
    if repeated:
        clash = [column for column, name in zip(columns, names) if name in repeated]
        raise ValueError(f"Columns share a name after normalization: {clash}")
    return names


def aligned_names(columns: list[str]) -> list[str]:
    """Normalised names with known aliases replaced by the canonical name."""
    names = normalized_names(columns)
    present = set(names)
    canonical = {}
    for target, accepted in RIDE_ALIASES.items():
        source = target if target in present else next((a for a in accepted if a in present), None)
        if source:
            canonical[source] = target
    return [canonical.get(name, name) for name in names]


def rename_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


def align_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*aligned_names(df.columns))


def missing_columns(names: list[str], required: list[str] = RIDE_REQUIRED) -> list[str]:
    return [name for name in required if name not in names]


def require_columns(df: DataFrame, required: list[str] = RIDE_REQUIRED) -> DataFrame:
    missing = missing_columns(df.columns, required)
    if missing:
        raise ValueError(f"Ride columns not found under any accepted header name: {missing}")
    return df
