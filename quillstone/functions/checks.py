"""Schema and key checks that fail with a clear message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, or an error that lists the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself, or an error with an example if a key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"Key {keys} is not unique, for example {twice[0].asDict()}")
    return df
