"""Joining one aggregated row per group back to its group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, per_group: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Add the columns of ``per_group`` (one row per ``keys``); without keys its only row."""
    keys = list(keys)
    if keys:
        return df.join(per_group, keys, how)
    row = per_group.select(F.struct(*per_group.columns).alias("r"))
    return df.withColumn("_row", row.scalar()).select(*df.columns, "_row.*")
