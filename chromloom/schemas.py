"""The schema of bead positions; tables are read with stated columns, never inferred ones."""

from __future__ import annotations

from pyspark.sql import types as T

POSITION = T.ArrayType(
    T.StructType([T.StructField(a, T.DoubleType()) for a in ("x", "y", "z")])
)
