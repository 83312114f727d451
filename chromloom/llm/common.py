"""Shared pieces of the operators in this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.session import shared_dir

#: Rows and bytes of one Arrow batch sent to a Python worker; long texts make small batches.
BATCH_ROWS, BATCH_BYTES = 1024, 16 * 1024 * 1024

#: Bytes of text that a Python kernel works on at a time.
KERNEL_BYTES = 1 << 20

#: A word: no blank, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, whatever the session's own setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/chromloom-llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; one of the same name (in any case) in the input gives way."""
    names = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[v.alias(k) for k, v in columns.items()])


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, other letters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
