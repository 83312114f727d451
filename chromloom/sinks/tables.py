"""Table output: long curves, metric tables, sample sheets, and stored stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.functions.text import general


def curve_lines(curve: DataFrame, label: str, x: str, y: str, whole_x: bool) -> DataFrame:
    """Rows (curve, x, y) formatted with six significant digits."""
    at = F.col(x).cast("long").cast("string") if whole_x else general(F.col(x), 6)
    return curve.select(F.col(label).alias("curve"), at.alias(x), general(F.col(y), 6).alias(y))


def write_curve_table(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).csv(path, sep="\t", header=True)


def write_metric_table(rows: DataFrame, path: str, columns: Sequence[str], fmt: str = "csv", mode: str = "error") -> None:
    """Metric rows in a fixed column order as CSV (formatted cells) or JSON (raw values)."""
    ordered = rows.select(*columns)
    if fmt == "json":
        ordered.write.mode(mode).json(path)
    else:
        ordered.write.mode(mode).csv(path, header=True, emptyValue="")


def write_samplesheet(samples: DataFrame, path: str, mode: str = "error") -> None:
    """Parsed sample sheet with the built name as an extra last column."""
    rest = [c for c in samples.columns if c != "name"]
    out = samples.select(*rest, F.col("name").alias("sampleName"))
    out.write.mode(mode).csv(path, sep="\t", header=True, nullValue="NA")


def store_stage(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("locus", "condition", "replicate")
) -> None:
    """Store a heavy table, replacing only the partitions that ``df`` holds.

    A note beside the table is written last, so a stage cut short is not taken for complete.
    """
    spark = df.sparkSession
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by).parquet(path)
    )
    spark.range(1).select(F.lit("done").alias("value")).coalesce(1).write.mode("overwrite").text(
        _note(path)
    )


def _note(path: str) -> str:
    return path.rstrip("/") + ".done"


def stage_exists(spark: SparkSession, path: str) -> bool:
    """Whether a stage was written to the end."""
    try:
        return spark.read.text(_note(path)).first() is not None
    except AnalysisException:
        return False


def reuse_or_build(spark: SparkSession, path: str, build, partition_by: Sequence[str], reuse: bool = True) -> DataFrame:
    """A stored stage when ``reuse`` and present, else built, stored and read back."""
    if not (reuse and stage_exists(spark, path)):
        store_stage(build(), path, partition_by)
    return spark.read.parquet(path)
