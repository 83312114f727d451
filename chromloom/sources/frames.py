"""Trajectory frames and stored maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.operators.contacts import merge_shards
from chromloom.schemas import POSITION


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames stored as parquet, partitioned by locus, condition and replicate.

    Frame order is the numeric ``frame`` column, not the order of file names.
    """
    return conform(spark.read.parquet(path))


def conform(frames: DataFrame) -> DataFrame:
    """Positions as double precision, whatever they were stored as."""
    return frames.withColumn("pos", F.col("pos").cast(POSITION))


def frame_index(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames and beads per run."""
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), F.max(F.size("pos")).alias("n_beads")
    )


def select_beads(frames: DataFrame, keys: Sequence[str], beads: Sequence[int]) -> DataFrame:
    """Only the probe beads of each frame, taken from the array without exploding it whole."""
    picked = F.array(*[
        F.struct(F.lit(int(b)).alias("bead"), F.get("pos", F.lit(int(b))).alias("p")) for b in beads
    ])
    return frames.select(*keys, F.explode(picked).alias("_s")).select(
        *keys, "_s.bead", "_s.p.x", "_s.p.y", "_s.p.z"
    )


def chain_replicates(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replicates end to end: frames of a condition renumbered in (replicate, frame) order."""
    return (
        merge_shards(frames.withColumnRenamed("rep", "shard"), keys)
        .withColumnRenamed("shard", "rep")
        .drop("n_shards")
    )


def read_contact_map(spark: SparkSession, path: str) -> DataFrame:
    """A stored map of pixels (keys, i, j, v or n)."""
    return spark.read.parquet(path)


def conform_map(pixels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Upper-triangle pixels of a stored map, whichever triangle or both it was stored with.

    The two copies of a symmetric pixel are equal, so the larger stands for both.
    """
    i, j = F.least("i", "j"), F.greatest("i", "j")
    return pixels.groupBy(*keys, i.alias("i"), j.alias("j")).agg(F.max(value).alias(value))
