"""A contact map that grows as trajectory blocks arrive.

Counts of every micro-batch are stored under the batch's number; the map is their sum. A batch
that runs twice replaces its own counts, so restarts neither lose nor repeat contacts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chromloom.operators.contacts import count_contacts, normalise, sub_regions


def write_batch(
    frames: DataFrame, batch: int, path: str, keys: Sequence[str], n_bins: int, radius: float, **tiling
) -> None:
    """Store contact counts and sub-region counts of one batch of frames."""
    counts = count_contacts(frames, keys, n_bins, radius, **tiling)
    counts.write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")
    sub_regions(frames, keys, tiling.get("n_tiles", 1)).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/subs/batch={batch}"
    )


def start_running_map(
    frames: DataFrame, path: str, checkpoint: str, keys: Sequence[str], n_bins: int, radius: float,
    available_now: bool = True, **tiling,
) -> StreamingQuery:
    """Count contacts of a stream of frames into ``path``; stops at the end of available data
    unless told to run on."""
    writer = frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch: write_batch(df, batch, path, list(keys), n_bins, radius, **tiling)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_map(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The map over everything counted so far: (keys, i, j, n, n_sub, v)."""
    keys = list(keys)
    counts = spark.read.parquet(f"{path}/counts").groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"))
    subs = spark.read.parquet(f"{path}/subs").groupBy(*keys).agg(F.sum("n_sub").alias("n_sub"))
    return normalise(counts, subs, keys)
