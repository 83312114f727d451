"""Contact runs of a stream of frames, exact whatever the order of arrival.

Every micro-batch finds its own runs, chunk by chunk, and stores them with a mark for runs that
another batch could still extend: those with no known frame right before or after. Only marked
runs are chained across batches, chunk by chunk, so a hot series is never one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chromloom.operators.dynamics import contact_runs


#: Frames of a chunk in which open runs are chained.
CHUNK = 10_000


def batch_runs(trace: DataFrame, keys: Sequence[str], t: str, hit: Column) -> DataFrame:
    """Runs of one batch: (keys, start, end, open) where open runs may go on elsewhere."""
    keys = list(keys)
    runs = contact_runs(trace, keys, t, hit).select(*keys, "start", "end")
    seen = trace.select(*keys, F.col(t).cast("long").alias("_t"))
    ends = runs.select(*keys, "start", "end", F.explode(F.array(
        F.struct((F.col("start") - 1).alias("_t")), F.struct((F.col("end") + 1).alias("_t"))
    )).alias("_e")).select(*keys, "start", "end", "_e._t")
    known = ends.join(seen, [*keys, "_t"], "left_semi").groupBy(*keys, "start", "end").agg(
        F.count(F.lit(1)).alias("_known")
    )
    return runs.join(known, [*keys, "start", "end"], "left").select(
        *keys, "start", "end", (F.coalesce("_known", F.lit(0)) < 2).alias("open")
    )


def start_running_dwell(
    trace: DataFrame, path: str, checkpoint: str, keys: Sequence[str], t: str, hit: Column,
    available_now: bool = True,
) -> StreamingQuery:
    """Store the runs of every micro-batch under its number."""

    def write(df: DataFrame, batch: int) -> None:
        batch_runs(df, keys, t, hit).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = trace.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _chained(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs that follow each other without a gap as one, within ``keys``."""
    order = W.partitionBy(*keys).orderBy("start")
    fresh = (F.lag("end").over(order) + 1 != F.col("start")).cast("int")
    return (
        runs.withColumn("_new", F.coalesce(fresh, F.lit(1))).withColumn("_id", F.sum("_new").over(order))
        .groupBy(*keys, "_id").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_id")
    )


def running_runs(spark: SparkSession, path: str, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Runs over everything seen so far: (keys, start, end, length).

    Open runs are chained within chunks of ``chunk`` frames (by their start); only the first and
    the last run of a chunk can go on in another one, so two rows a chunk are chained per series.
    """
    keys = list(keys)
    runs = spark.read.parquet(path)
    part = [*keys, "_b"]
    within = _chained(runs.where("open").withColumn("_b", F.floor(F.col("start") / chunk)), part)
    all_ = W.partitionBy(*part)
    placed = within.withColumn("_border", (F.col("start") == F.min("start").over(all_)) | (F.col("start") == F.max("start").over(all_)))
    border = _chained(placed.where("_border"), keys)
    chained = placed.where("NOT _border").select(*keys, "start", "end").unionByName(border)
    return runs.where("NOT open").select(*keys, "start", "end").unionByName(chained).withColumn(
        "length", F.col("end") - F.col("start") + 1
    )
