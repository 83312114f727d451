"""Ordered computations over groups of any size.

A plain window over a group sends the whole group to one task. Here a group is first cut
into buckets that follow the order, the window runs per (group, bucket), and only one small
row per bucket is combined across the group. One group may thus hold most of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: value buckets per doubling used to cut a group by value
BUCKETS_PER_OCTAVE = 4096


def value_bucket(v: Column) -> Column:
    """A bucket number that never decreases with the value.

    Buckets have the same relative width (about 0.02 %) at every magnitude, so they cut tiny
    probabilities as finely as large distances.
    """
    # the shift keeps the logarithm of every double above zero
    size = F.floor((F.log2(F.abs(v)) + 1100) * BUCKETS_PER_OCTAVE)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * size).cast("long")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    amount: Column | None = None,
    out: str = "running",
) -> DataFrame:
    """Add the running sum of ``amount`` (row count when None) in ``order`` per ``keys``.

    ``bucket`` must not decrease along ``order``; it decides how a group is cut.
    """
    keys = list(keys)
    amount = F.lit(1).cast("long") if amount is None else amount
    work = df.withColumn("_b", bucket).withColumn("_a", amount)
    totals = work.groupBy(*keys, "_b").agg(F.sum("_a").alias("_t"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(
        *keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base")
    )
    inside = (
        W.partitionBy(*keys, "_b")
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        work.withColumn("_r", F.sum("_a").over(inside))
        .join(base, [*keys, "_b"])
        .withColumn(out, F.col("_base") + F.col("_r"))
        .drop("_b", "_a", "_r", "_base")
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str = "rn"
) -> DataFrame:
    """One-based position of each row in ``order`` within its group."""
    return running_total(df, keys, order, bucket, None, out)


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]
) -> DataFrame:
    """Exact percentiles with linear interpolation: rows (keys, prob, value).

    Counts per value bucket locate the wanted ranks; only rows of those buckets are ordered.
    """
    keys = list(keys)
    rows = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )
    per_bucket = rows.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    whole = W.partitionBy(*keys)
    upto = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    spans = per_bucket.select(
        *keys,
        "_b",
        "_n",
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_lo"),
        F.sum("_n").over(whole).alias("_total"),
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    place = F.col("prob") * (F.col("_total") - 1)
    ranks = (
        spans.withColumn("prob", wanted)
        .withColumn("_part", place - F.floor(place))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
        .where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_lo") + F.col("_n")))
        .select(
            *keys, "_b", "prob", "_part", "_rank", (F.col("_rank") - F.col("_lo")).alias("_k"),
            (F.col("_rank") == F.ceil(place)).alias("_upper"),
            (F.col("_rank") == F.floor(place)).alias("_lower"),
        )
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_v")
    needed = ranks.select(*keys, "_b").distinct()
    placed = rows.join(needed, [*keys, "_b"], "left_semi").withColumn(
        "_end", F.sum("_c").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    hit = placed.join(ranks, [*keys, "_b"]).where(
        (F.col("_k") < F.col("_end")) & (F.col("_k") >= F.col("_end") - F.col("_c"))
    )
    low = F.max(F.when(F.col("_lower"), F.col("_v")))
    high = F.max(F.when(F.col("_upper"), F.col("_v")))
    return hit.groupBy(*keys, "prob").agg(
        (low + (high - low) * F.max("_part")).alias("value")
    )
