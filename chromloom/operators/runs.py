"""Runs, replicates and shards: selection, renumbering, pooling metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromloom.functions.coords import is_shard, parse_run_name
from chromloom.functions.skew import row_numbers


def place_by(df: DataFrame, value: str, tie: str, out: str = "place") -> DataFrame:
    """Order conditions by a fitted value, missing values last (one row per condition)."""
    w = W.partitionBy(F.lit(0)).orderBy(F.col(value).asc_nulls_last(), tie)
    return df.withColumn(out, F.row_number().over(w))


def discover_runs(runs: DataFrame) -> DataFrame:
    """Runs (name, n_blocks) with condition and replicate, shards left out, and the merged copy
    preferred where a replicate exists twice."""
    parts = parse_run_name(F.col("name"))
    named = runs.where(~is_shard(F.col("name"))).select(
        "name", "n_blocks", parts["condition"].alias("condition"), parts["replicate"].alias("replicate"),
        F.col("name").startswith("merged_").alias("_merged"),
    ).where("replicate >= 0")
    best = F.max_by(F.struct("name", "n_blocks"), F.struct("_merged", F.col("name")))
    return named.groupBy("condition", "replicate").agg(best.alias("_r")).select(
        "condition", "replicate", "_r.name", "_r.n_blocks"
    ).where("n_blocks > 0")


def choose_replicates(runs: DataFrame, replicates: int, blocks: int) -> DataFrame:
    """Up to ``replicates`` runs per condition with at least ``blocks`` blocks, longest first,
    numbered anew from 1. One row per run, so a condition is a short list."""
    order = W.partitionBy("condition").orderBy(F.desc("n_blocks"), "replicate")
    return runs.where(F.col("n_blocks") >= blocks).withColumn(
        "new_rep", F.row_number().over(order)
    ).where(F.col("new_rep") <= replicates)


def depth_match(
    frames: DataFrame, chosen: DataFrame, keys: Sequence[str], block: str, blocks: int, mode: str = "tail"
) -> DataFrame:
    """First or last ``blocks`` blocks of each chosen run, in block order.

    Positions come from counts per chunk of block numbers, so runs may be of any length.
    """
    if mode not in ("head", "tail"):
        raise ValueError(f"unknown mode {mode!r}")
    keys = list(keys)
    index = frames.select(*keys, block).distinct().join(
        chosen.select(*keys, "n_blocks", "new_rep"), keys
    )
    placed = row_numbers(index, keys, [block], F.floor(F.col(block) / 1024), "_k")
    keep = (
        F.col("_k") <= blocks if mode == "head" else F.col("_k") > F.col("n_blocks") - blocks
    )
    return frames.join(placed.where(keep).select(*keys, block, "new_rep"), [*keys, block])


def latest_pooled(runs: DataFrame, key: str = "condition") -> DataFrame:
    """Per condition the pooled file with the most blocks; of several, the last path in text order."""
    return runs.groupBy(key).agg(
        F.max("n_blocks").alias("n_blocks"), F.max_by("path", F.struct("n_blocks", "path")).alias("path")
    )


def frame_counts(frames: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames of every expected run; absent runs have none."""
    n = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    return expected.join(n, list(keys), "left").withColumn(
        "n_frames", F.coalesce("n_frames", F.lit(0).cast("long"))
    )


def completeness(counts: DataFrame, key: str, wanted: int) -> DataFrame:
    """Replicates complete, partial and empty per condition."""
    n = F.col("n_frames")
    return counts.groupBy(key).agg(
        F.count(F.when(n >= wanted, 1)).alias("complete"),
        F.count(F.when((n > 0) & (n < wanted), 1)).alias("partial"),
        F.count(F.when(n == 0, 1)).alias("empty"),
    )


def shard_groups(shards: DataFrame, merged: DataFrame) -> DataFrame:
    """Groups of shards to merge: more shards exist than the last merge used.

    ``shards`` has names ``<base>_rep<r>_shard<k>``; ``merged`` (base, n_shards) earlier merges.
    """
    pattern = r"^(.+_rep\d+)_shard(\d+)$"
    groups = shards.select(F.regexp_extract("name", pattern, 1).alias("base")).where("base <> ''").groupBy(
        "base"
    ).agg(F.count(F.lit(1)).alias("n_found"))
    done = merged.select("base", F.col("n_shards").alias("n_merged"))
    return groups.join(done, "base", "left").withColumn(
        "n_merged", F.coalesce("n_merged", F.lit(0).cast("long"))
    ).where("n_found > n_merged")


def drop_shards(runs: DataFrame, name: str = "name") -> DataFrame:
    return runs.where(~is_shard(F.col(name)))


def match_conditions(runs: DataFrame, conditions: DataFrame, name: str = "name") -> DataFrame:
    """Condition of each run: the key equal to its name, else the longest key it starts with.

    Every prefix length that occurs among the keys is tried by equality, so run names never meet
    unrelated keys.
    """
    plain = F.regexp_replace(F.regexp_replace(name, "^merged_", ""), r"_rep\d+$", "")
    stems = runs.select(F.col(name), plain.alias("_stem")).distinct()
    prefixes = stems.withColumn("_len", F.explode(F.sequence(F.lit(1), F.length("_stem")))).where(
        F.col("_len") >= 1
    ).select(name, "_len", F.substring("_stem", F.lit(1), F.col("_len")).alias("key"))
    hit = prefixes.join(conditions.select("key"), "key").groupBy(name).agg(
        F.max_by("key", "_len").alias("condition_key")
    )
    return runs.join(hit, name, "left")


def keyed_override(items: DataFrame, by_name: DataFrame, by_type: DataFrame) -> DataFrame:
    """Value given for an item's name, else for its type, else its default."""
    a = by_name.select("name", F.col("value").alias("_a"))
    b = by_type.select(F.col("type"), F.col("value").alias("_b"))
    return items.join(a, "name", "left").join(b, "type", "left").withColumn(
        "value", F.coalesce("_a", "_b", "default")
    ).drop("_a", "_b")


def best_condition(metrics: DataFrame, cond: str = "cond") -> DataFrame:
    """Condition with the highest value of each metric, the first by name on ties."""
    return metrics.groupBy("metric").agg(
        F.min_by(cond, F.struct(-F.col("value"), F.col(cond))).alias("best"), F.max("value").alias("value")
    )


def metric_mean_std(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation over replicates."""
    return metrics.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n")
    )


def ordered_union(*lists: DataFrame) -> DataFrame:
    """Names of several (name, place) lists in first-seen order."""
    ranked = None
    for k, names in enumerate(lists):
        part = names.select("name", F.struct(F.lit(k).alias("l"), F.col("place").cast("long").alias("p")).alias("_o"))
        ranked = part if ranked is None else ranked.unionByName(part)
    first = ranked.groupBy("name").agg(F.min("_o").alias("_o"))
    w = W.partitionBy(F.lit(0)).orderBy("_o", "name")
    return first.select("name", F.row_number().over(w).alias("place"))


def expand_references(runs: DataFrame, references: DataFrame) -> DataFrame:
    """Every run with every reference map (a short list), flagged where it is the run's own."""
    listed = references.agg(F.sort_array(F.collect_set("reference")).alias("r"))
    return runs.withColumn("reference", F.explode(listed.scalar())).withColumn(
        "is_target", F.col("reference") == F.col("target")
    )
