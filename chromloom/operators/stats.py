"""Comparison of conditions by one value per replicate.

Vectors are rows (metric, cond, rep, value). Moments, ranks and exact permutations are plain
aggregates; resampling and p-values run in NumPy on one small pair of vectors at a time. Tests
compare replicates, a handful per condition; tiles of one replicate are not independent and
must not be passed as values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromloom.functions.kernels import mann_whitney_p, student_two_sided
from chromloom.functions.numeric import is_finite
from chromloom.functions.text import uses_log10

# fixed values of the published analysis
N_RESAMPLES, SEED, QUANTILES, SLACK = 10_000, 0, (2.5, 97.5), 1e-12
EXACT_LIMIT = 16


def clean_values(vectors: DataFrame, metric: str = "metric", log10: bool | None = None) -> DataFrame:
    """Finite values only; on a log10 scale (positive values) where the metric asks for it, or as
    told by ``log10``."""
    logged = uses_log10(F.col(metric)) if log10 is None else F.lit(log10)
    v = F.col("value")
    return vectors.where(is_finite(v)).withColumn("log10", logged).where(
        ~F.col("log10") | (v > 0)
    ).withColumn("value", F.when(F.col("log10"), F.log10(F.when(v > 0, v))).otherwise(v))


def summary_stats(vectors: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean, sample deviation and standard error of finite values; one value gives zeros."""
    v = F.when(is_finite(F.col(value)), F.col(value))
    n = F.count(v)
    std = F.when(n > 1, F.stddev_samp(v)).when(n == 1, F.lit(0.0))
    return vectors.groupBy(*keys).agg(
        n.alias("n"), F.avg(v).alias("mean"), std.alias("std"), (std / F.sqrt(F.nullif(n, F.lit(0)))).alias("sem")
    )


def pair_mode(left: Column, right: Column, mode: str, reference: str | None = None) -> Column:
    """Which ordered pairs of conditions are compared."""
    if mode == "all_ordered":
        return left != right
    if mode == "unordered":
        return left < right
    if mode == "vs_reference":
        if reference is None:
            raise ValueError("vs_reference needs a reference condition")
        return (left == reference) & (right != reference)
    raise ValueError(f"unknown pair mode {mode!r}")


def condition_pairs(
    vectors: DataFrame, keys: Sequence[str], mode: str = "all_ordered",
    reference: str | None = None, min_n: int = 2,
) -> DataFrame:
    """Vectors of two conditions side by side with their moments, one row per metric and pair.

    Columns: keys, cond_x, cond_y, x, y (values in replicate order) and n, mean, var of each.
    Both sides need ``min_n`` values. A metric has as many pairs as its conditions squared.
    """
    keys = list(keys)
    n = F.count("value")
    per = vectors.groupBy(*keys, "cond").agg(
        F.sort_array(F.collect_list(F.struct("rep", "value")))["value"].alias("x"),
        n.alias("n_x"), F.avg("value").alias("mean_x"),
        F.when(n > 1, F.var_samp("value")).alias("var_x"),
    ).where(F.col("n_x") >= min_n)
    other = per.select(
        *keys, F.col("cond").alias("cond_y"),
        *[F.col(f"{c}x").alias(f"{c}y") for c in ("", "n_", "mean_", "var_")],
    )
    return (
        per.withColumnRenamed("cond", "cond_x").join(other, keys)
        .where(pair_mode(F.col("cond_x"), F.col("cond_y"), mode, reference))
    )


def _share(side: str) -> Column:
    return F.try_divide(F.col(f"var_{side}"), F.col(f"n_{side}").cast("double"))


def welch_t(pairs: DataFrame) -> DataFrame:
    """Adds t and df of unequal variances; NULL without variance estimates or without variance."""
    a, b = _share("x"), _share("y")
    both = a + b
    freedom = F.try_divide(a * a, (F.col("n_x") - 1).cast("double")) + F.try_divide(
        b * b, (F.col("n_y") - 1).cast("double")
    )
    return pairs.withColumn(
        "t", F.try_divide(F.col("mean_x") - F.col("mean_y"), F.sqrt(both))
    ).withColumn("df", F.when(both > 0, F.try_divide(both * both, freedom)))


@F.pandas_udf(T.DoubleType())
def _student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_two_sided(t.to_numpy(float), df.to_numpy(float)))


def welch_p(tested: DataFrame) -> DataFrame:
    """Adds the two-sided p of t and df; 1 where both sides have no variance."""
    flat = (F.col("n_x") > 1) & (F.col("n_y") > 1) & (_share("x") + _share("y") == 0)
    p = F.nanvl(_student_p("t", "df"), F.lit(None).cast("double"))
    return tested.withColumn("p_welch", F.when(flat, F.lit(1.0)).otherwise(p))


def cohens_d(pairs: DataFrame) -> DataFrame:
    """Adds the difference of means over the pooled sample deviation."""
    nx, ny = F.col("n_x"), F.col("n_y")
    pooled = F.try_divide(
        (nx - 1) * F.col("var_x") + (ny - 1) * F.col("var_y"), (nx + ny - 2).cast("double")
    )
    d = F.try_divide(F.col("mean_x") - F.col("mean_y"), F.sqrt(pooled))
    return pairs.withColumn("cohens_d", F.when((nx > 1) & (ny > 1), d))


def mann_whitney_u(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U of the first side from mean ranks of the joined values: (keys, conditions, u)."""
    ids = [*keys, "cond_x", "cond_y"]
    long = pairs.select(*ids, "n_x", F.explode("x").alias("v"), F.lit(True).alias("first")).unionByName(
        pairs.select(*ids, "n_x", F.explode("y").alias("v"), F.lit(False).alias("first"))
    )
    w = W.partitionBy(*ids)
    rank = F.rank().over(w.orderBy("v")) + (F.count(F.lit(1)).over(W.partitionBy(*ids, "v")) - 1) / 2.0
    return long.withColumn("r", rank).groupBy(*ids).agg(
        (F.sum(F.when(F.col("first"), F.col("r"))) - F.max(F.col("n_x") * (F.col("n_x") + 1) / 2.0)).alias("u")
    )


def permutation_exact(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of all regroupings whose mean difference is at least the observed one.

    Subsets are bit masks of the joined values, so a pair may have ``EXACT_LIMIT`` values at most;
    ``permutation_test`` takes pairs of any size.
    """
    ids = [*keys, "cond_x", "cond_y"]
    small = pairs.select(
        *ids, "n_x", "n_y", F.concat("x", "y").alias("v"),
        F.abs(F.col("mean_x") - F.col("mean_y")).alias("_obs"),
    )
    last = (F.pow(F.lit(2.0), F.size("v")) - 1).cast("int")
    masks = small.withColumn("m", F.explode(F.sequence(F.lit(0), last))).where(
        F.bit_count("m") == F.col("n_x")
    )
    chosen = F.aggregate(
        F.zip_with("v", F.sequence(F.lit(0), F.size("v") - 1),
                   lambda v, i: F.when(F.getbit(F.col("m"), i) == 1, v).otherwise(F.lit(0.0))),
        F.lit(0.0), lambda s, v: s + v,
    )
    total = F.aggregate("v", F.lit(0.0), lambda s, v: s + v)
    gap = F.abs(chosen / F.col("n_x") - (total - chosen) / F.col("n_y"))
    return masks.groupBy(*ids).agg(
        F.avg((gap >= F.col("_obs") - SLACK).cast("double")).alias("p_perm"),
        F.count(F.lit(1)).alias("n_perm"),
    )


def permutation_test(
    pairs: DataFrame, keys: Sequence[str], n_perm: int = N_RESAMPLES, seed: int = SEED
) -> DataFrame:
    """(keys, conditions, p_perm, n_perm, exact) of every pair.

    The published rule: all regroupings where there are at most ``n_perm`` of them, else that
    many seeded ones; ``exact`` tells which. Pairs of up to ``EXACT_LIMIT`` values with few
    enough regroupings are enumerated in the JVM, the others in NumPy tasks, with equal results.
    """
    ids = [*keys, "cond_x", "cond_y"]
    n = F.col("n_x") + F.col("n_y")
    few = F.least(n, F.lit(EXACT_LIMIT)).cast("int")
    ways = F.factorial(few) / (F.factorial(F.least("n_x", few).cast("int")) * F.factorial((few - F.least("n_x", few)).cast("int")))
    listed = (n <= EXACT_LIMIT) & (ways <= n_perm)
    masks = permutation_exact(pairs.where(listed), keys).withColumn("exact", F.lit(True))
    drawn = resampling_tests(pairs.where(~listed), n_perm, seed).select(*ids, "p_perm", "n_perm", "exact")
    return masks.unionByName(drawn)


def _resample(x: np.ndarray, y: np.ndarray, n_boot: int, seed: int) -> dict:
    """Bootstrap interval, permutation p and rank-sum p of one pair of vectors."""
    from math import comb

    nx, ny = len(x), len(y)
    rng = np.random.default_rng(seed)
    left = x[rng.integers(0, nx, size=(n_boot, nx))].mean(axis=1)
    right = y[rng.integers(0, ny, size=(n_boot, ny))].mean(axis=1)
    lo, hi = np.percentile(left - right, QUANTILES)
    joined = np.concatenate([x, y])
    observed = abs(x.mean() - y.mean())
    exact = comb(nx + ny, nx) <= n_boot
    if exact:
        masks = np.arange(1 << (nx + ny)) if nx + ny <= EXACT_LIMIT else None
        if masks is None:
            from itertools import combinations

            picks = np.array(list(combinations(range(nx + ny), nx)))
            sums = joined[picks].sum(axis=1)
        else:
            bits = (masks[:, None] >> np.arange(nx + ny)) & 1
            sums = bits[bits.sum(axis=1) == nx] @ joined
    else:
        draws = np.random.default_rng(seed)
        sums = np.array([joined[draws.permutation(nx + ny)[:nx]].sum() for _ in range(n_boot)])
    gaps = np.abs(sums / nx - (joined.sum() - sums) / ny)
    _, repeats = np.unique(joined, return_counts=True)
    greater = (x[:, None] > y[None, :]).sum() + 0.5 * (x[:, None] == y[None, :]).sum()
    return {
        "diff_lo": float(lo), "diff_hi": float(hi), "u": float(greater),
        "p_mw": mann_whitney_p(float(greater), nx, ny, repeats[repeats > 1]),
        "p_perm": float(np.mean(gaps >= observed - SLACK)), "n_perm": int(len(gaps)), "exact": exact,
    }


RESAMPLED = [
    T.StructField("diff_lo", T.DoubleType()), T.StructField("diff_hi", T.DoubleType()),
    T.StructField("u", T.DoubleType()), T.StructField("p_mw", T.DoubleType()),
    T.StructField("p_perm", T.DoubleType()), T.StructField("n_perm", T.LongType()),
    T.StructField("exact", T.BooleanType()),
]


def resampling_tests(pairs: DataFrame, n_boot: int = N_RESAMPLES, seed: int = SEED) -> DataFrame:
    """Adds the bootstrap interval of the mean difference, rank-sum and permutation p-values."""
    schema = T.StructType(list(pairs.schema.fields) + RESAMPLED)
    names = [f.name for f in RESAMPLED]

    def run(batches):
        for pdf in batches:
            rows = [
                _resample(np.asarray(x, float), np.asarray(y, float), n_boot, seed)
                for x, y in zip(pdf["x"], pdf["y"])
            ]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    # tests are costly against their few bytes of input: spread them over the cluster
    return pairs.repartition("cond_x", "cond_y", *[c for c in pairs.columns if c == "metric"]).mapInPandas(
        run, schema
    )


#: Prime of the counter generator, and what sets the draws of the second vector apart.
PRIME, OTHER_SIDE = 2_147_483_647, 1_000_000


def drawn_place(base: Column, draw: Column, place: Column, n: Column) -> Column:
    """A place below ``n`` for each (draw, place): three rounds of a quadratic map modulo a prime.

    It depends on its arguments alone, so draws can be made anywhere and in any order.
    """
    x = F.pmod(base + draw * 1_000_003 + place * 7_919, F.lit(PRIME))
    for _ in range(3):
        x = (x * x + x * 48_271 + 11) % PRIME
    return x % n


def bootstrap_diff_ci(
    pairs: DataFrame, keys: Sequence[str], n_boot: int = N_RESAMPLES, seed: int = SEED, chunk: int = 500
) -> DataFrame:
    """Bootstrap interval of the mean difference: (keys, conditions, diff_lo, diff_hi, n_boot).

    Draws come from a counter generator keyed by the pair, so a pair is ``n_boot / chunk`` pieces
    of work that any task can do, and SQL can state the result. Only the ``n_boot`` differences
    of a pair meet, in its quantiles. ``resampling_tests`` is the seeded form of one task a pair.
    """
    ids = [*keys, "cond_x", "cond_y"]
    base = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *ids)), 1, 7), 16, 10).cast("long")
    pieces = pairs.select(*ids, "x", "y", base.alias("_base"), F.explode(F.sequence(F.lit(0), F.lit(-(-n_boot // chunk) - 1))).alias("_c"))
    first = F.col("_c").cast("long") * chunk
    draws = pieces.repartition(*ids, "_c").select(
        *ids, "x", "y", "_base", F.explode(F.sequence(first, F.least(first + chunk, F.lit(n_boot).cast("long")) - 1)).alias("_d"))

    def mean(side: str, offset: int) -> Column:
        n = F.size(side).cast("long")
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        at = lambda k: drawn_place(F.col("_base"), F.col("_d"), k + offset, n)
        return F.aggregate(places, F.lit(0.0), lambda total, k: total + F.get(F.col(side), at(k).cast("int"))) / n

    gaps = draws.select(*ids, (mean("x", 0) - mean("y", OTHER_SIDE)).alias("_gap"))
    quantiles = [F.percentile("_gap", q / 100.0).alias(name) for q, name in zip(QUANTILES, ("diff_lo", "diff_hi"))]
    return gaps.groupBy(*ids).agg(*quantiles, F.count(F.lit(1)).alias("n_boot"))


def compare_conditions(
    vectors: DataFrame, keys: Sequence[str] = ("metric",), mode: str = "all_ordered",
    reference: str | None = None, n_boot: int = N_RESAMPLES, seed: int = SEED,
) -> DataFrame:
    """The whole battery per metric and pair of conditions."""
    values = clean_values(vectors)
    pairs = condition_pairs(values, [*keys, "log10"], mode, reference)
    tested = cohens_d(welch_p(welch_t(pairs)))
    out = resampling_tests(tested, n_boot, seed)
    return out.withColumn("diff_mean", F.col("mean_x") - F.col("mean_y")).drop("x", "y")


def per_replicate_fits(files: DataFrame) -> DataFrame:
    """alpha and k_alpha per (condition, pair) from fit payloads (condition, pair, rep, value).

    Older payloads name the prefactor D; replicates missing either number are dropped.
    """
    fit = F.get_json_object("value", "$.alpha_fit")
    alpha = F.get_json_object(fit, "$.alpha").try_cast("double")
    k = F.coalesce(
        F.get_json_object(fit, "$.K_alpha"), F.get_json_object(fit, "$.D")
    ).try_cast("double")
    rows = files.select("condition", "pair", "rep", alpha.alias("alpha"), k.alias("k_alpha"))
    return rows.where(F.col("alpha").isNotNull() & F.col("k_alpha").isNotNull())
