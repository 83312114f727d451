"""Reports per condition, composed of the operators and keyed by condition.

Heavy inputs (pixels, traces) are passed in as tables; on a cluster they are stored stages
(:func:`chromloom.sinks.tables.reuse_or_build`), so each report only re-reads small tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromloom.operators import calibrate, curves, dynamics, loops, maps


def long_metrics(wide: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """One row (keys, group, metric, value) per number of a wide report."""
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        list(keys), names, "metric", "value"
    ).withColumn("group", F.lit(group))


def map_report(
    pixels: DataFrame, keys: Sequence[str], n_bins: int, resolution: int, window: int
) -> dict[str, DataFrame]:
    """Curve, its derivative and summary, insulation, and scalar metrics of each map."""
    curve = curves.ps_curve(pixels, keys, n_bins)
    derivative = curves.ps_derivative(curve, keys, resolution)
    metrics = long_metrics(curves.ps_metrics(curve, keys, resolution), keys, "P(s)")
    slopes = long_metrics(curves.derivative_summary(derivative, keys), keys, "P(s)_derivative")
    return {
        "curve": curve, "derivative": derivative,
        "insulation": maps.insulation(pixels, keys, n_bins, window),
        "metrics": metrics.unionByName(slopes),
    }


def loop_report(
    pixels: DataFrame, sites_loops: DataFrame, keys: Sequence[str], n_bins: int, pad: int, **able
) -> dict[str, DataFrame]:
    """Pile-up of the loops of each map, its strength, and scores per loop with their summary."""
    curve = curves.ps_curve(pixels, keys, n_bins)
    pileup = loops.apa_pileup(pixels, sites_loops, keys, n_bins, pad)
    scores = loops.able_score(pixels, sites_loops, curve, keys, n_bins, **able)
    summary = long_metrics(loops.apa_strength_summary(scores, keys), keys, "AbLE")
    strength = long_metrics(loops.loop_strength(pileup, keys), keys, "AbLE")
    return {"pileup": pileup, "scores": scores, "metrics": summary.unionByName(strength)}


def comparison_report(
    sim: DataFrame, exp: DataFrame, keys: Sequence[str], n_bins: int, resolution: int, window: int,
    max_diag: int | None = None,
) -> DataFrame:
    """Agreement of simulated and experimental maps as long metrics."""
    wide = maps.compare_maps(sim, exp, keys, n_bins, resolution, max_diag, window)
    return long_metrics(wide, keys, "sim_vs_exp")


def dynamics_report(
    trace: DataFrame, keys: Sequence[str], tile: str, t: str, radius: float, block: int = dynamics.BLOCK,
    min_points: int = dynamics.FIT_MIN_POINTS, lag_min: int = dynamics.FIT_LAG_MIN,
) -> DataFrame:
    """Looped fraction, dwell statistics, distance moments and displacement fit of each pair.

    Every part reads the same trace; store it before when it is expensive to rebuild.
    """
    keys = list(keys)
    runs = dynamics.contact_runs(trace, [*keys, tile], t, F.col("dist") < radius)
    per_tile = dynamics.msd(trace, [*keys, tile], t, block=block)
    fit = dynamics.msd_powerlaw_fit(
        dynamics.pooled_msd(per_tile, keys), keys, lag_min=lag_min, min_points=min_points
    )
    looped = dynamics.looped_fraction(trace, keys, tile, radius)
    moments = trace.groupBy(*keys).agg(
        F.avg("dist").alias("mean_d"), F.stddev_pop("dist").alias("std_d")
    )
    dwell = dynamics.dwell_stats(runs, keys, looped.select(*keys))
    wide = (
        looped.select(*keys, "looped_fraction", F.col("sem").alias("looped_sem"))
        .join(dwell.select(*keys, "n_dwells", F.col("mean").alias("dwell_mean"),
                           F.col("median").alias("dwell_median"), F.col("max").alias("dwell_max")), keys)
        .join(moments, keys)
        .join(fit.select(*keys, "alpha", "k_alpha"), keys, "left")
    )
    return long_metrics(wide, keys, "dynamics")


def quick_report(
    pixels: DataFrame, references: DataFrame, keys: Sequence[str], n_bins: int, resolution: int, window: int
) -> DataFrame:
    """One-map analysis: curve metrics, and agreement with every reference map.

    ``pixels`` carry a ``target`` column naming the run's own reference; ``references`` are maps
    keyed by ``reference``, a short list. The row of the own reference is flagged.
    """
    keys = list(keys)
    names = references.agg(F.sort_array(F.collect_set("reference")).alias("r"))
    runs = pixels.withColumn("reference", F.explode(names.scalar()))
    both = [*keys, "target", "reference"]
    targets = runs.select(*both).distinct()
    exp = references.join(targets, "reference")
    cells = maps.join_maps(runs, exp, both, n_bins)
    out = maps.overall_pearson(cells, both).join(
        maps.scc(maps.diag_pearson(cells, both, n_bins), both, n_bins), both, "left"
    )
    curve = curves.ps_curve(pixels, keys, n_bins)
    fits = curves.powerlaw_fit(curve, keys, resolution).select(*keys, "exponent")
    return out.join(fits, keys, "left").withColumn("is_target", F.col("reference") == F.col("target"))


def calibrated_msd(
    curve: DataFrame, anchor: str, keys: Sequence[str], resolution: int, sim_curve: DataFrame,
    exp_curve: DataFrame | None = None, exp_msd: DataFrame | None = None,
) -> DataFrame:
    """Displacement in physical units by the chosen anchor, assumed units where it has no data."""
    hic = calibrate.calibrate_hic(sim_curve, exp_curve, keys, resolution) if exp_curve is not None else None
    by_msd = calibrate.calibrate_msd(curve, exp_msd, keys) if exp_msd is not None else None
    units = calibrate.calibration(anchor, curve, keys, hic, by_msd)
    if units is None:
        return curve.select(*keys, F.col("lag").alias("lag_s"), F.col("msd").alias("msd_nm2"))
    return calibrate.calibrate_units(curve, units, keys)


def hit(radius: float) -> Column:
    """Whether a pair is in contact: strictly closer than the radius."""
    return F.col("dist") < radius
