"""Contact frequency against genomic distance: curves, fits, slopes and interpolation.

Curves are long tables (keys, d, p): one row per bin distance, at most one row per bin of a
locus, so windows over a curve are bounded by the locus size, not by the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromloom.functions.joins import attach
from chromloom.functions.numeric import is_positive, log10_pos, ols

# fixed values of the published analysis
FIT_LO_BP, FIT_HI_BP = 2_000, 30_000
MAGNITUDE_AT_BP = {
    "10kb": 10_000, "50kb": 50_000, "100kb": 100_000, "200kb": 200_000, "500kb": 500_000,
    "1mb": 1_000_000,
}
SLOPE_AT_BP = {"5kb": 5_000, "10kb": 10_000, "50kb": 50_000, "100kb": 100_000, "500kb": 500_000}
DERIVATIVE_AT_BP = {
    "10kb": 10_000, "50kb": 50_000, "100kb": 100_000, "500kb": 500_000, "1mb": 1_000_000,
}
LOOP_SEARCH_BP = (20_000, 2_000_000)
SHORT_RANGE_BP = (5_000, 30_000)
DOMAIN_RANGE_BP = (100_000, 1_000_000)


def ps_curve(
    pixels: DataFrame, keys: Sequence[str], n_bins: int, value: str = "v", min_diag: int = 0
) -> DataFrame:
    """Mean contact frequency at each distance; absent pixels count as zero.

    Diagonal d of an n-bin map has n-d cells, whatever number of pixels is stored. Distances
    without a pixel are filled from the gap to the next stored one, so no grid is joined. The
    first ``min_diag`` distances become NULL (experimental maps). Pixels of later bins than
    ``n_bins`` are cropped.
    """
    sums = pixels.where(F.col("j") < n_bins).groupBy(*keys, (F.col("j") - F.col("i")).cast("int").alias("_d")).agg(
        F.sum(value).alias("_s")
    )
    return curve_of_sums(sums, keys, n_bins, min_diag)


def curve_of_sums(sums: DataFrame, keys: Sequence[str], n_bins: int, min_diag: int = 0) -> DataFrame:
    """The curve of :func:`ps_curve` from the sums ``_s`` of stored diagonals ``_d``."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("_d")
    first = F.lag("_d").over(w).isNull()
    until = F.lead("_d", 1, n_bins).over(w) - 1
    filled = sums.select(
        *keys, "_d", "_s",
        F.when(first, F.lit(0)).otherwise(F.col("_d")).alias("_from"), until.alias("_to"),
    ).withColumn("d", F.explode(F.sequence("_from", "_to")))
    p = F.when(F.col("d") == F.col("_d"), F.col("_s")).otherwise(F.lit(0.0)) / (
        F.lit(n_bins) - F.col("d")
    )
    return filled.select(*keys, "d", F.when(F.col("d") >= min_diag, p).alias("p"))


def _fit_columns(resolution: int, lo_bp: int, hi_bp: int) -> dict[str, Column]:
    s = F.col("d") * resolution
    use = (s >= lo_bp) & (s < hi_bp) & is_positive(F.col("p"))
    fit = ols(F.when(use, F.log10(s)), F.when(use, log10_pos(F.col("p"))))
    enough = fit["n"] > 2
    return {
        "n_points": fit["n"],
        "exponent": F.when(enough, -fit["slope"]),
        "log_intercept": F.when(enough, fit["intercept"]),
    }


def powerlaw_fit(
    curve: DataFrame, keys: Sequence[str], resolution: int,
    lo_bp: int = FIT_LO_BP, hi_bp: int = FIT_HI_BP,
) -> DataFrame:
    """Straight line through log10 P against log10 s for lo <= s < hi; needs three points."""
    columns = _fit_columns(resolution, lo_bp, hi_bp)
    return curve.groupBy(*keys).agg(*[c.alias(name) for name, c in columns.items()])


def poly6_fit(
    curve: DataFrame, keys: Sequence[str], resolution: int, hi_bp: int = FIT_LO_BP, degree: int = 6
) -> DataFrame:
    """Degree-six polynomial of log P on log s below ``hi_bp``; needs more than seven points.

    Coefficients run from the highest power down. Abscissas are centred and scaled to -1..1, so one
    aggregate of power sums holds all that the least squares need, whatever the number of points;
    its symmetric system is solved, and the polynomial put back on the original axis, row by row.
    """
    keys, size = list(keys), degree + 1
    points = curve.where(
        (F.col("d") > 0) & (F.col("d") * resolution < hi_bp) & is_positive(F.col("p"))
    ).select(*keys, F.log10(F.col("d") * resolution).alias("_x"), F.log10("p").alias("_y"))
    ends = points.groupBy(*keys).agg(
        ((F.min("_x") + F.max("_x")) / 2).alias("_mid"), F.greatest((F.max("_x") - F.min("_x")) / 2, F.lit(1e-300)).alias("_half"))
    z = (F.col("_x") - F.col("_mid")) / F.col("_half")
    powers = [F.lit(1.0)]
    placed = attach(points, ends, keys).withColumn("_z", z)
    for _ in range(2 * degree):
        powers.append(powers[-1] * F.col("_z"))
    rows = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), F.max("_mid").alias("_mid"), F.max("_half").alias("_half"),
        *[F.sum(p).alias(f"_s{k}") for k, p in enumerate(powers)], *[F.sum(powers[k] * F.col("_y")).alias(f"_b{k}") for k in range(size)])
    # a factor L of the power-sum matrix (L times its transpose) column by column, then two substitutions
    for j in range(size):
        pivot = F.col(f"_s{2 * j}") - sum((F.col(f"_l{j}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0))
        rows = rows.withColumn(f"_l{j}{j}", F.sqrt(F.greatest(pivot, F.lit(1e-300))))
        rows = rows.withColumns({
            f"_l{i}{j}": (F.col(f"_s{i + j}") - sum((F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"_l{j}{j}")
            for i in range(j + 1, size)
        }) if j < degree else rows
    for i in range(size):
        done = sum((F.col(f"_l{i}{k}") * F.col(f"_u{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"_u{i}", (F.col(f"_b{i}") - done) / F.col(f"_l{i}{i}"))
    for i in reversed(range(size)):
        done = sum((F.col(f"_l{k}{i}") * F.col(f"_c{k}") for k in range(i + 1, size)), F.lit(0.0))
        rows = rows.withColumn(f"_c{i}", (F.col(f"_u{i}") - done) / F.col(f"_l{i}{i}"))
    # (x - mid) / half to the k, spread over the powers of x
    back = [
        sum((F.col(f"_c{k}") / F.pow("_half", F.lit(float(k))) * math.comb(k, p) * F.pow(-F.col("_mid"), F.lit(float(k - p))) for k in range(p, size)), F.lit(0.0))
        for p in reversed(range(size))
    ]
    return rows.select(*keys, "n_points", F.when(F.col("n_points") > size, F.array(*back)).alias("coefficients"))


def log_gradient(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "slope") -> DataFrame:
    """Second-order slope dy/dx on an uneven axis, one-sided at both ends of each curve."""
    w = W.partitionBy(*keys).orderBy(x)
    left, right = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    down, up = F.lag(y).over(w), F.lead(y).over(w)
    here = F.col(y)
    inner = (
        left * left * up + (right * right - left * left) * here - right * right * down
    ) / (left * right * (left + right))
    slope = (
        F.when(left.isNull(), (up - here) / right)
        .when(right.isNull(), (here - down) / left)
        .otherwise(inner)
    )
    return df.withColumn(out, slope)


def local_slopes(curve: DataFrame, keys: Sequence[str], resolution: int) -> DataFrame:
    """Slope of log P on log s at every positive point of a curve, with its rank in the curve."""
    s = (F.col("d") * resolution).cast("long")
    valid = curve.where((F.col("d") > 0) & is_positive(F.col("p"))).select(
        *keys, "d", s.alias("s"), F.log10(s).alias("log_s"), F.log10("p").alias("log_p")
    )
    whole = W.partitionBy(*keys)
    return (
        log_gradient(valid, keys, "log_s", "log_p")
        .withColumn("rank", F.row_number().over(whole.orderBy("d")) - 1)
        .withColumn("n_valid", F.count(F.lit(1)).over(whole))
    )


def ps_metrics(curve: DataFrame, keys: Sequence[str], resolution: int) -> DataFrame:
    """Magnitudes at reference distances, slopes near reference distances and the fit.

    Slopes need more than five points, sit at the nearest valid distance (shorter on ties) and
    are left out within two points of either end. One pass: invalid points stay in the curve but
    form a window partition of their own.
    """
    keys = list(keys)
    s = (F.col("d") * resolution).cast("long")
    ok = (F.col("d") > 0) & is_positive(F.col("p"))
    flagged = curve.withColumn("_ok", ok).withColumn("_s", s).withColumn(
        "_lx", F.when(F.col("_ok"), F.log10("_s"))
    ).withColumn("_ly", F.when(F.col("_ok"), F.log10("p")))
    group = W.partitionBy(*keys, "_ok")
    sloped = (
        log_gradient(flagged, [*keys, "_ok"], "_lx", "_ly", "_slope")
        .withColumn("_rank", F.row_number().over(group.orderBy("d")) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(group))
    )
    inside = (F.col("_rank") >= 2) & (F.col("_rank") < F.col("_n") - 2) & (F.col("_n") > 5)
    usable = F.struct(F.when(inside, F.col("_slope")).alias("m"))
    at = [
        F.max(F.when(F.col("d") == int(round(bp / resolution)), F.col("p"))).alias(f"p_{label}")
        for label, bp in MAGNITUDE_AT_BP.items()
    ]
    near = [
        F.min_by(
            usable, F.when(F.col("_ok"), F.struct(F.abs(F.col("_s") - bp), F.col("_s")))
        )["m"].alias(f"slope_{label}")
        for label, bp in SLOPE_AT_BP.items()
    ]
    fit = _fit_columns(resolution, FIT_LO_BP, FIT_HI_BP)
    return sloped.groupBy(*keys).agg(
        *at, *[fit[c].alias(c) for c in ("exponent", "log_intercept")], *near
    )


def _segments(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Each point with the next one of its curve: _x0, _y0, _x1, _y1 and whether it is the first."""
    w = W.partitionBy(*keys).orderBy(x)
    return points.select(
        *keys,
        F.col(x).alias("_x0"), F.col(y).alias("_y0"),
        F.lead(x).over(w).alias("_x1"), F.lead(y).over(w).alias("_y1"),
        F.lag(x).over(w).isNull().alias("_first"),
    )


def _on_segment(t: Column, clamp: bool) -> tuple[Column, Column]:
    """(whether this segment answers target ``t``, the value there)."""
    last = F.col("_x1").isNull()
    covers = (t >= F.col("_x0")) & (t < F.col("_x1"))
    end = last & (t >= F.col("_x0") if clamp else t == F.col("_x0"))
    before = F.col("_first") & (t < F.col("_x0")) & F.lit(clamp)
    step = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (t - F.col("_x0")) / (
        F.col("_x1") - F.col("_x0")
    )
    return (
        F.coalesce(covers, F.lit(False)) | end | before,
        F.when(end | before, F.col("_y0")).otherwise(step),
    )


def interp_loglog(
    curve: DataFrame, keys: Sequence[str], s: Column, targets: dict[str, float]
) -> DataFrame:
    """P at given distances by log-log interpolation, one column per target.

    NULL outside the curve or for curves of fewer than two positive points. Targets are
    constants, so each segment answers those it covers and no join is needed.
    """
    keys = list(keys)
    ok = (F.col("_s") > 0) & is_positive(F.col("p"))
    flagged = curve.withColumn("_s", s).withColumn("_ok", ok).select(
        *keys, "_ok", F.when(F.col("_ok"), F.log10("_s")).alias("_lx"),
        F.when(F.col("_ok"), F.log10("p")).alias("_ly"),
    )
    segments = _segments(flagged, [*keys, "_ok"], "_lx", "_ly")
    n = F.count("_x0")
    columns = []
    for name, bp in targets.items():
        answers, value = _on_segment(F.log10(F.lit(float(bp))), clamp=False)
        found = F.max(F.when(F.col("_ok") & answers, value))
        columns.append(F.when(n >= 2, F.pow(F.lit(10.0), found)).alias(name))
    return segments.groupBy(*keys).agg(*columns)


def _gaussian_weights(sigma: float) -> list[float]:
    half = max(1, int(np.ceil(4.0 * sigma)))
    x = np.arange(-half, half + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return (w / w.sum()).tolist()


def _weighted_neighbours(arr: Column, weights: Sequence[float]) -> Column:
    """Weighted sum around each element; the array is mirrored at its ends, edge not repeated."""
    half = len(weights) // 2
    last = F.size(arr) - 1

    def at(i: Column, o: int) -> Column:
        k = F.abs(i + o)
        return F.get(arr, F.when(k > last, 2 * last - k).otherwise(k))

    def one(_, i: Column) -> Column:
        total = F.lit(0.0)
        for o, w in zip(range(-half, len(weights) - half), weights):
            total = total + at(i, o) * F.lit(float(w))
        return total

    return F.transform(arr, one)


def gaussian_smooth(arr: Column, sigma: float = 0.8) -> Column:
    """Gaussian smoothing of an array column; short arrays are returned unchanged."""
    w = _gaussian_weights(max(1e-6, sigma))
    return F.when(F.size(arr) < len(w), arr).otherwise(_weighted_neighbours(arr, w))


def moving_average(arr: Column, window: int) -> Column:
    """Centred mean of odd width; arrays shorter than 2*window+1 are returned unchanged."""
    window = max(1, int(window))
    if window == 1:
        return arr
    flat = _weighted_neighbours(arr, [1.0 / window] * window)
    return F.when(F.size(arr) < 2 * window + 1, arr).otherwise(flat)


def ps_derivative(
    curve: DataFrame, keys: Sequence[str], resolution: int,
    s_min_bp: float = 5_000.0, s_max_bp: float = 2_000_000.0, n_grid: int = 80,
    smoothing: str = "gaussian", sigma: float = 0.8, window: int = 5,
) -> DataFrame:
    """Slope of the smoothed curve on ``n_grid`` log-spaced distances: (keys, k, s, log_p, slope).

    Curves with fewer than ten positive points, or no width, give no rows. Every segment of a
    curve emits the grid points it covers, so the curve is read once.
    """
    keys = list(keys)
    s = (F.col("d") * resolution).cast("double")
    whole = W.partitionBy(*keys)
    points = curve.where((F.col("d") > 0) & is_positive(F.col("p"))).select(
        *keys, s.alias("s"), F.log10(s).alias("log_s"), F.log10("p").alias("log_p")
    )
    lo = F.log10(F.greatest(F.lit(float(s_min_bp)), F.min("s").over(whole)))
    hi = F.log10(F.least(F.lit(float(s_max_bp)), F.max("s").over(whole)))
    spans = points.withColumn("_lo", lo).withColumn("_hi", hi).withColumn(
        "_n", F.count(F.lit(1)).over(whole)
    ).where("_n >= 10 AND _hi > _lo")
    step = (F.col("_hi") - F.col("_lo")) / (n_grid - 1)
    pieces = _segments(spans, [*keys, "_lo", "_hi"], "log_s", "log_p")

    def grid_index(x: Column, shift: int) -> Column:
        k = F.floor((x - F.col("_lo")) / step) + shift
        return F.greatest(F.lit(0), F.least(F.lit(n_grid - 1), k.cast("int")))

    # one index more on either side than the segment spans; the exact test follows
    low = F.when(F.col("_first"), F.lit(0)).otherwise(grid_index(F.col("_x0"), -1))
    high = F.when(F.col("_x1").isNull(), F.lit(n_grid - 1)).otherwise(grid_index(F.col("_x1"), 1))
    candidates = pieces.withColumn("k", F.explode(F.sequence(low, high))).withColumn(
        "log_s", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("k") / (n_grid - 1)
    )
    answers, value = _on_segment(F.col("log_s"), clamp=True)
    on_grid = candidates.where(answers).select(*keys, "k", "log_s", value.alias("log_p"))
    arrays = on_grid.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("k", "log_s", "log_p"))).alias("g")
    )
    raw = F.col("g")["log_p"]
    smooth = gaussian_smooth(raw, sigma) if smoothing == "gaussian" else moving_average(raw, window)
    rows = arrays.withColumn("_smooth", smooth).select(
        *keys, F.explode(F.arrays_zip("g", "_smooth")).alias("r")
    ).select(*keys, "r.g.k", "r.g.log_s", "r.g.log_p", "r._smooth")
    return log_gradient(rows, keys, "log_s", "_smooth").select(
        *keys, "k", F.pow(F.lit(10.0), "log_s").alias("s"), "log_s", "log_p", "slope"
    )


def derivative_summary(derivative: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per curve: slopes at references, extremes with their place, window means.

    The highest slope is sought inside the loop-size window, or anywhere if it holds no point;
    its distance is the inferred mean loop size.
    """
    keys = list(keys)
    s, slope = F.col("s"), F.col("slope")
    w = W.partitionBy(*keys).orderBy("log_s")
    segments = derivative.select(
        *keys, "s", "slope", F.col("log_s").alias("_x0"), F.col("slope").alias("_y0"),
        F.lead("log_s").over(w).alias("_x1"), F.lead("slope").over(w).alias("_y1"),
        F.lag("log_s").over(w).isNull().alias("_first"),
    )
    loops = s.between(*LOOP_SEARCH_BP)
    best_in = F.max_by(s, F.when(loops, F.struct(slope, -s)))
    best_all = F.max_by(s, F.struct(slope, -s))
    slopes_at = []
    for label, bp in DERIVATIVE_AT_BP.items():
        answers, value = _on_segment(F.log10(F.lit(float(bp))), clamp=False)
        slopes_at.append(F.max(F.when(answers, value)).alias(f"slope_at_{label}"))
    return segments.groupBy(*keys).agg(
        F.min(slope).alias("slope_min"),
        F.min_by(s, F.struct(slope, s)).alias("s_at_slope_min_bp"),
        F.coalesce(F.max(F.when(loops, slope)), F.max(slope)).alias("slope_max"),
        F.coalesce(best_in, best_all).alias("s_at_slope_max_bp"),
        F.coalesce(best_in, best_all).alias("inferred_mean_loop_size_bp"),
        (-F.min(slope)).alias("loop_density_proxy_slope_min_depth"),
        F.avg(F.when(s.between(*SHORT_RANGE_BP), slope)).alias("slope_mean_shortrange"),
        F.avg(F.when(s.between(*DOMAIN_RANGE_BP), slope)).alias("slope_mean_tadrange"),
        *slopes_at,
    )


def ps_relative(curve: DataFrame, keys: Sequence[str], resolution: int, ref_bp: int = 10_000) -> DataFrame:
    """Each curve divided by its own value at the positive point nearest ``ref_bp``."""
    keys = list(keys)
    s = F.col("d") * resolution
    valid = (F.col("d") > 0) & is_positive(F.col("p"))
    ref = F.min_by("p", F.when(valid, F.struct(F.abs(s - ref_bp), s))).over(W.partitionBy(*keys))
    return curve.select(*keys, "d", (F.col("p") / ref).alias("relative"))


def labelled(curves: dict[str, DataFrame], column: str = "curve") -> DataFrame:
    """One long table of several curves (for example simulated and experimental)."""
    out: DataFrame | None = None
    for label, df in curves.items():
        part = df.withColumn(column, F.lit(label))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no curves")
    return out
