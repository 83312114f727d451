"""Loop measures on maps: pile-ups, strength ratios, background-subtracted scores.

Loops are rows (keys, anchor1, anchor2) in bins. Images around loops are cut from sparse maps
by an equi-join on coarse map blocks, so neither maps nor images are ever dense tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromloom.functions.kernels import gaussian_blur, local_maxima
from chromloom.functions.numeric import ratio

LOOP = ("anchor1", "anchor2")

# fixed values: defaults of the published score
LOCAL_BINS, DISK_BINS, DIAG_CUTOFF, STRIPE_CUTOFF = 50, 10, 5, 5
BLUR_SIGMA, BLUR_TRUNCATE, OUTLIER_RADIUS, K_MIN = 10.0, 1.5, 10.0, 2.0


def distinct_loops(loops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (keys, anchors) with the number of copies: images are cut once per place."""
    return loops.groupBy(*keys, *LOOP).agg(F.count(F.lit(1)).alias("copies"))


def _blocks(lo: Column, hi: Column, width: int) -> Column:
    return F.sequence(F.floor(lo / width).cast("int"), F.floor(hi / width).cast("int"))


def image_cells(
    pixels: DataFrame, loops: DataFrame, keys: Sequence[str], pad: int, value: str = "v"
) -> DataFrame:
    """Stored cells of the (2*pad+1)^2 image of each loop: loop columns, di, dj, value.

    Both triangles are used; lower cells can only be met within 2*pad of the diagonal.
    """
    keys, width = list(keys), 2 * pad + 1
    cells = pixels.select(*keys, "i", "j", F.col(value).alias("_v"))
    lower = cells.where((F.col("j") > F.col("i")) & (F.col("j") - F.col("i") < 2 * pad)).select(
        *keys, F.col("j").alias("i"), F.col("i").alias("j"), "_v"
    )
    both = cells.unionByName(lower).withColumn(
        "_bi", F.floor(F.col("i") / width).cast("int")
    ).withColumn("_bj", F.floor(F.col("j") / width).cast("int"))
    a, b = F.col("anchor1"), F.col("anchor2")
    placed = loops.withColumn("_bi", F.explode(_blocks(a - pad, a + pad, width))).withColumn(
        "_bj", F.explode(_blocks(b - pad, b + pad, width))
    )
    di, dj = F.col("i") - a, F.col("j") - b
    return (
        placed.join(both, [*keys, "_bi", "_bj"])
        .where((F.abs(di) <= pad) & (F.abs(dj) <= pad))
        .select(*loops.columns, di.cast("int").alias("di"), dj.cast("int").alias("dj"),
                F.col("_v").alias(value))
    )


def fits(n_bins: int, pad: int) -> Column:
    """Whether the image of a loop lies inside the map."""
    a, b = F.col("anchor1"), F.col("anchor2")
    return (
        (F.least(a, b) - pad >= 0) & (F.greatest(a, b) + pad + 1 <= n_bins)
    )


def apa_pileup(
    pixels: DataFrame, loops: DataFrame, keys: Sequence[str], n_bins: int, pad: int = 10,
    curve: DataFrame | None = None, value: str = "v",
) -> DataFrame:
    """Mean image over all loops inside the map: (keys, di, dj, value, n_used), zeros included.

    With ``curve`` each image is divided by the curve at the loop's size; loops whose expected
    value is not above zero are skipped.
    """
    keys = list(keys)
    used = distinct_loops(loops.where(fits(n_bins, pad)), keys).withColumn("_scale", F.lit(1.0))
    if curve is not None:
        expected = curve.select(*keys, F.col("d").alias("_size"), F.col("p").alias("_p"))
        used = (
            used.withColumn("_size", (F.col("anchor2") - F.col("anchor1")).cast("int"))
            .join(expected, [*keys, "_size"]).where(F.col("_p") > 0)
            .withColumn("_scale", 1.0 / F.col("_p")).drop("_size", "_p")
        )
    totals = used.groupBy(*keys).agg(F.sum("copies").alias("n_used"))
    sums = image_cells(pixels, used, keys, pad, value).groupBy(*keys, "di", "dj").agg(
        F.sum(F.col(value) * F.col("copies") * F.col("_scale")).alias("_s")
    )
    side = F.sequence(F.lit(-pad), F.lit(pad))
    grid = totals.withColumn("di", F.explode(side)).withColumn("dj", F.explode(side))
    return grid.join(sums, [*keys, "di", "dj"], "left").select(
        *keys, "di", "dj",
        (F.coalesce(F.col("_s"), F.lit(0.0)) / F.col("n_used")).alias(value), "n_used",
    )


def loop_strength(pileup: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Mean of the central 3x3 over the mean of the 3x3 block up-left of it; NULL if that is 0."""
    di, dj = F.col("di"), F.col("dj")
    centre = F.avg(F.when(di.between(-1, 1) & dj.between(-1, 1), F.col(value)))
    flank = F.avg(F.when(di.between(-4, -2) & dj.between(-4, -2), F.col(value)))
    return pileup.groupBy(*keys).agg(ratio(centre, flank).alias("strength"))


def loop_oe(pixels: DataFrame, loops: DataFrame, curve: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Observed over expected at the loop pixel; zero where the pixel is absent, NULL where the
    expected value is zero."""
    keys = list(keys)
    a, b = F.least(*LOOP), F.greatest(*LOOP)
    at = loops.withColumn("_i", a).withColumn("_j", b).withColumn("_d", (b - a).cast("int"))
    seen = pixels.select(
        *keys, F.col("i").alias("_i"), F.col("j").alias("_j"), F.col(value).alias("_v")
    )
    expected = curve.select(*keys, F.col("d").alias("_d"), F.col("p").alias("expected"))
    return (
        at.join(seen, [*keys, "_i", "_j"], "left").join(expected, [*keys, "_d"], "left")
        .withColumn("observed", F.coalesce(F.col("_v"), F.lit(0.0)))
        .withColumn("oe", ratio(F.col("observed"), F.col("expected")))
        .drop("_i", "_j", "_d", "_v")
    )


def able_linear(
    pixels: DataFrame, loops: DataFrame, curve: DataFrame, keys: Sequence[str], n_bins: int,
    local: int = LOCAL_BINS, disk: int = DISK_BINS, diag_cutoff: int = DIAG_CUTOFF, value: str = "v",
) -> DataFrame:
    """Loop score without outlier removal for loops whose image lies inside a map without gaps.

    The score is the disk sum of image - c*P(s), where c is the least-squares scale of the
    curve to the image over the local diamond. Both are sums, so no solver and no dense image is
    needed: stored cells give the image sums, geometry and curve give the rest.
    """
    keys = list(keys)
    at = distinct_loops(loops.where(fits(n_bins, local)), keys).drop("copies").withColumn(
        "_size", (F.col("anchor2") - F.col("anchor1")).cast("int")
    )
    x, y = F.col("di"), F.col("dj")
    on_disk = x * x + y * y <= disk * disk
    in_fit = (F.abs(x) + F.abs(y) <= local) & (F.col("_s") > diag_cutoff)
    s = F.greatest(F.col("_size") + y - x, F.lit(0))
    p = curve.select(*keys, F.col("d").alias("_s"), F.col("p").alias("_p"))
    image = image_cells(pixels, at, keys, local, value).withColumn("_s", s).join(p, [*keys, "_s"])
    seen = image.groupBy(*keys, *LOOP).agg(
        F.sum(F.when(in_fit, F.col("_p") * F.col(value))).alias("_pv"),
        F.sum(F.when(on_disk & (F.col("_p") > 0), F.col(value))).alias("_disk"),
    )
    # geometry depends on the loop size only: cells of the image per (size, s)
    side = F.sequence(F.lit(-local), F.lit(local))
    shape = (
        at.select(*keys, "_size").distinct()
        .withColumn("_diff", F.explode(F.sequence(F.lit(-2 * local), F.lit(2 * local))))
        .withColumn("_s", F.greatest(F.col("_size") + F.col("_diff"), F.lit(0)))
    )
    cells = F.filter(side, lambda r: F.abs(r + F.col("_diff")) <= local)
    fit_cells = F.size(F.filter(cells, lambda r: F.abs(r) + F.abs(r + F.col("_diff")) <= local))
    disk_cells = F.size(F.filter(
        cells, lambda r: r * r + (r + F.col("_diff")) * (r + F.col("_diff")) <= disk * disk
    ))
    geometry = (
        shape.withColumn("_nf", F.when(F.col("_s") > diag_cutoff, fit_cells).otherwise(0))
        .withColumn("_nd", disk_cells).join(p, [*keys, "_s"])
        .groupBy(*keys, "_size").agg(
            F.sum(F.col("_nf") * F.col("_p") * F.col("_p")).alias("_pp"),
            F.sum(F.col("_nd") * F.col("_p")).alias("_bg"),
            F.sum(F.when(F.col("_p") > 0, F.col("_nd"))).alias("_n_centre"),
            F.sum("_nd").alias("n_pixels"),
        )
    )
    zero = F.lit(0.0)
    c = ratio(F.coalesce(F.col("_pv"), zero), F.col("_pp"))
    return at.join(seen, [*keys, *LOOP], "left").join(geometry, [*keys, "_size"]).select(
        *keys, *LOOP,
        (F.coalesce(F.col("_disk"), zero) - c * F.col("_bg")).alias("strength"),
        ratio(F.coalesce(F.col("_disk"), zero), F.col("_n_centre")).alias("center_mean"),
        (c * ratio(F.col("_bg"), F.col("n_pixels"))).alias("background_mean"),
        "n_pixels", c.alias("c_best_fit"),
    )


class _Score:
    """Geometry shared by all loops of one task and the score of one image."""

    def __init__(self, local, disk, diag_cutoff, k_min, sigma, outlier_radius, detect):
        self.local, self.cut, self.k_min = local, diag_cutoff, k_min
        self.sigma, self.radius, self.detect = sigma, outlier_radius, detect
        self.row, self.col = np.mgrid[-local:local + 1, -local:local + 1]
        self.diamond = np.abs(self.row) + np.abs(self.col) <= local
        self.disk = self.row**2 + self.col**2 <= disk * disk

    def fill(self, ratio_image: np.ndarray) -> tuple[np.ndarray | None, float]:
        """Replace gaps when whole rows or columns are missing; None when too near the centre."""
        gap = np.isnan(ratio_image)
        stripes = np.concatenate([np.flatnonzero(gap.all(axis=0)), np.flatnonzero(gap.all(axis=1))])
        if not len(stripes):
            return ratio_image, np.nan
        if np.any(np.abs(stripes - self.local) <= STRIPE_CUTOFF):
            return None, np.nan
        known = ratio_image[self.diamond]
        known = known[~np.isnan(known)]
        median = float(np.median(known)) if len(known) else np.nan
        return np.nan_to_num(ratio_image, nan=median), median

    def outliers(self, image: np.ndarray, background: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Strong local maxima of the blurred ratio image."""
        none = np.zeros(image.shape, dtype=bool)
        with np.errstate(all="ignore"):
            over = np.where(s <= self.cut, np.nan, image / background)
        over, _ = self.fill(over)
        if over is None or np.isnan(over).all():
            return none
        blurred = gaussian_blur(np.nan_to_num(over, nan=0.0), self.sigma, BLUR_TRUNCATE)
        blurred[~self.diamond] = np.nan
        median = np.nanmedian(blurred)
        if not np.isfinite(median):
            return none
        return local_maxima(blurred) & (np.nan_to_num(blurred, nan=-np.inf) > self.k_min * median)

    def __call__(self, image: np.ndarray, size: int, ps: np.ndarray) -> dict:
        s = np.maximum(size + self.col - self.row, 0)
        background = ps[np.minimum(s, len(ps) - 1)]
        out = {"strength": None, "center_mean": None, "background_mean": None,
               "n_pixels": int(self.disk.sum()), "c_best_fit": None, "n_outliers": 0, "fill": None}
        with np.errstate(all="ignore"):
            ratio_image, median = self.fill(image / background)
            if ratio_image is None:
                return out
            clean = ratio_image * background
        out["fill"] = None if np.isnan(median) else median
        if np.isnan(clean).all():
            return out
        fit = self.diamond & (s > self.cut) & np.isfinite(clean)
        if self.detect:
            strong = np.argwhere(self.outliers(image, background, s)) - self.local
            out["n_outliers"] = len(strong)
            for r, c in strong:
                fit &= (self.row - r) ** 2 + (self.col - c) ** 2 > self.radius**2
        if fit.sum() < 3:
            return out
        p = background[fit]
        weight = float(p @ p)
        scale = float(p @ clean[fit]) / weight if weight > 0 else 1.0
        disk = clean[self.disk]
        out["strength"] = float(np.nansum(disk - scale * background[self.disk]))
        out["center_mean"] = float(np.nanmean(disk)) if not np.isnan(disk).all() else None
        out["background_mean"] = float(np.mean(scale * background[self.disk]))
        out["c_best_fit"] = scale
        return out


SCORE_FIELDS = [
    T.StructField("strength", T.DoubleType()), T.StructField("center_mean", T.DoubleType()),
    T.StructField("background_mean", T.DoubleType()), T.StructField("n_pixels", T.LongType()),
    T.StructField("c_best_fit", T.DoubleType()), T.StructField("n_outliers", T.LongType()),
    T.StructField("fill", T.DoubleType()),
]


def able_score(
    pixels: DataFrame, loops: DataFrame, curve: DataFrame, keys: Sequence[str], n_bins: int,
    local: int = LOCAL_BINS, disk: int = DISK_BINS, diag_cutoff: int = DIAG_CUTOFF,
    k_min: float = K_MIN, sigma: float = BLUR_SIGMA, outlier_radius: float = OUTLIER_RADIUS,
    outliers: bool = True, value: str = "v",
) -> DataFrame:
    """Background-subtracted loop score with gap filling and removal of neighbouring loops.

    One image per distinct (map, anchors) is built from its stored cells, at most (2*local+1)^2
    of them, and scored in NumPy. Cells outside the map are gaps, absent pixels are zero, NULL or
    NaN pixels are gaps. ``curve`` rows give P by distance.
    """
    keys = list(keys)
    at = distinct_loops(
        loops.withColumn("_a", F.least(*LOOP)).withColumn("anchor2", F.greatest(*LOOP))
        .withColumn("anchor1", F.col("_a")).drop("_a"), keys,
    )
    cells = image_cells(pixels, at, keys, local, value).groupBy(*keys, *LOOP).agg(
        F.collect_list("di").alias("di"), F.collect_list("dj").alias("dj"),
        F.collect_list(F.coalesce(F.col(value), F.lit(float("nan")))).alias("v"),
    )
    # the part of the curve an image can touch
    ps = curve.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("d", "p")))["p"].alias("_ps")
    )
    size = F.col("anchor2") - F.col("anchor1")
    first = F.greatest(F.lit(0), F.least(size - 2 * local, F.size("_ps") - 1))
    work = (
        at.join(cells, [*keys, *LOOP], "left").join(ps, keys)
        .withColumn("first", first.cast("int"))
        .withColumn("ps", F.slice("_ps", F.col("first") + 1, F.lit(4 * local + 1)))
        .drop("_ps")
    )
    schema = T.StructType(
        [work.schema[k] for k in (*keys, *LOOP)] + [T.StructField("copies", T.LongType())] + SCORE_FIELDS
    )

    def run(batches):
        score = _Score(local, disk, diag_cutoff, k_min, sigma, outlier_radius, outliers)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                image = np.zeros((2 * local + 1, 2 * local + 1))
                if r.di is not None:
                    image[np.asarray(r.di) + local, np.asarray(r.dj) + local] = r.v
                for axis, anchor in ((0, r.anchor1), (1, r.anchor2)):
                    bins = anchor + np.arange(-local, local + 1)
                    off = (bins < 0) | (bins >= n_bins)
                    if axis == 0:
                        image[off, :] = np.nan
                    else:
                        image[:, off] = np.nan
                curve_part = np.concatenate([np.zeros(r.first), np.asarray(r.ps, dtype=float)])
                rows.append(score(image, int(r.anchor2 - r.anchor1), curve_part))
            scored = pd.DataFrame(rows, columns=[f.name for f in SCORE_FIELDS])
            yield pd.concat(
                [pdf[[*keys, *LOOP, "copies"]].reset_index(drop=True), scored], axis=1
            )

    return work.mapInPandas(run, schema)


def able_across_maps(scores: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores for a fixed list of (keys, anchors); NULL where a map is missing."""
    return wanted.join(scores.drop("copies"), [*keys, *LOOP], "left").withColumn(
        "n_outliers", F.coalesce("n_outliers", F.lit(0).cast("long"))
    )


def apa_strength_summary(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of loops, median and mean strength per map, undefined strengths left out.

    Copies of a loop are weighted instead of repeated, which keeps the median's distinct values
    bounded by the cells of a map.
    """
    s = F.when(~F.isnan("strength"), F.col("strength"))
    copies = F.col("copies")
    return scores.groupBy(*keys).agg(
        F.sum(copies).alias("n_pairs"),
        F.percentile(s, 0.5, copies).alias("median_strength"),
        ratio(F.sum(s * copies), F.sum(F.when(s.isNotNull(), copies))).alias("mean_strength"),
    )
