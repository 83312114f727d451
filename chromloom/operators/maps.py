"""Map-level measures: insulation, comparison of two maps, observed over expected.

Maps are sparse upper triangles (keys, i, j, v); every mean divides by the number of cells of
its region, never by the number of stored pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromloom.functions.numeric import corr_of_sums, is_finite, is_positive, ratio
from chromloom.functions.skew import percentiles
from chromloom.operators import curves

INSULATION_WINDOW = 50
PARTS = ("diamond", "diamond_n", "flank", "flank_n")


def insulation(
    pixels: DataFrame, keys: Sequence[str], n_bins: int, window: int = INSULATION_WINDOW,
    value: str = "v", undefined: float | None = None,
) -> DataFrame:
    """log2 of the diamond mean over the mean of the two on-diagonal blocks, per bin.

    NULL (or ``undefined``) within ``window`` of the ends and where either mean is not above
    zero. Bins from ``n_bins`` on are cropped. Each pixel closer than 2*window to the diagonal feeds three ranges of bins: the
    diamond it lies in and the flanks left and right of it. Ranges are summed as differences
    (+v where a range starts, -v after its end), so a pixel costs six rows whatever the window.
    Whether a block is empty is decided by whole-number counts, free of rounding.
    """
    keys = list(keys)
    i, j, w = F.col("i"), F.col("j"), window
    near = crop(pixels, n_bins).where((j - i) < 2 * w).select(*keys, "i", "j", F.col(value).alias("_v"))
    twice = F.when(i == j, F.col("_v")).otherwise(2 * F.col("_v"))
    ranges = [
        ("diamond", F.greatest(i + 1, j - w + 1), F.least(j, i + w), F.col("_v"), i < j),
        ("flank", j + 1, i + w, twice, j - i < w),
        ("flank", j - w + 1, i, twice, j - i < w),
    ]
    entries = F.array(*[
        F.when(
            cond & (lo <= hi),
            F.array(
                F.struct(lo.cast("int").alias("bin"), *_parts(kind, v, 1)),
                F.struct((hi + 1).cast("int").alias("bin"), *_parts(kind, -v, -1)),
            ),
        ).otherwise(F.array())
        for kind, lo, hi, v, cond in ranges
    ])
    steps = near.select(*keys, F.explode(F.flatten(entries)).alias("e")).groupBy(
        *keys, F.greatest(F.col("e.bin"), F.lit(0)).alias("_b")
    ).agg(*[F.sum(f"e.{k}").alias(f"_{k}") for k in PARTS])
    order = W.partitionBy(*keys).orderBy("_b")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = steps.where(F.col("_b") <= n_bins).select(
        *keys, "_b",
        *[F.sum(f"_{k}").over(upto).alias(k) for k in PARTS],
        F.lag("_b").over(order).isNull().alias("_first"),
        (F.lead("_b", 1, n_bins).over(order) - 1).alias("_to"),
    )
    start = F.when(F.col("_first"), F.lit(0)).otherwise(F.col("_b"))
    filled = sums.where(start <= F.col("_to")).withColumn(
        "bin", F.explode(F.sequence(start, F.col("_to")))
    )
    present = F.col("bin") >= F.col("_b")
    inside = F.col("diamond") / float(w * w)
    flank = F.col("flank") / float(2 * w * w)
    usable = (
        present & (F.col("bin") >= w) & (F.col("bin") < n_bins - w)
        & (F.col("diamond_n") > 0) & (F.col("flank_n") > 0) & (inside > 0) & (flank > 0)
    )
    score = F.when(usable, F.log2(inside / flank)).otherwise(F.lit(undefined).cast("double"))
    return filled.select(*keys, "bin", score.alias("score"))


def _parts(kind: str, v: Column, sign: int) -> list[Column]:
    out = []
    for k in ("diamond", "flank"):
        filled = F.when(v != 0, F.lit(sign)).otherwise(F.lit(0)) if k == kind else F.lit(0)
        out.append((v if k == kind else F.lit(0.0)).cast("double").alias(k))
        out.append(filled.cast("long").alias(f"{k}_n"))
    return out


def crop(pixels: DataFrame, n_bins: int) -> DataFrame:
    """Pixels of the first ``n_bins`` bins; in an upper triangle the later bin decides."""
    return pixels.where(F.col("j") < n_bins)


def join_maps(
    sim: DataFrame, exp: DataFrame, keys: Sequence[str], n_bins: int | None = None, value: str = "v"
) -> DataFrame:
    """Cells of two maps side by side, (keys, i, j, sim, exp), absent cells zero.

    ``n_bins`` crops both maps to the smaller one.
    """
    on = [*keys, "i", "j"]
    both = sim.select(*on, F.col(value).alias("sim")).join(
        exp.select(*on, F.col(value).alias("exp")), on, "full"
    )
    if n_bins is not None:
        both = both.where((F.col("i") < n_bins) & (F.col("j") < n_bins))
    zero = F.lit(0.0)
    return both.select(
        *on, F.coalesce("sim", zero).alias("sim"), F.coalesce("exp", zero).alias("exp")
    )


def limit_distance(cells: DataFrame, max_diag: int | None) -> DataFrame:
    """Drop (zero) cells further than ``max_diag`` from the diagonal."""
    return cells if max_diag is None else cells.where(F.col("j") - F.col("i") <= max_diag)


def overall_pearson(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation over upper-triangle cells where either map is above zero; 0 if undefined."""
    used = (F.col("i") < F.col("j")) & ((F.col("sim") > 0) | (F.col("exp") > 0))
    a, b = F.when(used, F.col("sim")), F.when(used, F.col("exp"))
    r = _corr(F.count(a), a, b)
    return cells.groupBy(*keys).agg(F.coalesce(r, F.lit(0.0)).alias("overall_pearson"))


def _corr(n: Column, a: Column, b: Column) -> Column:
    return corr_of_sums(n, F.sum(a), F.sum(b), F.sum(a * b), F.sum(a * a), F.sum(b * b))


def diag_pearson(
    cells: DataFrame, keys: Sequence[str], n_bins: int, max_diag: int | None = None
) -> DataFrame:
    """Correlation per distance over all n-d cells, zeros included: (keys, d, n, r).

    Distances without variance in either map are left out.
    """
    last = n_bins if max_diag is None else min(n_bins, max_diag)
    d = (F.col("j") - F.col("i")).cast("int")
    a, b = F.col("sim"), F.col("exp")
    n = (F.lit(n_bins) - F.col("d")).cast("long")
    return (
        cells.withColumn("d", d).where((F.col("d") >= 1) & (F.col("d") < last))
        .groupBy(*keys, "d").agg(_corr(n, a, b).alias("r"))
        .where(F.col("r").isNotNull())
        .select(*keys, "d", n.alias("n"), "r")
    )


def scc(diagonals: DataFrame, keys: Sequence[str], n_bins: int, compat: bool = True) -> DataFrame:
    """Weighted mean of the diagonal correlations, their plain mean and number.

    ``compat`` weighs by n-1, n-2, ... in the order of kept diagonals; otherwise by the number
    of cells of each diagonal.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("d"))
    weight = (F.lit(n_bins) - rank) if compat else F.col("n")
    return diagonals.withColumn("_w", weight.cast("double")).groupBy(*keys).agg(
        ratio(F.sum(F.col("_w") * F.col("r")), F.sum("_w")).alias("stratum_adjusted_corr"),
        F.avg("r").alias("mean_diag_pearson"),
        F.count("r").alias("n_diagonals"),
    )


def ps_curve_corr(sim: DataFrame, exp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of log curves where both are positive; 0 for fewer than three points."""
    on = [*keys, "d"]
    wide = sim.select(*on, F.col("p").alias("_s")).join(exp.select(*on, F.col("p").alias("_e")), on)
    return _curve_corr(wide, keys)


def _curve_corr(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = is_positive(F.col("_s")) & is_positive(F.col("_e"))
    a = F.when(both, F.log10(F.col("_s") + 1e-10))
    b = F.when(both, F.log10(F.col("_e") + 1e-10))
    r = F.when(F.count(a) > 2, _corr(F.count(a), a, b))
    return wide.groupBy(*keys).agg(F.coalesce(r, F.lit(0.0)).alias("ps_curve_corr"))


def insulation_corr(sim: DataFrame, exp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of insulation over bins valid in both; 0 unless more than ten."""
    on = [*keys, "bin"]
    wide = sim.select(*on, F.col("score").alias("_s")).join(
        exp.select(*on, F.col("score").alias("_e")), on
    )
    return _score_corr(wide, keys)


def _score_corr(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = is_finite(F.col("_s")) & is_finite(F.col("_e"))
    a, b = F.when(both, F.col("_s")), F.when(both, F.col("_e"))
    r = F.when(F.count(a) > 10, _corr(F.count(a), a, b))
    return wide.groupBy(*keys).agg(F.coalesce(r, F.lit(0.0)).alias("insulation_corr"))


#: Sums of a diagonal of two maps: values, squares and products, over all its cells and (``_u``)
#: over those where either map is above zero.
_SUMS = {"s": ("sim",), "e": ("exp",), "ss": ("sim", "sim"), "ee": ("exp", "exp"), "se": ("sim", "exp")}


def diagonal_sums(sim: DataFrame, exp: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """What all measures of two maps but insulation need, one row a diagonal: (keys, d, stored
    pixels of each side, sums and sums over used cells)."""
    on = [*keys, "i", "j"]
    cells = sim.select(*on, F.col(value).alias("_sim")).join(exp.select(*on, F.col(value).alias("_exp")), on, "full").select(
        *on, "_sim", "_exp", F.coalesce("_sim", F.lit(0.0)).alias("sim"), F.coalesce("_exp", F.lit(0.0)).alias("exp"))
    used = (F.col("sim") > 0) | (F.col("exp") > 0)

    def term(names: tuple[str, ...]) -> Column:
        return F.col(names[0]) if len(names) == 1 else F.col(names[0]) * F.col(names[1])

    sums = [F.sum(term(names)).alias(k) for k, names in _SUMS.items()]
    sums += [F.coalesce(F.sum(F.when(used, term(names))), F.lit(0.0)).alias(f"{k}_u") for k, names in _SUMS.items()]
    return cells.groupBy(*keys, (F.col("j") - F.col("i")).cast("int").alias("d")).agg(
        F.count("_sim").alias("n_sim"), F.count("_exp").alias("n_exp"), F.count_if(used).alias("n_u"), *sums)


def compare_maps(
    sim: DataFrame, exp: DataFrame, keys: Sequence[str], n_bins: int, resolution: int,
    max_diag: int | None = None, window: int = INSULATION_WINDOW, value: str = "v",
) -> DataFrame:
    """Every agreement measure of a simulated and an experimental map, one row per ``keys``.

    Both maps are cropped to ``n_bins``, the smaller of their sizes, before anything is measured.
    One table of sums per diagonal gives the correlations, the curves and their metrics; curves
    and insulation are computed for both maps at once, told apart by a ``side`` key. All measures
    meet in one aggregation instead of joins.
    """
    keys = list(keys)
    sim, exp = (limit_distance(crop(m, n_bins), max_diag) for m in (sim, exp))
    cube = diagonal_sums(sim, exp, keys, value)
    on = [*keys, "side"]
    columns = [*keys, "i", "j", value]
    both = sim.select(*columns).withColumn("side", F.lit("sim")).unionByName(
        exp.select(*columns).withColumn("side", F.lit("exp"))
    )
    # only diagonals that a side stores; the curve fills the others itself
    sides = F.array(*[F.struct(F.lit(m).alias("side"), F.col(c).alias("_s"), F.col(f"n_{m}").alias("_n")) for m, c in (("sim", "s"), ("exp", "e"))])
    sums = cube.select(*keys, F.col("d").alias("_d"), F.inline(sides)).where("_n > 0")
    curve = curves.curve_of_sums(sums.select(*on, "_d", "_s"), on, n_bins)
    score = insulation(both, on, n_bins, window, value)

    def of(side: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(c)))

    wide_curve = curve.groupBy(*keys, "d").agg(of("sim", "p").alias("_s"), of("exp", "p").alias("_e"))
    wide_score = score.groupBy(*keys, "bin").agg(
        of("sim", "score").alias("_s"), of("exp", "score").alias("_e")
    )
    metrics = curves.ps_metrics(curve, on, resolution)
    names = [c for c in metrics.columns if c not in on]
    wide_metrics = metrics.groupBy(*keys).agg(*[
        of(side, c).alias(f"{side}_{c}") for side in ("sim", "exp") for c in names
    ])
    upper = F.col("d") > 0
    total = lambda c: F.sum(F.when(upper, F.col(c)).otherwise(F.lit(0)))
    overall = cube.groupBy(*keys).agg(F.coalesce(corr_of_sums(
        total("n_u"), total("s_u"), total("e_u"), total("se_u"), total("ss_u"), total("ee_u")), F.lit(0.0)).alias("overall_pearson"))
    last = n_bins if max_diag is None else min(n_bins, max_diag)
    cells_of = (F.lit(n_bins) - F.col("d")).cast("long")
    diagonals = cube.where(upper & (F.col("d") < last)).select(*keys, "d", cells_of.alias("n"), corr_of_sums(
        cells_of, F.col("s"), F.col("e"), F.col("se"), F.col("ss"), F.col("ee")).alias("r")).where("r IS NOT NULL")
    parts = [overall, scc(diagonals, keys, n_bins), _curve_corr(wide_curve, keys), _score_corr(wide_score, keys), wide_metrics]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.groupBy(*keys).agg(*[F.max(c).alias(c) for c in out.columns if c not in keys])


def observed_over_expected(
    pixels: DataFrame, curve: DataFrame, keys: Sequence[str], value: str = "v"
) -> DataFrame:
    """Pixels with the curve value at their distance: adds expected, oe (0 where the curve is 0)
    and log2_oe (NULL unless both are positive)."""
    expected = curve.select(*keys, F.col("d").alias("_d"), F.col("p").alias("expected"))
    joined = pixels.withColumn("_d", (F.col("j") - F.col("i")).cast("int")).join(
        expected, [*keys, "_d"]
    ).drop("_d")
    oe = F.when(F.col("expected") > 0, F.col(value) / F.col("expected")).otherwise(F.lit(0.0))
    return joined.withColumn("oe", oe).withColumn(
        "log2_oe", F.when(F.col("oe") > 0, F.log2("oe"))
    )


def map_difference(treated: DataFrame, control: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Treated minus control per cell, absent cells zero."""
    cells = join_maps(treated, control, keys, value=value)
    return cells.select(*keys, "i", "j", (F.col("sim") - F.col("exp")).alias("delta"))


def divides(column: str) -> bool:
    """Whether a normalisation of this name divides; others multiply."""
    return column.upper() in {"KR", "VC", "VC_SQRT"}


def balanced_value(value: Column, first: Column, second: Column, divisive: bool) -> Column:
    """A value balanced by those of its two bins; zero where the result is not a finite number."""
    both = first * second
    balanced = F.try_divide(value, both) if divisive else value * both
    return F.when(is_finite(balanced), balanced).otherwise(F.lit(0.0))


def balance(
    pixels: DataFrame, bins: DataFrame, keys: Sequence[str], column: str | None,
    divisive: bool | None = None, value: str = "v",
) -> DataFrame:
    """Balanced pixels from one weight per bin; NULL, NaN and infinite results become zero.

    ``divisive`` weights divide, others multiply. Without it the norms KR, VC and VC_SQRT
    divide and ``weight`` multiplies. ``column`` None returns raw counts.
    """
    if column is None:
        return pixels
    keys = list(keys)
    shared = [k for k in keys if k in bins.columns]
    side = {
        end: bins.select(*shared, F.col("bin").alias(end), F.col(column).alias(f"_w{end}"))
        for end in ("i", "j")
    }
    joined = pixels.join(side["i"], [*shared, "i"], "left").join(side["j"], [*shared, "j"], "left")
    clean = balanced_value(F.col(value), F.col("_wi"), F.col("_wj"), divides(column) if divisive is None else divisive)
    return joined.select(*keys, "i", "j", clean.alias(value))


def colour_scale(
    pixels: DataFrame, keys: Sequence[str], lo: float = 1.0, hi: float = 98.0, value: str = "v"
) -> DataFrame:
    """Two percentiles of the positive pixels of all maps that share ``keys``."""
    p = percentiles(pixels.where(F.col(value) > 0), keys, value, [lo / 100.0, hi / 100.0])
    return p.groupBy(*keys).agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
