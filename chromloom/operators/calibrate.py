"""Conversion of simulated units to nanometres and seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromloom.functions.numeric import is_positive, log10_pos, ratio
from chromloom.operators.curves import interp_loglog

# fixed values of the published analysis
REFERENCE_BP, PERSISTENCE_NM = 100_000, 50.0
FIT_LAG = (1.0, 30.0)


def nm_per_monomer(bp_per_monomer: int, persistence_nm: float = PERSISTENCE_NM) -> Column:
    return F.lit(float(persistence_nm)) * F.sqrt(F.lit(max(bp_per_monomer, 1) / 1000.0))


def calibrate_hic(
    sim: DataFrame, exp: DataFrame, keys: Sequence[str], resolution: int,
    ref_bp: int = REFERENCE_BP, bp_per_monomer: int = 1000, persistence_nm: float = PERSISTENCE_NM,
    sec_per_frame: float = 1.0,
) -> DataFrame:
    """Units from chain statistics with the amplitude ratio of both curves at one distance.

    The ratio is recorded only; it does not change the length unit.
    """
    keys = list(keys)
    s = F.col("d") * resolution
    a = interp_loglog(sim, keys, s, {"_sim": ref_bp})
    b = interp_loglog(exp, keys, s, {"_exp": ref_bp})
    return a.join(b, keys, "left").select(
        *keys, nm_per_monomer(bp_per_monomer, persistence_nm).alias("nm_per_monomer"),
        F.lit(float(sec_per_frame)).alias("sec_per_frame"), F.lit("hic").alias("source"),
        ratio(F.col("_exp"), F.col("_sim")).alias("amplitude_ratio"),
    )


def plateau_and_prefactor(curve: DataFrame, keys: Sequence[str], lag: str, msd: str) -> DataFrame:
    """Half the largest value (j) and the value at lag 1 of the short-time line (g).

    The line needs three points between the fit lags; j needs three positive points.
    """
    x, y = F.col(lag), F.col(msd)
    use = (x >= FIT_LAG[0]) & (x <= FIT_LAG[1]) & is_positive(y)
    lx, ly = F.when(use, F.log10(F.when(x > 0, x))), F.when(use, log10_pos(y))
    n = F.count(ly)
    valid = (x > 0) & is_positive(y)
    intercept = F.regr_avgy(ly, lx) - F.try_divide(F.regr_sxy(ly, lx), F.regr_sxx(ly, lx)) * F.regr_avgx(ly, lx)
    return curve.groupBy(*keys).agg(
        F.when(F.count(F.when(valid, 1)) >= 3, F.max(F.when(valid, y)) / 2.0).alias("j"),
        F.when(n >= 3, F.pow(F.lit(10.0), intercept)).alias("g"),
    )


def calibrate_msd(sim: DataFrame, exp: DataFrame, keys: Sequence[str], floor: float | None = None) -> DataFrame:
    """Units that match plateau and short-time prefactor of simulated and measured displacement.

    ``sim`` has (lag, msd), ``exp`` (dt_s, msd_um2). The fit window is the same number of frames
    and seconds. ``floor`` keeps the divisors above a small number instead of giving NULL.
    """
    keys = list(keys)
    a = plateau_and_prefactor(sim, keys, "lag", "msd").select(*keys, F.col("j").alias("_js"), F.col("g").alias("_gs"))
    b = plateau_and_prefactor(exp, keys, "dt_s", "msd_um2").select(*keys, F.col("j").alias("_je"), F.col("g").alias("_ge"))
    joined = a.join(b, keys)
    low = F.lit(float(floor)) if floor is not None else None

    def guarded(c: str) -> Column:
        return F.greatest(F.coalesce(F.col(c), low), low) if floor is not None else F.col(c)

    dx = F.sqrt(ratio(guarded("_je"), guarded("_js")))
    dt = ratio(guarded("_gs") * dx * dx, guarded("_ge"))
    return joined.select(
        *keys, (dx * 1000.0).alias("nm_per_monomer"), (dt * dt).alias("sec_per_frame"),
        F.lit("msd").alias("source"), F.col("_js").alias("j_sim"), F.col("_je").alias("j_expt"),
        F.col("_gs").alias("g_sim"), F.col("_ge").alias("g_expt"),
    )


def assumed(every: DataFrame, keys: Sequence[str], nm: float = 50.0, sec: float = 1.0, source: str = "assumed") -> DataFrame:
    return every.select(*keys).distinct().select(
        *keys, F.lit(float(nm)).alias("nm_per_monomer"), F.lit(float(sec)).alias("sec_per_frame"),
        F.lit(source).alias("source"),
    )


def calibration(
    anchor: str | None, every: DataFrame, keys: Sequence[str], hic: DataFrame | None = None,
    msd: DataFrame | None = None, nm: float = 50.0, sec: float = 1.0,
) -> DataFrame | None:
    """Units by the chosen anchor. Conditions the anchor has no measurement for fall back to
    assumed units and say so; anchor "none" gives nothing."""
    keys, anchor = list(keys), (anchor or "hic").lower()
    if anchor == "none":
        return None
    if anchor == "assumed":
        return assumed(every, keys, nm, sec)
    chosen = {"hic": hic, "msd": msd}.get(anchor)
    if anchor not in ("hic", "msd"):
        raise ValueError(f"unknown calibration anchor {anchor!r}")
    missing = "expt P(s)" if anchor == "hic" else "expt MSD"
    fallback = assumed(every, keys, nm, sec, f"assumed (no {missing})")
    if chosen is None:
        return fallback
    known = chosen.select(*keys, "nm_per_monomer", "sec_per_frame", "source").where(
        F.col("nm_per_monomer").isNotNull()
    )
    return known.unionByName(fallback.join(known.select(*keys), keys, "left_anti"))


def calibrate_units(curve: DataFrame, units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Displacement in seconds and square nanometres."""
    return curve.join(units.select(*keys, "nm_per_monomer", "sec_per_frame"), list(keys)).select(
        *keys, (F.col("lag") * F.col("sec_per_frame")).alias("lag_s"),
        (F.col("msd") * F.col("nm_per_monomer") * F.col("nm_per_monomer")).alias("msd_nm2"),
    )


def reference_units(units: DataFrame, key: str, reference: str) -> DataFrame:
    """Every condition takes the units of the reference condition, if that has any."""
    ref = units.where(F.col(key) == reference).agg(
        F.max(F.struct("nm_per_monomer", "sec_per_frame", "source")).alias("r")
    )
    own = F.struct("nm_per_monomer", "sec_per_frame", "source")
    taken = units.select(key, F.coalesce(ref.scalar(), own).alias("r"))
    return taken.select(key, "r.nm_per_monomer", "r.sec_per_frame", "r.source")
