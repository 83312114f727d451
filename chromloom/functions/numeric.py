"""Guarded numeric column expressions (ANSI mode raises on x/0 and NaN is not NULL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num/den as double, NULL when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def is_positive(c: Column) -> Column:
    """True for finite values above zero (NULL and NaN give false)."""
    return F.coalesce(is_finite(c) & (c > 0), F.lit(False))


def is_finite(c: Column) -> Column:
    return F.coalesce(
        c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)
    )


def log10_pos(c: Column) -> Column:
    """log10 of positive finite values, NULL otherwise."""
    return F.when(is_positive(c), F.log10(c))


def round6(c: Column) -> Column:
    """Six decimals without negative zero, the precision used for comparisons."""
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def corr_of_sums(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, syy: Column) -> Column:
    """Pearson r from sums, so that absent (zero) cells only enter through ``n``.

    NULL when either side has no variance beyond rounding noise.
    """
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    noise = F.lit(1e-12)
    ok = (vx > noise * n * sxx) & (vy > noise * n * syy)
    return F.when(ok, (n * sxy - sx * sy) / F.sqrt(vx) / F.sqrt(vy))


def ols(x: Column, y: Column) -> dict[str, Column]:
    """Aggregates of a straight-line fit y = slope*x + intercept with standard errors.

    Errors scale the residual variance by n-2, so they are NULL for fewer than three points.
    """
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    sxx, syy, sxy = F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    slope = F.try_divide(sxy, sxx)
    mean_x = F.regr_avgx(y, x)
    intercept = F.regr_avgy(y, x) - slope * mean_x
    residual = F.greatest(syy - F.try_divide(sxy * sxy, sxx), F.lit(0.0))
    var = F.when(n > 2, F.try_divide(residual, (n - 2).cast("double")))
    return {
        "n": n,
        "slope": slope,
        "intercept": intercept,
        "slope_se": F.sqrt(F.try_divide(var, sxx)),
        "intercept_se": F.sqrt(
            var * (F.try_divide(F.lit(1.0), n.cast("double")) + F.try_divide(mean_x * mean_x, sxx))
        ),
    }
