"""Curve queries: P(s), fits, slopes, derivative, interpolation, smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromloom.catalog.fixtures import N_BINS, RES
from chromloom.catalog.registry import query
from chromloom.functions.numeric import round6
from chromloom.operators import curves as C

WIDE = 10_000  # a coarser bin, so that the curve reaches the far reference distances

PS = f"""
, ps AS (
  SELECT c.cond, g.d, coalesce(s.sv, 0.0) / ({N_BINS} - g.d) AS p
  FROM (SELECT DISTINCT cond FROM fx_maps) c
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS d FROM range({N_BINS})) g
  LEFT JOIN (SELECT cond, j - i AS d, sum(v) AS sv FROM fx_maps GROUP BY ALL) s
    ON s.cond = c.cond AND s.d = g.d)
"""


def valid(res: int) -> str:
    return f"""
, pts AS (
  SELECT cond, d, d * {res} AS s, log10(d * {res}) AS lx, log10(p) AS ly
  FROM ps WHERE d > 0 AND p > 0)
"""


def gradient(source: str, x: str, y: str, name: str) -> str:
    """SQL of the uneven second-order slope per cond."""
    return f"""
, {name}_n AS (
  SELECT *, {x} - lag({x}) OVER w AS h0, lead({x}) OVER w - {x} AS h1,
         lag({y}) OVER w AS y0, lead({y}) OVER w AS y1
  FROM {source} WINDOW w AS (PARTITION BY cond ORDER BY {x}))
, {name} AS (
  SELECT *, CASE WHEN h0 IS NULL THEN (y1 - {y}) / h1 WHEN h1 IS NULL THEN ({y} - y0) / h0
    ELSE (h0 * h0 * y1 + (h1 * h1 - h0 * h0) * {y} - h1 * h1 * y0) / (h0 * h1 * (h0 + h1)) END AS slope
  FROM {name}_n)
"""


def curve(t, **kw):
    return C.ps_curve(t.fx("fx_maps"), ["cond"], N_BINS, **kw)


@query("ag6_ps_curve", PS + "SELECT cond, d, round(p, 6) + 0.0 AS p FROM ps", ("fx_maps",))
def _(t):
    return curve(t).withColumn("p", round6(F.col("p")))


@query("ag8_powerlaw_fit", PS + valid(RES) + """
SELECT cond, count(*) AS n_points,
       round(-regr_slope(ly, lx), 6) + 0.0 AS exponent,
       round(regr_intercept(ly, lx), 6) + 0.0 AS log_intercept
FROM pts WHERE s >= 2000 AND s < 30000 GROUP BY cond HAVING count(*) > 2""", ("fx_maps",))
def _(t):
    fit = C.powerlaw_fit(curve(t), ["cond"], RES)
    return fit.select(
        "cond", "n_points", *[round6(F.col(c)).alias(c) for c in ("exponent", "log_intercept")]
    )


def _cholesky_sql(source: str, size: int = 7) -> str:
    """Steps from ``source`` (power sums ``s0..``, ``b0..``) to ``so`` with the solution ``c0..c6``.
    Each is a table of its own, as repeated aliases would be written out again and again."""
    steps = []
    dot = lambda terms: "".join(f" - {t}" for t in terms)
    for j in range(size):
        steps.append([f"sqrt(s{2 * j}{dot(f'l{j}{k} * l{j}{k}' for k in range(j))}) AS l{j}{j}"])
        if j < size - 1:
            steps.append([f"(s{i + j}{dot(f'l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, size)])
    steps += [[f"(b{i}{dot(f'l{i}{k} * u{k}' for k in range(i))}) / l{i}{i} AS u{i}"] for i in range(size)]
    steps += [[f"(u{i}{dot(f'l{k}{i} * c{k}' for k in range(i + 1, size))}) / l{i}{i} AS c{i}"] for i in reversed(range(size))]
    names = [source, *(f"so{k}" for k in range(len(steps) - 1)), "so"]
    return "".join(f"\n, {new} AS MATERIALIZED (SELECT *, {', '.join(step)} FROM {old})" for old, new, step in zip(names, names[1:], steps))


@query("ag9_poly6_fit", PS + f"""
, pt AS (SELECT cond, d, log10(d * {RES}) AS x, log10(p) AS y FROM ps WHERE d > 0 AND p > 0)
, en AS (SELECT cond, (min(x) + max(x)) / 2 AS mid, (max(x) - min(x)) / 2 AS half FROM pt GROUP BY cond)
, sc AS (SELECT pt.*, (x - mid) / half AS z FROM pt JOIN en USING (cond))
, sm AS (SELECT cond, count(*) AS n, {", ".join(f"sum(pow(z, {k})) AS s{k}" for k in range(13))}, {", ".join(f"sum(pow(z, {k}) * y) AS b{k}" for k in range(7))} FROM sc GROUP BY cond){_cholesky_sql("sm")}
SELECT cond, d, n AS n_points, round({" + ".join(f"c{k} * pow(z, {k})" for k in range(7))}, 4) + 0.0 AS fitted FROM sc JOIN so USING (cond)""", ("fx_maps",))
def _(t):
    fit = C.poly6_fit(curve(t), ["cond"], RES, hi_bp=N_BINS * RES)
    at = F.log10(F.col("d") * RES)
    fitted = F.aggregate("coefficients", F.lit(0.0), lambda total, c: total * at + c)  # highest power first
    points = curve(t).where((F.col("d") > 0) & (F.col("p") > 0)).join(fit, "cond")
    return points.select("cond", "d", "n_points", (F.round(fitted, 4) + F.lit(0.0)).alias("fitted"))


@query("win2_log_gradient", PS + valid(RES) + gradient("pts", "lx", "ly", "g") + """
SELECT cond, d, round(slope, 6) + 0.0 AS slope FROM g""", ("fx_maps",))
def _(t):
    return C.local_slopes(curve(t), ["cond"], RES).select(
        "cond", "d", round6(F.col("slope")).alias("slope")
    )


def _near(bp: int, label: str) -> str:
    return f"""
(SELECT CASE WHEN rk >= 2 AND rk < nv - 2 AND nv > 5 THEN round(slope, 6) + 0.0 END FROM g2
 WHERE g2.cond = ps.cond ORDER BY abs(s - {bp}), s LIMIT 1) AS slope_{label}"""


METRICS_SQL = PS + valid(WIDE) + gradient("pts", "lx", "ly", "g") + """
, g2 AS (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY d) - 1 AS rk,
                count(*) OVER (PARTITION BY cond) AS nv FROM g)
, fit AS (SELECT cond, round(-regr_slope(ly, lx), 6) + 0.0 AS exponent,
                 round(regr_intercept(ly, lx), 6) + 0.0 AS log_intercept
          FROM pts WHERE s >= 2000 AND s < 30000 GROUP BY cond HAVING count(*) > 2)
SELECT ps.cond, """ + ", ".join(
    f"round(max(p) FILTER (d = {bp // WIDE}), 6) + 0.0 AS p_{label}"
    for label, bp in C.MAGNITUDE_AT_BP.items()
) + ", max(exponent) AS exponent, max(log_intercept) AS log_intercept, " + ", ".join(
    _near(bp, label) for label, bp in C.SLOPE_AT_BP.items()
) + " FROM ps LEFT JOIN fit ON fit.cond = ps.cond GROUP BY ps.cond"


@query("ag10_ps_metrics", METRICS_SQL, ("fx_maps",))
def _(t):
    m = C.ps_metrics(curve(t), ["cond"], WIDE)
    return m.select("cond", *[round6(F.col(c)).alias(c) for c in m.columns if c != "cond"])


LOGLOG = PS + valid(RES) + """
, seg AS (SELECT cond, lx AS x0, ly AS y0, lead(lx) OVER w AS x1, lead(ly) OVER w AS y1
          FROM pts WINDOW w AS (PARTITION BY cond ORDER BY lx))
"""


@query("win3_interp_loglog", LOGLOG + """
, tg AS (SELECT cond, bp, log10(bp) AS t FROM (SELECT DISTINCT cond FROM ps),
         (SELECT unnest([12345.0, 27500.0, 500000.0]) AS bp))
SELECT tg.cond, CAST(bp AS DOUBLE) AS bp,
       round(max(pow(10.0, y0 + (y1 - y0) * (t - x0) / (x1 - x0))), 6) + 0.0 AS p
FROM tg LEFT JOIN seg ON seg.cond = tg.cond AND t >= x0 AND t < x1 GROUP BY ALL""", ("fx_maps",))
def _(t):
    at = {f"bp_{bp}": float(bp) for bp in (12345, 27500, 500000)}
    wide = C.interp_loglog(curve(t), ["cond"], F.col("d") * RES, at)
    return wide.unpivot(["cond"], list(at), "bp", "p").select(
        "cond", F.substring("bp", 4, 9).cast("double").alias("bp"), round6(F.col("p")).alias("p")
    )


def deriv_sql(res: int) -> str:
    return PS + valid(res) + f"""
, span AS (SELECT cond, log10(greatest(5000.0, min(s))) AS lo, log10(least(2000000.0, max(s))) AS hi
           FROM pts GROUP BY cond HAVING count(*) >= 10 AND least(2000000.0, max(s)) > greatest(5000.0, min(s)))
, grid AS (SELECT cond, k, lo + (hi - lo) * k / 79 AS lg FROM span, (SELECT range AS k FROM range(80)))
, seg AS (SELECT cond, lx AS x0, ly AS y0, lead(lx) OVER w AS x1, lead(ly) OVER w AS y1,
                 lag(lx) OVER w IS NULL AS first
          FROM pts WINDOW w AS (PARTITION BY cond ORDER BY lx))
, og AS (SELECT grid.cond, k, lg,
                CASE WHEN lg < x0 OR x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (lg - x0) / (x1 - x0) END AS lp
         FROM grid JOIN seg ON grid.cond = seg.cond
          AND ((lg >= x0 AND (x1 IS NULL OR lg < x1)) OR (first AND lg < x0)))
"""


def smooth_sql(weight: str, half: int) -> str:
    return f"""
, ker AS (SELECT o, {weight} AS w FROM (SELECT range AS o FROM range(-{half}, {half} + 1)))
, kn AS (SELECT o, w / (SELECT sum(w) FROM ker) AS w FROM ker)
, sm AS (SELECT a.cond, a.k, a.lg, a.lp, sum(b.lp * w) AS y
         FROM og a CROSS JOIN kn JOIN og b ON b.cond = a.cond
          AND b.k = CASE WHEN a.k + o < 0 THEN -(a.k + o) WHEN a.k + o > 79 THEN 158 - (a.k + o)
                         ELSE a.k + o END
         GROUP BY ALL)
"""


GAUSS = smooth_sql("exp(-0.5 * (o / 0.8) * (o / 0.8))", 4)


@query("win8_gaussian_smooth", deriv_sql(RES) + GAUSS + """
SELECT cond, CAST(k AS INTEGER) AS k, round(y, 6) + 0.0 AS y FROM sm""", ("fx_maps",))
def _(t):
    return _smoothed(t, lambda a: C.gaussian_smooth(a))


@query("win9_moving_average", deriv_sql(RES) + smooth_sql("1.0", 2) + """
SELECT cond, CAST(k AS INTEGER) AS k, round(y, 6) + 0.0 AS y FROM sm""", ("fx_maps",))
def _(t):
    return _smoothed(t, lambda a: C.moving_average(a, 5))


def _smoothed(t, smooth):
    d = C.ps_derivative(curve(t), ["cond"], RES)
    arr = d.groupBy("cond").agg(F.array_sort(F.collect_list(F.struct("k", "log_p"))).alias("g"))
    return arr.select("cond", F.posexplode(smooth(F.col("g")["log_p"])).alias("k", "y")).withColumn(
        "y", round6(F.col("y"))
    )


@query("win6_ps_derivative", deriv_sql(RES) + GAUSS + gradient("sm", "lg", "y", "g") + """
SELECT cond, CAST(k AS INTEGER) AS k, round(pow(10.0, lg), 4) AS s, round(lp, 6) + 0.0 AS log_p,
       round(slope, 6) + 0.0 AS slope FROM g""", ("fx_maps",))
def _(t):
    d = C.ps_derivative(curve(t), ["cond"], RES)
    return d.select(
        "cond", "k", F.round("s", 4).alias("s"), round6(F.col("log_p")).alias("log_p"),
        round6(F.col("slope")).alias("slope"),
    )


@query("ag42_derivative_summary", deriv_sql(WIDE) + GAUSS + gradient("sm", "lg", "y", "g0") + """
, g AS (SELECT cond, lg, pow(10.0, lg) AS s, slope FROM g0)
, seg2 AS (SELECT cond, lg AS x0, slope AS y0, lead(lg) OVER w AS x1, lead(slope) OVER w AS y1
           FROM g WINDOW w AS (PARTITION BY cond ORDER BY lg))
, refs AS (SELECT unnest(['10kb', '50kb', '100kb', '500kb', '1mb']) AS label,
                  unnest([10000.0, 50000.0, 100000.0, 500000.0, 1000000.0]) AS bp)
, atr AS (SELECT cond, label, max(CASE WHEN x1 IS NULL THEN y0
                                 ELSE y0 + (y1 - y0) * (log10(bp) - x0) / (x1 - x0) END) AS v
         FROM refs JOIN seg2 ON log10(bp) >= x0 AND (log10(bp) < x1 OR (x1 IS NULL AND log10(bp) = x0)) GROUP BY ALL)
, w AS (SELECT cond, max(slope) FILTER (s BETWEEN 20000 AND 2000000) AS mx FROM g GROUP BY cond)
SELECT g.cond, round(min(slope), 6) AS slope_min,
  round(min_by(s, slope), 4) AS s_at_slope_min_bp,
  round(max(mx), 6) + 0.0 AS slope_max,
  round(max_by(s, slope) FILTER (s BETWEEN 20000 AND 2000000), 4) AS s_at_slope_max_bp,
  round(max_by(s, slope) FILTER (s BETWEEN 20000 AND 2000000), 4) AS inferred_mean_loop_size_bp,
  round(-min(slope), 6) + 0.0 AS loop_density_proxy_slope_min_depth,
  round(avg(slope) FILTER (s BETWEEN 5000 AND 30000), 6) + 0.0 AS slope_mean_shortrange,
  round(avg(slope) FILTER (s BETWEEN 100000 AND 1000000), 6) + 0.0 AS slope_mean_tadrange,
""" + ",\n".join(
    f"round((SELECT v FROM atr WHERE atr.cond = g.cond AND label = '{label}'), 6) + 0.0 AS slope_at_{label}"
    for label in C.DERIVATIVE_AT_BP
) + " FROM g JOIN w ON w.cond = g.cond GROUP BY g.cond", ("fx_maps",))
def _(t):
    s = C.derivative_summary(C.ps_derivative(curve(t), ["cond"], WIDE), ["cond"])
    return s.select("cond", *[
        (F.round(c, 4) if c.endswith("_bp") else round6(F.col(c))).alias(c)
        for c in s.columns if c != "cond"
    ])


@query("ag76_ps_relative", PS + f"""
, r AS (SELECT cond, arg_min(p, CAST(abs(d * {RES} - 10000) AS BIGINT) * 1000000 + d) AS p0
        FROM ps WHERE d > 0 AND p > 0 GROUP BY cond)
SELECT ps.cond, d, round(p / p0, 6) + 0.0 AS relative FROM ps JOIN r ON r.cond = ps.cond""", ("fx_maps",))
def _(t):
    return C.ps_relative(curve(t), ["cond"], RES).withColumn("relative", round6(F.col("relative")))


@query("set1_labelled_curves", PS + f"""
SELECT cond, d, round(p, 6) + 0.0 AS p, 'simulated' AS curve FROM ps
UNION ALL SELECT cond, d, CASE WHEN d >= 2 THEN round(p, 6) + 0.0 END, 'experimental' FROM ps""", ("fx_maps",))
def _(t):
    both = C.labelled({"simulated": curve(t), "experimental": curve(t, min_diag=2)})
    return both.withColumn("p", round6(F.col("p")))


@query("srt3_conditions_by_exponent", PS + valid(RES) + """
, f AS (SELECT cond, -regr_slope(ly, lx) AS e FROM pts WHERE s >= 2000 AND s < 30000 GROUP BY cond)
SELECT CAST(row_number() OVER (ORDER BY e ASC NULLS LAST, cond) AS INTEGER) AS place, cond, round(e, 6) + 0.0 AS exponent FROM f""",
       ("fx_maps",))
def _(t):
    from chromloom.operators.runs import place_by

    fit = C.powerlaw_fit(curve(t), ["cond"], RES)
    return place_by(fit, "exponent", "cond").select(
        "place", "cond", round6(F.col("exponent")).alias("exponent")
    )
