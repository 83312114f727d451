"""Dynamics queries: pair traces, gyration, dwell runs, displacement, autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromloom.catalog.fixtures import CHAIN, RADIUS
from chromloom.catalog.q_loops import LOOPS
from chromloom.catalog.registry import query
from chromloom.functions.numeric import round6
from chromloom.operators import dynamics as D
from chromloom.operators.sites import convergent_pairs

PAIR = ("fx_pair",)


def r6(df, *columns):
    return df.select(*[round6(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("sc2_pair_trace", """
SELECT chain, frame, 'p' AS pair, 0 AS tile, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy,
       round(dz, 6) + 0.0 AS dz, round(dist, 6) AS dist FROM fx_pair""", PAIR)
def _(t):
    trace = D.pair_trace(t.fx("fx_frames"), ["chain", "frame"], [("p", 0, 10)])
    return r6(trace, "dx", "dy", "dz", "dist")


RG = """
, rg AS (SELECT chain, frame, sqrt(greatest(avg(x*x + y*y + z*z) - avg(x)*avg(x) - avg(y)*avg(y) - avg(z)*avg(z), 0)) AS rg
         FROM fx_beads GROUP BY ALL)
, per_frame AS (SELECT frame, avg(rg) AS rg FROM rg GROUP BY frame)
"""


@query("ag27_radius_of_gyration", RG + "SELECT frame, round(rg, 6) AS rg FROM per_frame", ("fx_beads",))
def _(t):
    rg = D.radius_of_gyration(t.fx("fx_frames"), ["chain", "frame"])
    return r6(D.rg_per_frame(rg, ["frame"]), "rg")


@query("ag27_rg_bead_range", """
SELECT chain, frame, round(sqrt(greatest(avg(x*x + y*y + z*z) - avg(x)*avg(x) - avg(y)*avg(y) - avg(z)*avg(z), 0)), 6) AS rg
FROM fx_beads WHERE bead >= 5 AND bead < 15 GROUP BY ALL""", ("fx_beads",))
def _(t):
    return r6(D.radius_of_gyration(t.fx("fx_frames"), ["chain", "frame"], 5, 15), "rg")


@query("ag28_rg_summary", RG + """
SELECT chain, round(avg(rg), 6) AS rg_mean, round(stddev_pop(rg), 6) AS rg_std, count(*) AS n_frames
FROM rg GROUP BY chain""", ("fx_beads",))
def _(t):
    rg = D.radius_of_gyration(t.fx("fx_frames"), ["chain", "frame"])
    return r6(D.rg_summary(rg, ["chain"]), "rg_mean", "rg_std")


@query("ag29_looped_fraction", f"""
, f AS (SELECT chain, avg(CASE WHEN dist < {RADIUS} THEN 1.0 ELSE 0.0 END) AS f FROM fx_pair GROUP BY chain)
SELECT chain % 2 AS cond, round(avg(f), 6) AS looped_fraction, round(stddev_samp(f) / sqrt(count(*)), 6) AS sem,
       count(*) AS n_tiles FROM f GROUP BY ALL""", PAIR)
def _(t):
    trace = t.fx("fx_pair").withColumn("cond", F.col("chain") % 2)
    return r6(D.looped_fraction(trace, ["cond"], "chain", RADIUS), "looped_fraction", "sem")


RUNS = """
, isl AS (SELECT series, t, t - row_number() OVER (PARTITION BY series ORDER BY t) AS g FROM fx_trace WHERE hit)
, runs AS (SELECT series, min(t) AS s, max(t) AS e, count(*) AS len FROM isl GROUP BY series, g)
"""


@query("win4_contact_runs", RUNS + """
SELECT series, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", len AS length FROM runs""", ("fx_trace",))
def _(t):
    return D.contact_runs(t.fx("fx_trace"), ["series"], "t", F.col("hit"), chunk=16)


DWELL = RUNS + """
SELECT e.k, coalesce(n, 0) AS n_dwells, round(mean, 6) AS mean, md AS median, mx AS max
FROM (SELECT DISTINCT series AS k FROM fx_trace) e LEFT JOIN (
  SELECT series AS k, count(*) AS n, avg(len) AS mean, median(len) AS md, max(len) AS mx FROM runs GROUP BY series) r
ON r.k = e.k"""


@query("ag30_dwell_stats", DWELL.replace("e.k,", "e.k AS series,"), ("fx_trace",))
def _(t):
    trace = t.fx("fx_trace")
    runs = D.contact_runs(trace, ["series"], "t", F.col("hit"))
    return r6(D.dwell_stats(runs, ["series"], trace.select("series").distinct()), "mean")


@query("ag31_distance_stats", """
SELECT chain, round(avg(dist), 6) AS mean_d, round(median(dist), 6) AS median_d, round(stddev_pop(dist), 6) AS std_d
FROM fx_pair GROUP BY chain""", PAIR)
def _(t):
    return r6(D.distance_stats(t.fx("fx_pair"), ["chain"]), "mean_d", "median_d", "std_d")


def hist_sql(table: str, key: str, value: str, bins: int) -> str:
    return f"""
, e AS (SELECT {key}, min({value}) AS lo, (max({value}) - min({value})) / {bins} AS st, count(*) AS tot FROM {table} GROUP BY {key})
, b AS (SELECT {key}, {value} AS v, lo, st, CAST(least(floor(({value} - lo) / st), {bins - 1}) AS INTEGER) AS g
        FROM {table} JOIN e USING ({key}))
, c AS (SELECT {key}, CASE WHEN v < lo + g * st THEN g - 1
                           WHEN g < {bins - 1} AND v >= lo + (g + 1) * st THEN g + 1 ELSE g END AS k, count(*) AS n FROM b GROUP BY ALL)
SELECT e.{key}, k, round(lo + (k + 0.5) * st, 6) + 0.0 AS center, coalesce(n, 0) AS n, round(coalesce(n, 0) / (tot * st), 6) AS density
FROM e CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range({bins})) LEFT JOIN c USING ({key}, k)"""


@query("ag31_distance_histogram", hist_sql("fx_pair", "chain", "dist", 60), PAIR)
def _(t):
    return r6(D.histogram(t.fx("fx_pair"), ["chain"], "dist", 60), "center", "density")


@query("ag32_log_histogram", RUNS + """
, rr AS (SELECT series % 3 AS grp, CAST(len AS DOUBLE) AS len FROM runs)
, e AS (SELECT grp, log10(greatest(min(len), 1.0)) AS lo, (log10(max(len)) - log10(greatest(min(len), 1.0))) / 40 AS st, count(*) AS tot FROM rr GROUP BY grp)
, c AS (SELECT grp, CAST(least(floor((log10(len) - lo) / st), 39) AS INTEGER) AS k, count(*) AS n FROM rr JOIN e USING (grp) GROUP BY ALL)
SELECT grp, k, round(0.5 * (pow(10.0, lo + k * st) + pow(10.0, lo + (k + 1) * st)), 6) AS center, coalesce(n, 0) AS n,
       round(coalesce(n, 0) / (tot * (pow(10.0, lo + (k + 1) * st) - pow(10.0, lo + k * st))), 6) AS density
FROM e CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(40)) LEFT JOIN c USING (grp, k)""", ("fx_trace",))
def _(t):
    runs = D.contact_runs(t.fx("fx_trace"), ["series"], "t", F.col("hit"))
    grouped = runs.withColumn("grp", F.col("series") % 3)
    return r6(D.log_histogram(grouped, ["grp"], "length", 40), "center", "density")


@query("jn13_lag_self_join", """
SELECT a.chain, a.frame, l.lag, round(a.dist, 6) AS dist, round(b.dist, 6) AS dist_later
FROM fx_pair a CROSS JOIN (SELECT CAST(unnest([1, 2, 5]) AS INTEGER) AS lag) l
JOIN fx_pair b ON b.chain = a.chain AND b.frame = a.frame + l.lag""", PAIR)
def _(t):
    pairs = D.lag_pairs(t.fx("fx_pair"), ["chain"], "frame", ["dist"], [1, 2, 5])
    return r6(pairs, "dist", "dist_later")


MSD = """
, T AS (SELECT chain, max(frame) + 1 AS T FROM fx_pair GROUP BY chain)
, msd AS (SELECT a.chain, CAST(b.frame - a.frame AS BIGINT) AS lag,
    avg((b.dx - a.dx) * (b.dx - a.dx) + (b.dy - a.dy) * (b.dy - a.dy) + (b.dz - a.dz) * (b.dz - a.dz)) AS msd, count(*) AS n
  FROM fx_pair a JOIN T ON T.chain = a.chain
  JOIN fx_pair b ON b.chain = a.chain AND b.frame > a.frame AND b.frame <= a.frame + greatest(1, floor(T * (1.0 / 3)))
  GROUP BY ALL)
"""


def chain_msd(t, block=16):
    return D.msd(t.fx("fx_pair"), ["chain"], "frame", block=block)


@query("ag33_msd", MSD + "SELECT chain, lag, round(msd, 6) AS msd, n FROM msd", PAIR)
def _(t):
    return r6(chain_msd(t), "msd")


@query("ag33_pooled_msd", MSD + "SELECT lag, round(avg(msd), 6) AS msd, count(*) AS n_tiles FROM msd GROUP BY lag", PAIR)
def _(t):
    return r6(D.pooled_msd(chain_msd(t), []), "msd")


@query("ag34_single_point_msd", """
, p AS (SELECT chain, frame, x, y, z FROM fx_beads WHERE bead = 4)
, T AS (SELECT chain, max(frame) + 1 AS T FROM p GROUP BY chain)
SELECT a.chain, CAST(b.frame - a.frame AS BIGINT) AS lag,
    round(avg((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)), 6) AS msd, count(*) AS n
  FROM p a JOIN T ON T.chain = a.chain
  JOIN p b ON b.chain = a.chain AND b.frame > a.frame AND b.frame <= a.frame + greatest(1, floor(T * (1.0 / 3)))
  GROUP BY ALL""", ("fx_beads",))
def _(t):
    one = t.fx("fx_frames").select("chain", "frame", F.get("pos", F.lit(4)).alias("p"))
    flat = one.select("chain", "frame", "p.x", "p.y", "p.z")
    return r6(D.msd(flat, ["chain"], "frame", ("x", "y", "z"), block=16), "msd")


FIT = MSD + """
, top AS (SELECT chain, greatest(6, floor(max(lag) * 0.25)) AS top FROM msd GROUP BY chain)
, pts AS (SELECT msd.chain, log10(lag) AS x, log10(msd) AS y FROM msd JOIN top ON top.chain = msd.chain WHERE lag >= 2 AND lag <= top AND msd > 0)
, ft AS (SELECT chain, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx,
    greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 0) AS ssr, avg(x) AS mx FROM pts GROUP BY chain)
"""


def chain_fits(t):
    return D.msd_powerlaw_fit(chain_msd(t), ["chain"], lag_min=2, min_points=3)


@query("ag35_msd_powerlaw_fit", FIT.replace("greatest(6,", "greatest(3,") + """
SELECT ft.chain, round(b, 6) + 0.0 AS alpha, round(pow(10.0, a), 6) AS k_alpha, round(a, 6) + 0.0 AS log_intercept,
  CASE WHEN n > 2 THEN round(sqrt(ssr / (n - 2) / sxx), 6) END AS alpha_stderr,
  CASE WHEN n > 2 THEN round(sqrt(ssr / (n - 2) * (1.0 / n + mx * mx / sxx)), 6) END AS log_k_alpha_stderr,
  CAST(top AS BIGINT) AS fit_lag_max, n AS n_points
FROM ft JOIN top ON top.chain = ft.chain WHERE n >= 3
UNION ALL SELECT top.chain, NULL, NULL, NULL, NULL, NULL, CAST(top AS BIGINT), coalesce(n, 0) FROM top LEFT JOIN ft ON ft.chain = top.chain
WHERE coalesce(n, 0) < 3""", PAIR)
def _(t):
    return r6(chain_fits(t), "alpha", "k_alpha", "log_intercept", "alpha_stderr", "log_k_alpha_stderr")


@query("ag36_msd_fit_per_tile", FIT.replace("greatest(6,", "greatest(3,") + """
, f2 AS (SELECT chain % 2 AS cond, b, pow(10.0, a) AS k FROM ft WHERE n >= 3)
SELECT cond, round(avg(b), 6) + 0.0 AS alpha_mean, round(stddev_samp(b), 6) AS alpha_std, round(stddev_samp(b) / sqrt(count(*)), 6) AS alpha_sem,
  round(avg(k), 6) AS k_alpha_mean, round(stddev_samp(k), 6) AS k_alpha_std, round(stddev_samp(k) / sqrt(count(*)), 6) AS k_alpha_sem,
  count(*) AS n_tiles_fitted FROM f2 GROUP BY cond""", PAIR)
def _(t):
    per_tile = chain_fits(t).withColumn("cond", F.col("chain") % 2)
    out = D.msd_fit_per_tile(per_tile, ["cond"])
    return r6(out, *[c for c in out.columns if c.startswith(("alpha", "k_alpha"))])


# nonlinear least squares has no SQL form: rows-only here, recovery of known curves in the tests
@query("ag37_msd_saturation_fit")
def _(t):
    return D.msd_saturation_fit(chain_msd(t), ["chain"])


@query("ag38_autocorrelation", """
, s AS (SELECT chain, avg(dist) AS m, var_pop(dist) AS v, max(frame) + 1 AS T FROM fx_pair GROUP BY chain)
, d AS (SELECT p.chain, frame, dist - m AS d, v, T FROM fx_pair p JOIN s ON s.chain = p.chain)
SELECT a.chain, CAST(b.frame - a.frame AS BIGINT) AS lag, round(avg(a.d * b.d) / any_value(a.v), 6) + 0.0 AS c
FROM d a JOIN d b ON b.chain = a.chain AND b.frame > a.frame AND b.frame <= a.frame + greatest(1, floor(a.T * (1.0 / 3)))
GROUP BY ALL
UNION ALL SELECT chain, 0, 1.0 FROM s""", PAIR)
def _(t):
    return r6(D.autocorrelation(t.fx("fx_pair"), ["chain"], "frame"), "c")


SNAP = """
, lp AS (SELECT DISTINCT anchor1, anchor2 FROM loops)
, cp AS (SELECT anchor1, anchor2, o, anchor1 + o AS a, anchor2 + o AS b FROM lp, (SELECT unnest([0, 50, 100, 150]) AS o))
, held AS (SELECT DISTINCT snap, anchor1, anchor2, o FROM fx_legs JOIN cp ON l BETWEEN a - 1 AND a + 1 AND r BETWEEN b - 1 AND b + 1)
SELECT lp.anchor1, lp.anchor2, round(coalesce(h.n, 0) / ((SELECT count(DISTINCT snap) FROM fx_legs) * 4.0), 6) AS looped
FROM lp LEFT JOIN (SELECT anchor1, anchor2, count(*) AS n FROM held GROUP BY ALL) h USING (anchor1, anchor2)"""


@query("ag60_snapshot_scores", LOOPS + SNAP, ("fx_sites", "fx_maps", "fx_legs"))
def _(t):
    loops = convergent_pairs(t.fx("fx_sites"), ["ctcf_type", "locus"], 5, 40).select(
        "anchor1", "anchor2"
    ).distinct()
    return r6(D.snapshot_scores(t.fx("fx_legs"), loops, [], [0, 50, 100, 150], 1), "looped")


@query("ag60_snapshot_scores_by_half", LOOPS + """
, lp AS (SELECT DISTINCT anchor1 % 2 AS half, anchor1, anchor2 FROM loops)
, lg AS (SELECT *, snap % 2 AS half FROM fx_legs)
, cp AS (SELECT half, anchor1, anchor2, o, anchor1 + o AS a, anchor2 + o AS b FROM lp, (SELECT unnest([0, 50, 100, 150]) AS o))
, held AS (SELECT DISTINCT cp.half, snap, anchor1, anchor2, o FROM lg JOIN cp ON lg.half = cp.half AND l BETWEEN a - 1 AND a + 1 AND r BETWEEN b - 1 AND b + 1)
, sn AS (SELECT half, count(DISTINCT snap) AS n FROM lg GROUP BY half)
SELECT CAST(lp.half AS BIGINT) AS half, lp.anchor1, lp.anchor2, round(coalesce(h.n, 0) / (sn.n * 4.0), 6) AS looped
FROM lp JOIN sn ON sn.half = lp.half LEFT JOIN (SELECT half, anchor1, anchor2, count(*) AS n FROM held GROUP BY ALL) h
  ON h.half = lp.half AND h.anchor1 = lp.anchor1 AND h.anchor2 = lp.anchor2""", ("fx_sites", "fx_maps", "fx_legs"))
def _(t):
    loops = convergent_pairs(t.fx("fx_sites"), ["ctcf_type", "locus"], 5, 40).select(
        (F.col("anchor1") % 2).cast("long").alias("half"), "anchor1", "anchor2"
    ).distinct()
    legs = t.fx("fx_legs").withColumn("half", (F.col("snap") % 2).cast("long"))
    return r6(D.snapshot_scores(legs, loops, ["half"], [0, 50, 100, 150], 1), "looped")


@query("jn18_legs_at_anchors", LOOPS + """
, lp AS (SELECT DISTINCT anchor1, anchor2 FROM loops)
SELECT anchor1, anchor2, round(count(DISTINCT snap) / (SELECT count(DISTINCT snap) FROM fx_legs), 6) AS looped
FROM lp LEFT JOIN fx_legs ON l = anchor1 AND r = anchor2 GROUP BY ALL""", ("fx_sites", "fx_maps", "fx_legs"))
def _(t):
    loops = convergent_pairs(t.fx("fx_sites"), ["ctcf_type", "locus"], 5, 40).select(
        "anchor1", "anchor2"
    ).distinct()
    return r6(D.snapshot_scores(t.fx("fx_legs"), loops, [], [0], 0), "looped")


@query("win7_coverage_depth", f"""
, pos AS (SELECT CAST(range AS INTEGER) AS p FROM range({CHAIN}))
, dep AS (SELECT snap, p, count(*) FILTER (l <= p) - count(*) FILTER (r <= p) AS d FROM fx_legs CROSS JOIN pos GROUP BY ALL)
SELECT s.snap, round(s.m, 6) AS mean_size, round(c.c, 6) AS coverage
FROM (SELECT snap, avg(r - l) AS m FROM fx_legs GROUP BY snap) s
JOIN (SELECT snap, count(*) FILTER (d > 0) / {CHAIN}.0 AS c FROM dep GROUP BY snap) c ON c.snap = s.snap""", ("fx_legs",))
def _(t):
    return r6(D.coverage_depth(t.fx("fx_legs"), ["snap"], CHAIN), "mean_size", "coverage")
