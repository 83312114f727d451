"""Statistics and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromloom.catalog.fixtures import N_BINS, RES
from chromloom.catalog.q_curves import PS, curve, valid
from chromloom.catalog.q_dynamics import MSD, chain_msd, r6
from chromloom.catalog.registry import query
from chromloom.functions.numeric import round6
from chromloom.operators import calibrate as U
from chromloom.operators import curves as C
from chromloom.operators import stats as S

FX = ("fx_metrics",)

MOM = """
, mo AS (SELECT metric, cond, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM fx_metrics GROUP BY ALL)
, pr AS (SELECT a.metric, a.cond AS cond_x, b.cond AS cond_y, a.n AS nx, b.n AS ny, a.m AS mx, b.m AS my, a.v AS vx, b.v AS vy
  FROM mo a JOIN mo b ON a.metric = b.metric AND a.cond <> b.cond WHERE a.n >= 2 AND b.n >= 2)
"""
WELCH = MOM + """
, wt AS (SELECT *, (mx - my) / sqrt(vx / nx + vy / ny) AS t,
   (vx / nx + vy / ny) * (vx / nx + vy / ny) / (vx * vx / (nx * nx * (nx - 1)) + vy * vy / (ny * ny * (ny - 1))) AS df,
   (mx - my) / sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2)) AS d FROM pr)
"""
IDS = ["metric", "cond_x", "cond_y"]


def pairs(t, **kw):
    return S.condition_pairs(t.fx("fx_metrics"), ["metric"], **kw)


@query("ag43_summary_stats", """
SELECT metric, cond, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(stddev_samp(value) / sqrt(count(*)), 6) AS sem FROM fx_metrics GROUP BY ALL""", FX)
def _(t):
    return r6(S.summary_stats(t.fx("fx_metrics"), ["metric", "cond"]), "mean", "std", "sem")


@query("ag44_welch_t", WELCH + """
SELECT metric, cond_x, cond_y, round(t, 5) + 0.0 AS t, round(df, 5) AS df FROM wt""", FX)
def _(t):
    w = S.welch_t(pairs(t))
    return w.select(*IDS, (F.round("t", 5) + F.lit(0.0)).alias("t"), F.round("df", 5).alias("df"))


# two-sided p: one less twice the density's integral from 0 to |t|, by Simpson's rule
SIMPSON = """
, fx AS (SELECT metric, cond_x, cond_y, abs(t) / 2000 AS h, k, CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
    * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * pow(1 + (k * abs(t) / 2000) * (k * abs(t) / 2000) / df, -(df + 1) / 2) AS y
  FROM wt, range(2001) g(k))
, pw AS (SELECT metric, cond_x, cond_y, 1 - 2 * sum(y ORDER BY k) * any_value(h) / 3 AS p_welch FROM fx GROUP BY ALL)
"""


@query("ag44_welch_p", WELCH + SIMPSON + "SELECT metric, cond_x, cond_y, round(p_welch, 6) AS p_welch FROM pw", FX)
def _(t):
    w = S.welch_p(S.welch_t(pairs(t)))
    return w.select(*IDS, F.round("p_welch", 6).alias("p_welch"))


@query("ag45_mann_whitney_u", """
, pr AS (SELECT a.metric, a.cond AS cond_x, b.cond AS cond_y, sum(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0 END) AS u
  FROM fx_metrics a JOIN fx_metrics b ON a.metric = b.metric AND a.cond <> b.cond GROUP BY ALL)
SELECT metric, cond_x, cond_y, CAST(u AS DOUBLE) AS u FROM pr""", FX)
def _(t):
    return S.mann_whitney_u(pairs(t), ["metric"])


PERM = MOM + """
, vx AS (SELECT metric, cond, row_number() OVER (PARTITION BY metric, cond ORDER BY rep) - 1 AS k, value FROM fx_metrics)
, al AS (SELECT pr.metric, cond_x, cond_y, nx, ny, abs(mx - my) AS obs, k, value FROM pr JOIN vx ON vx.metric = pr.metric AND vx.cond = cond_x
  UNION ALL SELECT pr.metric, cond_x, cond_y, nx, ny, abs(mx - my), nx + k, value FROM pr JOIN vx ON vx.metric = pr.metric AND vx.cond = cond_y)
, pm AS (SELECT metric, cond_x, cond_y, m, any_value(obs) AS obs,
   abs(sum(value) FILTER ((m >> CAST(k AS INTEGER)) & 1 = 1) / any_value(nx) - sum(value) FILTER ((m >> CAST(k AS INTEGER)) & 1 = 0) / any_value(ny)) AS gap
  FROM al JOIN (SELECT CAST(range AS INTEGER) AS m FROM range(256)) ON bit_count(m) = nx GROUP BY metric, cond_x, cond_y, m)
"""


@query("ag46_permutation_test", PERM + """
SELECT metric, cond_x, cond_y, round(avg(CASE WHEN gap >= obs - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p_perm, count(*) AS n_perm, true AS exact FROM pm GROUP BY ALL""", FX)
def _(t):
    return r6(S.permutation_test(pairs(t), ["metric"]), "p_perm")


BOOT = """
, v AS (SELECT metric, cond, value, row_number() OVER (PARTITION BY metric, cond ORDER BY rep, value) - 1 AS k, count(*) OVER (PARTITION BY metric, cond) AS n FROM fx_metrics)
, ab AS (SELECT DISTINCT a.metric, a.cond AS cond_x, b.cond AS cond_y, a.n AS nx, b.n AS ny FROM v a JOIN v b ON a.metric = b.metric AND a.cond <> b.cond WHERE a.n >= 2 AND b.n >= 2)
, sd AS (SELECT metric, cond_x, cond_y, cond_x AS cond, 1.0 AS sign, nx AS n, 0 AS off FROM ab UNION ALL SELECT metric, cond_x, cond_y, cond_y, -1.0, ny, 1000000 FROM ab)
, m0 AS (SELECT sd.*, draw, (CAST('0x' || substr(md5(concat_ws(':', '0', metric, cond_x, cond_y)), 1, 7) AS BIGINT) + draw * 1000003 + (k + off) * 7919) % 2147483647 AS x
  FROM sd, range(2000) d(draw), range(n) p(k))
, m1 AS (SELECT * REPLACE ((x * x + x * 48271 + 11) % 2147483647 AS x) FROM m0)
, m2 AS (SELECT * REPLACE ((x * x + x * 48271 + 11) % 2147483647 AS x) FROM m1)
, m3 AS (SELECT * REPLACE ((x * x + x * 48271 + 11) % 2147483647 % n AS x) FROM m2)
, gp AS (SELECT m3.metric, cond_x, cond_y, draw, sum(sign * value / m3.n) AS gap FROM m3 JOIN v ON v.metric = m3.metric AND v.cond = m3.cond AND v.k = m3.x GROUP BY ALL)
SELECT metric, cond_x, cond_y, round(quantile_cont(gap, 0.025), 6) + 0.0 AS diff_lo, round(quantile_cont(gap, 0.975), 6) + 0.0 AS diff_hi, count(*) AS n_boot FROM gp GROUP BY ALL"""


@query("ag47_bootstrap_diff_ci", BOOT, FX)
def _(t):
    return r6(S.bootstrap_diff_ci(pairs(t), ["metric"], n_boot=2_000), "diff_lo", "diff_hi")


# the seeded mode follows NumPy's generator: rows only here, numbers in the tests
@query("ag47_seeded_tests")
def _(t):
    out = S.resampling_tests(pairs(t))
    return out.select(*IDS, "diff_lo", "diff_hi", "p_mw", "p_perm")


@query("ag46_permutation_kernel", PERM + """
SELECT metric, cond_x, cond_y, round(avg(CASE WHEN gap >= obs - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p_perm, count(*) AS n_perm FROM pm GROUP BY ALL""", FX)
def _(t):
    return r6(S.resampling_tests(pairs(t)).select(*IDS, "p_perm", "n_perm"), "p_perm")


@query("ag48_cohens_d", WELCH + "SELECT metric, cond_x, cond_y, round(d, 5) + 0.0 AS d FROM wt", FX)
def _(t):
    c = S.cohens_d(pairs(t))
    return c.select(*IDS, (F.round("cohens_d", 5) + F.lit(0.0)).alias("d"))


LOGS = "\n, fx_logs AS (SELECT metric, cond, rep, log10(value) AS value FROM fx_metrics WHERE value > 0)"
BATTERY = LOGS + (WELCH + SIMPSON + PERM[len(MOM):] + """
, uu AS (SELECT a.metric, a.cond AS cond_x, b.cond AS cond_y, CAST(sum(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0 END) AS DOUBLE) AS u
  FROM fx_metrics a JOIN fx_metrics b ON a.metric = b.metric AND a.cond <> b.cond GROUP BY ALL)
, pp AS (SELECT metric, cond_x, cond_y, avg(CASE WHEN gap >= obs - 1e-12 THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM pm GROUP BY ALL)
SELECT metric, cond_x, cond_y, nx AS n_x, ny AS n_y, round(mx, 6) + 0.0 AS mean_x, round(my, 6) + 0.0 AS mean_y, round(mx - my, 6) + 0.0 AS diff_mean,
  round(t, 5) + 0.0 AS t, round(df, 5) AS df, round(p_welch, 6) AS p_welch, round(d, 5) + 0.0 AS cohens_d, u, round(p, 6) AS p_perm, n AS n_perm, true AS exact
FROM wt JOIN pw USING (metric, cond_x, cond_y) JOIN uu USING (metric, cond_x, cond_y) JOIN pp USING (metric, cond_x, cond_y)""").replace("fx_metrics", "fx_logs")


# the bootstrap interval and the rank-sum p of the battery are held against published numbers in the tests
@query("ag49_compare_vectors", BATTERY, FX)
def _(t):
    c = S.compare_conditions(t.fx("fx_metrics").withColumn("metric", F.concat(F.lit("K_alpha"), "metric")))
    five = [(F.round(k, 5) + F.lit(0.0)).alias(k) for k in ("t", "df", "cohens_d")]
    six = [round6(F.col(k)).alias(k) for k in ("mean_x", "mean_y", "diff_mean", "p_welch", "p_perm")]
    return c.select(F.substring("metric", 8, 99).alias("metric"), "cond_x", "cond_y", "n_x", "n_y", *five, *six, "u", "n_perm", "exact")


@query("ag50_pairs_vs_reference", """
SELECT a.metric, a.cond AS cond_x, b.cond AS cond_y FROM (SELECT DISTINCT metric, cond FROM fx_metrics) a
JOIN (SELECT DISTINCT metric, cond FROM fx_metrics) b ON a.metric = b.metric AND a.cond = (SELECT min(cond) FROM fx_metrics) AND b.cond <> a.cond""", FX)
def _(t):
    ref = "1-URGENT"
    return pairs(t, mode="vs_reference", reference=ref).select(*IDS)


@query("ag50_pairs_unordered", """
SELECT a.metric, a.cond AS cond_x, b.cond AS cond_y FROM (SELECT DISTINCT metric, cond FROM fx_metrics) a
JOIN (SELECT DISTINCT metric, cond FROM fx_metrics) b ON a.metric = b.metric AND a.cond < b.cond""", FX)
def _(t):
    return pairs(t, mode="unordered").select(*IDS)


@query("ag73_per_replicate_fits", """
SELECT o_orderpriority AS condition, o_orderstatus AS pair, o_orderkey AS rep, CAST(o_custkey AS DOUBLE) AS alpha, CAST(o_orderkey AS DOUBLE) AS k_alpha
FROM orders WHERE o_orderkey % 7 <> 0""")
def _(t):
    body = F.concat(
        F.lit('{"alpha_fit": {"alpha": '), F.col("o_custkey"),
        F.when(F.col("o_orderkey") % 7 == 0, "")
        .when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(', "K_alpha": '), F.col("o_orderkey")))
        .otherwise(F.concat(F.lit(', "D": '), F.col("o_orderkey"))), F.lit("}}"),
    )
    return S.per_replicate_fits(t("orders").select(
        F.col("o_orderpriority").alias("condition"), F.col("o_orderstatus").alias("pair"),
        F.col("o_orderkey").alias("rep"), body.alias("value"),
    ))


INTERP = PS + valid(RES) + """
, seg AS (SELECT cond, lx AS x0, ly AS y0, lead(lx) OVER w AS x1, lead(ly) OVER w AS y1 FROM pts WINDOW w AS (PARTITION BY cond ORDER BY lx))
, at30 AS (SELECT cond, max(pow(10.0, y0 + (y1 - y0) * (log10(30000.0) - x0) / (x1 - x0))) AS p FROM seg WHERE log10(30000.0) >= x0 AND log10(30000.0) < x1 GROUP BY cond)
"""


@query("ag39_calibrate_hic", INTERP + """
SELECT cond, round(50.0 * sqrt(2.0), 6) AS nm_per_monomer, CAST(1.0 AS DOUBLE) AS sec_per_frame, 'hic' AS source, round(p / (p * 2), 6) AS amplitude_ratio FROM at30""", ("fx_maps",))
def _(t):
    exp = curve(t)
    sim = exp.withColumn("p", F.col("p") * 2)
    return r6(
        U.calibrate_hic(sim, exp, ["cond"], RES, ref_bp=30_000, bp_per_monomer=2000),
        "nm_per_monomer", "amplitude_ratio",
    )


CALMSD = MSD + """
, ex AS (SELECT CAST(user_id % 10 AS INTEGER) AS chain, CAST(event_id % 40 AS DOUBLE) AS dt, max(value) AS y FROM events GROUP BY ALL)
, sf AS (SELECT chain, max(msd) / 2 AS j, pow(10.0, regr_intercept(log10(msd), log10(lag)) FILTER (lag BETWEEN 1 AND 30)) AS g FROM msd GROUP BY chain)
, ef AS (SELECT chain, max(y) FILTER (dt > 0) / 2 AS j, pow(10.0, regr_intercept(log10(y), log10(dt)) FILTER (dt BETWEEN 1 AND 30)) AS g FROM ex WHERE dt > 0 GROUP BY chain)
, cal AS (SELECT sf.chain, sqrt(ef.j / sf.j) AS dx, sf.g AS gs, ef.g AS ge FROM sf JOIN ef ON ef.chain = sf.chain)
"""


def experimental(t):
    return t("events").groupBy(
        (F.col("user_id") % 10).cast("int").alias("chain"), (F.col("event_id") % 40).cast("double").alias("dt_s")
    ).agg(F.max("value").alias("msd_um2"))


def msd_units(t):
    return U.calibrate_msd(chain_msd(t), experimental(t), ["chain"])


@query("ag40_calibrate_msd", CALMSD + """
SELECT chain, round(dx * 1000, 4) AS nm_per_monomer, round(gs * dx * dx / ge * gs * dx * dx / ge, 5) AS sec_per_frame FROM cal""", ("fx_pair",))
def _(t):
    u = msd_units(t)
    return u.select("chain", F.round("nm_per_monomer", 4).alias("nm_per_monomer"), F.round("sec_per_frame", 5).alias("sec_per_frame"))


@query("prj16_calibrate_units", CALMSD + """
SELECT msd.chain, round(lag * gs * dx * dx / ge * gs * dx * dx / ge, 4) AS lag_s, round(msd * dx * 1000 * dx * 1000, 2) AS msd_nm2
FROM msd JOIN cal ON cal.chain = msd.chain""", ("fx_pair",))
def _(t):
    c = U.calibrate_units(chain_msd(t), msd_units(t), ["chain"])
    return c.select("chain", F.round("lag_s", 4).alias("lag_s"), F.round("msd_nm2", 2).alias("msd_nm2"))


@query("ag41_calibration_dispatch", INTERP + """
SELECT c.cond, CASE WHEN p IS NULL OR c.cond = 'N' THEN CAST(60.0 AS DOUBLE) ELSE 50.0 END AS nm_per_monomer, CAST(1.0 AS DOUBLE) AS sec_per_frame,
  CASE WHEN p IS NULL OR c.cond = 'N' THEN 'assumed (no expt P(s))' ELSE 'hic' END AS source
FROM (SELECT DISTINCT cond FROM fx_maps) c LEFT JOIN at30 ON at30.cond = c.cond""", ("fx_maps",))
def _(t):
    c = curve(t)
    hic = U.calibrate_hic(c, c, ["cond"], RES, ref_bp=30_000).where("cond <> 'N'")
    return U.calibration("hic", c, ["cond"], hic=hic, nm=60.0)


@query("jn19_reference_units", CALMSD + """
SELECT chain, round((SELECT dx * 1000 FROM cal WHERE chain = 3), 4) AS nm_per_monomer FROM cal""", ("fx_pair",))
def _(t):
    u = U.reference_units(msd_units(t).select("chain", "nm_per_monomer", "sec_per_frame", "source"), "chain", 3)
    return u.select("chain", F.round("nm_per_monomer", 4).alias("nm_per_monomer"))


@query("dup3_calibrate_with_floor", CALMSD + """
SELECT chain, round(dx * 1000, 4) AS nm_per_monomer FROM cal""", ("fx_pair",))
def _(t):
    u = U.calibrate_msd(chain_msd(t), experimental(t), ["chain"], floor=1e-12)
    return u.select("chain", F.round("nm_per_monomer", 4).alias("nm_per_monomer"))


@query("dup5_curve_records", PS + valid(RES) + """
SELECT cond, max(d) + 1 AS n, (SELECT round(-regr_slope(ly, lx), 6) + 0.0 FROM pts WHERE pts.cond = ps.cond AND s >= 2000 AND s < 30000) AS exponent,
  round(max(p) FILTER (d = 10), 6) AS p_10kb FROM ps GROUP BY cond""", ("fx_maps",))
def _(t):
    c = C.ps_curve(t.fx("fx_maps"), ["cond"], N_BINS)
    m = C.ps_metrics(c, ["cond"], RES).select("cond", "exponent", "p_10kb")
    n = c.groupBy("cond").agg((F.max("d") + 1).alias("n"))
    return r6(n.join(m, "cond"), "exponent", "p_10kb")
