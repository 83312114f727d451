"""Report, stage and streaming queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from chromloom.catalog.fixtures import N_BEADS, N_BINS, RADIUS, RES, positions
from chromloom.catalog.q_contacts import PAIRS
from chromloom.catalog.q_curves import METRICS_SQL, WIDE
from chromloom.catalog.q_dynamics import MSD
from chromloom.catalog.q_loops import ABLE, CUT, DISK, FX as LOOP_FX, LOCAL, PAD, site_loops
from chromloom.catalog.q_maps import WIN, sides
from chromloom.catalog.registry import ORACLES, query
from chromloom.functions.numeric import round6
from chromloom.operators import curves as C
from chromloom.operators import loops as L
from chromloom.plans import condition_report as R
from chromloom.sinks.tables import reuse_or_build
from chromloom.streaming import running_dwell, running_map

NAMES = (
    [f"p_{x}" for x in C.MAGNITUDE_AT_BP] + ["exponent", "log_intercept"] + [f"slope_{x}" for x in C.SLOPE_AT_BP]
)


def _long_sql(oracle: str, group: str) -> str:
    """Another query's SQL, one row a condition, as long metrics without nulls."""
    return f"""SELECT cond, '{group}' AS "group", metric, value FROM (
  UNPIVOT (SELECT cond, CAST(COLUMNS(* EXCLUDE (cond)) AS DOUBLE) FROM ({ORACLES[oracle]})) ON COLUMNS(* EXCLUDE (cond)) INTO NAME metric VALUE value)"""


MAP_REPORT = METRICS_SQL.replace("SELECT ps.cond, round(max(p)", ", wide AS (SELECT ps.cond, round(max(p)") + """)
, lm AS (SELECT cond, 'P(s)' AS "group", unnest([""" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS metric, unnest([" + ", ".join(NAMES) + """]) AS value FROM wide)
SELECT * FROM lm WHERE value IS NOT NULL UNION ALL """ + _long_sql("ag42_derivative_summary", "P(s)_derivative")


@query("bnd1_map_report", MAP_REPORT, ("fx_maps",))
def _(t):
    report = R.map_report(t.fx("fx_maps"), ["cond"], N_BINS, WIDE, WIN)
    in_bp = F.col("metric").endswith("_bp")  # base pairs are compared to four decimals, as where they come from
    value = F.when(in_bp, F.round("value", 4) + F.lit(0.0)).otherwise(round6(F.col("value")))
    return report["metrics"].where("value IS NOT NULL").select("cond", "group", "metric", value.alias("value"))


@query("bnd1_loop_report", ABLE + """
, r AS (SELECT sc.cond, disk - c * bg AS s, near FROM loops JOIN sc USING (cond, anchor1, anchor2))
, w AS (SELECT cond, CAST(count(*) AS DOUBLE) AS n, median(s) FILTER (NOT near) AS md, avg(s) FILTER (NOT near) AS mn FROM r GROUP BY cond)
SELECT cond, 'AbLE' AS "group", unnest(['n_pairs', 'median_strength', 'mean_strength']) AS metric, round(unnest([n, md, mn]), 4) + 0.0 AS value FROM w
UNION ALL SELECT cond, "group", metric, round(value, 4) + 0.0 FROM (""" + _long_sql("ag21_loop_strength", "AbLE") + ")", LOOP_FX)
def _(t):
    report = R.loop_report(
        t.fx("fx_maps"), site_loops(t), ["cond"], N_BINS, PAD, local=LOCAL, disk=DISK, diag_cutoff=CUT, outliers=False
    )
    return report["metrics"].where("value IS NOT NULL").select("cond", "group", "metric", (F.round("value", 4) + F.lit(0.0)).alias("value"))


@query("bnd1_comparison_report", f"""
SELECT cond, 'sim_vs_exp' AS "group", metric, value FROM (
  UNPIVOT (SELECT cond, CAST(COLUMNS(* EXCLUDE (cond)) AS DOUBLE) FROM ({ORACLES['ag19_compare_maps']})) ON COLUMNS(* EXCLUDE (cond)) INTO NAME metric VALUE value)""")
def _(t):
    rows = R.comparison_report(*sides(t), ["cond"], N_BINS, RES, WIN).where("value IS NOT NULL")
    return rows.select("cond", "group", "metric", round6(F.col("value")).alias("value"))


@query("bnd2_strength_on_probe_pairs", ABLE + """
SELECT anchor1, anchor2, """ + ", ".join(
    f"max(CASE WHEN NOT near THEN round(disk - c * bg, 4) + 0.0 END) FILTER (cond = '{c}') AS strength_{c}" for c in "ANR"
) + " FROM sc GROUP BY anchor1, anchor2", LOOP_FX)
def _(t):
    scores = L.able_score(
        t.fx("fx_maps"), site_loops(t), C.ps_curve(t.fx("fx_maps"), ["cond"], N_BINS), ["cond"], N_BINS,
        LOCAL, DISK, CUT, outliers=False,
    ).withColumn("strength", F.round("strength", 4) + F.lit(0.0))
    wide = scores.groupBy("anchor1", "anchor2").pivot("cond", ["A", "N", "R"]).agg(F.max("strength"))
    return wide.toDF("anchor1", "anchor2", "strength_A", "strength_N", "strength_R")


DYN = MSD.replace(", T AS", ", p2 AS (SELECT *, chain % 2 AS cond FROM fx_pair), T AS", 1) + f"""
, lf AS (SELECT chain % 2 AS cond, chain, avg(CASE WHEN dist < {RADIUS} THEN 1.0 ELSE 0.0 END) AS f FROM fx_pair GROUP BY chain)
, l2 AS (SELECT cond, avg(f) AS looped_fraction, stddev_samp(f) / sqrt(count(*)) AS looped_sem FROM lf GROUP BY cond)
, isl AS (SELECT chain, frame, frame - row_number() OVER (PARTITION BY chain ORDER BY frame) AS g FROM fx_pair WHERE dist < {RADIUS})
, rn AS (SELECT chain % 2 AS cond, count(*) AS len FROM isl GROUP BY chain, g)
, dw AS (SELECT cond, count(*) AS n_dwells, avg(len) AS dwell_mean, median(len) AS dwell_median, max(len) AS dwell_max FROM rn GROUP BY cond)
, mo AS (SELECT cond, avg(dist) AS mean_d, stddev_pop(dist) AS std_d FROM p2 GROUP BY cond)
, pm AS (SELECT chain % 2 AS cond, lag, avg(msd) AS m FROM msd GROUP BY ALL)
, tp AS (SELECT cond, greatest(3, floor(max(lag) * 0.25)) AS top FROM pm GROUP BY cond)
, ft AS (SELECT pm.cond, regr_slope(log10(m), log10(lag)) AS alpha, pow(10.0, regr_intercept(log10(m), log10(lag))) AS k_alpha
   FROM pm JOIN tp ON tp.cond = pm.cond WHERE lag >= 2 AND lag <= top GROUP BY pm.cond HAVING count(*) >= 3)
, w AS (SELECT * FROM l2 JOIN dw USING (cond) JOIN mo USING (cond) LEFT JOIN ft USING (cond))
"""
DYN_NAMES = [
    "looped_fraction", "looped_sem", "n_dwells", "dwell_mean", "dwell_median", "dwell_max", "mean_d", "std_d", "alpha", "k_alpha",
]


@query("bnd3_dynamics_report", DYN + "SELECT cond, 'dynamics' AS \"group\", unnest([" + ", ".join(f"'{n}'" for n in DYN_NAMES)
       + "]) AS metric, round(unnest([" + ", ".join(f"CAST({n} AS DOUBLE)" for n in DYN_NAMES) + "]), 6) + 0.0 AS value FROM w", ("fx_pair",))
def _(t):
    # every part of the report reads the trace: build it once
    path = t.scratch("trace")
    t.fx("fx_pair").withColumn("cond", F.col("chain") % 2).write.parquet(path)
    rows = R.dynamics_report(t.spark.read.parquet(path), ["cond"], "chain", "frame", RADIUS, block=64, min_points=3, lag_min=2)
    return rows.select("cond", "group", "metric", round6(F.col("value")).alias("value"))


QUICK = f"""
, sm AS (SELECT cond, rep, i, j, v FROM fx_pixels)
, rf AS (SELECT cond AS reference, i, j, sum(v) AS v FROM fx_pixels GROUP BY ALL)
, ru AS (SELECT DISTINCT cond, rep, 'A' AS target FROM fx_pixels)
, pr AS (SELECT ru.*, r.reference FROM ru CROSS JOIN (SELECT DISTINCT reference FROM rf) r)
, ce AS (SELECT pr.cond, pr.rep, target, pr.reference, g.i, g.j, coalesce(sm.v, 0) AS s, coalesce(rf.v, 0) AS e FROM pr
  CROSS JOIN (SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j FROM range({N_BINS}) a, range({N_BINS}) b WHERE a.range < b.range) g
  LEFT JOIN sm ON sm.cond = pr.cond AND sm.rep = pr.rep AND sm.i = g.i AND sm.j = g.j
  LEFT JOIN rf ON rf.reference = pr.reference AND rf.i = g.i AND rf.j = g.j)
SELECT cond, rep, reference, reference = target AS is_target, round(corr(s, e) FILTER (s > 0 OR e > 0), 6) + 0.0 AS overall_pearson
FROM ce GROUP BY ALL"""


@query("bnd5_quick_report", QUICK, ("fx_pixels",))
def _(t):
    px = t.fx("fx_pixels")
    refs = px.groupBy(F.col("cond").alias("reference"), "i", "j").agg(F.sum("v").alias("v"))
    out = R.quick_report(px.withColumn("target", F.lit("A")), refs, ["cond", "rep"], N_BINS, RES, WIN)
    return out.select(
        "cond", "rep", "reference", "is_target", round6(F.col("overall_pearson")).alias("overall_pearson")
    )


@query("snk7_stored_stage", "SELECT cond, rep, i, j, v FROM fx_pixels", ("fx_pixels",))
def _(t):
    path = t.scratch("pixels")
    reuse_or_build(t.spark, path, lambda: t.fx("fx_pixels"), ["cond", "rep"])
    again = reuse_or_build(t.spark, path, lambda: t.fx("fx_pixels"), ["cond", "rep"])
    return again.select("cond", F.col("rep").cast("bigint").alias("rep"), "i", "j", "v")


@query("st1_running_contact_map", PAIRS + """
, fr AS (SELECT DISTINCT chain, frame FROM fx_beads)
SELECT p.chain, i, j, count(*) AS n, any_value(s.n) AS n_sub FROM pairs p JOIN (SELECT chain, count(*) AS n FROM fr GROUP BY chain) s ON s.chain = p.chain
GROUP BY p.chain, i, j""", ("fx_beads",))
def _(t):
    frames = t.stream("embeddings").select(F.col("label").alias("chain"), F.col("vec_id").alias("frame"), positions().alias("pos"))
    path = t.scratch("running-map")
    running_map.start_running_map(
        frames, f"{path}/map", f"{path}/state", ["chain"], N_BEADS, RADIUS
    ).awaitTermination()
    return running_map.running_map(t.spark, f"{path}/map", ["chain"]).drop("v")


@query("st2_running_dwell", """
WITH e AS (SELECT user_id % 5 AS series, CAST(event_id AS BIGINT) AS t, value < 50 AS hit FROM events)
, isl AS (SELECT series, t, t - row_number() OVER (PARTITION BY series ORDER BY t) AS g FROM e WHERE hit)
SELECT series, min(t) AS "start", max(t) AS "end", count(*) AS length FROM isl GROUP BY series, g""")
def _(t):
    trace = t.stream("events").select(
        (F.col("user_id") % 5).alias("series"), F.col("event_id").alias("t"), (F.col("value") < 50).alias("hit")
    )
    path = t.scratch("running-dwell")
    running_dwell.start_running_dwell(
        trace, f"{path}/runs", f"{path}/state", ["series"], "t", F.col("hit")
    ).awaitTermination()
    return running_dwell.running_runs(t.spark, f"{path}/runs", ["series"])
