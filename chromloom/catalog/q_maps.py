"""Map queries: insulation, comparison measures, observed over expected, balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromloom.catalog.fixtures import N_BINS, RES
from chromloom.catalog.q_curves import PS, curve, gradient, valid
from chromloom.catalog.registry import query
from chromloom.functions.numeric import round6
from chromloom.operators import curves as C
from chromloom.operators import maps as M
from chromloom.sources import hic as H

WIN = 8


def dense(cte: str, source: str) -> str:
    return f"""
, {cte} AS (SELECT cond, i, j, v FROM {source} UNION ALL SELECT cond, j, i, v FROM {source})
"""


def insulation_sql(name: str, source: str) -> str:
    """Block sums over both triangles of the map, bin by bin."""
    return dense(f"{name}_m", source) + f"""
, {name}_b AS (SELECT cond, b FROM (SELECT DISTINCT cond FROM {source}),
                (SELECT CAST(range AS INTEGER) AS b FROM range({N_BINS})))
, {name}_s AS (
  SELECT {name}_b.cond, b,
    coalesce(sum(v) FILTER (i >= b - {WIN} AND i < b AND j >= b AND j < b + {WIN}), 0) / {WIN * WIN}.0 AS dia,
    coalesce(sum(v) FILTER (i >= b - {WIN} AND i < b AND j >= b - {WIN} AND j < b), 0) / {WIN * WIN}.0 AS lft,
    coalesce(sum(v) FILTER (i >= b AND i < b + {WIN} AND j >= b AND j < b + {WIN}), 0) / {WIN * WIN}.0 AS rgt
  FROM {name}_b LEFT JOIN {name}_m ON {name}_m.cond = {name}_b.cond
    AND i >= b - {WIN} AND i < b + {WIN} AND j >= b - {WIN} AND j < b + {WIN}
  GROUP BY ALL)
, {name} AS (SELECT cond, b AS bin, CASE WHEN b >= {WIN} AND b < {N_BINS - WIN} AND dia > 0 AND lft + rgt > 0
               THEN log2(dia / ((lft + rgt) / 2)) END AS score FROM {name}_s)
"""


@query("ag11_insulation", insulation_sql("ins", "fx_maps") + """
SELECT cond, bin, round(score, 6) + 0.0 AS score FROM ins""", ("fx_maps",))
def _(t):
    return M.insulation(t.fx("fx_maps"), ["cond"], N_BINS, WIN).withColumn(
        "score", round6(F.col("score"))
    )


@query("ag12_insulation_zero", insulation_sql("ins", "fx_maps") + """
SELECT cond, bin, coalesce(round(score, 6) + 0.0, 0.0) AS score FROM ins""", ("fx_maps",))
def _(t):
    return M.insulation(t.fx("fx_maps"), ["cond"], N_BINS, WIN, undefined=0.0).withColumn(
        "score", round6(F.col("score"))
    )


# two conditions are compared: R stands for the simulated map, A for the experimental one;
# the grouping key is the replicate, so that several comparisons run in one job
CELLS = """
, sm AS (SELECT concat(cond, '-', rep) AS cond, i, j, v FROM fx_pixels WHERE cond <> 'A')
, ex AS (SELECT concat(o.cond, '-', e.rep) AS cond, i, j, v FROM fx_pixels e JOIN (VALUES ('R'), ('N')) o(cond) ON e.cond = 'A')
, cells AS (SELECT cond, i, j, coalesce(sm.v, 0) AS sim, coalesce(ex.v, 0) AS exp
            FROM sm FULL JOIN ex USING (cond, i, j))
"""
DIAG = f"""
, grid AS (SELECT cond, i, j FROM (SELECT DISTINCT cond FROM cells),
             (SELECT CAST(range AS INTEGER) AS i FROM range({N_BINS})),
             (SELECT CAST(range AS INTEGER) AS j FROM range({N_BINS})) WHERE i < j)
, full_cells AS (SELECT grid.cond, grid.i, grid.j, coalesce(sim, 0) AS sim, coalesce(exp, 0) AS exp
                 FROM grid LEFT JOIN cells ON cells.cond = grid.cond AND cells.i = grid.i AND cells.j = grid.j)
, diag AS (SELECT cond, j - i AS d, count(*) AS n, corr(sim, exp) AS r FROM full_cells
           GROUP BY ALL HAVING var_pop(sim) > 0 AND var_pop(exp) > 0)
, kept AS (SELECT *, {N_BINS} - row_number() OVER (PARTITION BY cond ORDER BY d) AS w FROM diag)
"""


def sides(t):
    """Maps of every condition, and the reference condition's beside each."""
    px, named = t.fx("fx_pixels"), lambda c: F.concat_ws("-", c, "rep").alias("cond")
    exp = px.where("cond = 'A'").withColumn("other", F.explode(F.array(F.lit("R"), F.lit("N"))))
    return px.where("cond <> 'A'").select(named("cond"), "i", "j", "v"), exp.select(named("other"), "i", "j", "v")


def cells(t):
    return M.join_maps(*sides(t), ["cond"])


@query("jn10_join_maps", CELLS + "SELECT cond, i, j, sim, exp FROM cells", ("fx_pixels",))
def _(t):
    return cells(t)


@query("ag13_overall_pearson", CELLS + """
SELECT cond, round(corr(sim, exp), 6) AS overall_pearson FROM cells
WHERE i < j AND (sim > 0 OR exp > 0) GROUP BY cond""", ("fx_pixels",))
def _(t):
    return M.overall_pearson(cells(t), ["cond"]).withColumn(
        "overall_pearson", round6(F.col("overall_pearson"))
    )


@query("ag14_diag_pearson", CELLS + DIAG + "SELECT cond, d, n, round(r, 6) + 0.0 AS r FROM diag",
       ("fx_pixels",))
def _(t):
    return M.diag_pearson(cells(t), ["cond"], N_BINS).withColumn("r", round6(F.col("r")))


@query("ag15_scc", CELLS + DIAG + """
SELECT cond, round(sum(w * r) / sum(w), 6) + 0.0 AS stratum_adjusted_corr FROM kept GROUP BY cond""",
       ("fx_pixels",))
def _(t):
    s = M.scc(M.diag_pearson(cells(t), ["cond"], N_BINS), ["cond"], N_BINS)
    return s.select("cond", round6(F.col("stratum_adjusted_corr")).alias("stratum_adjusted_corr"))


@query("ag15_scc_true_weights", CELLS + DIAG + """
SELECT cond, round(sum(n * r) / sum(n), 6) + 0.0 AS stratum_adjusted_corr FROM kept GROUP BY cond""",
       ("fx_pixels",))
def _(t):
    s = M.scc(M.diag_pearson(cells(t), ["cond"], N_BINS), ["cond"], N_BINS, compat=False)
    return s.select("cond", round6(F.col("stratum_adjusted_corr")).alias("stratum_adjusted_corr"))


@query("ag16_mean_diag_pearson", CELLS + DIAG + """
SELECT cond, round(avg(r), 6) + 0.0 AS mean_diag_pearson, count(*) AS n_diagonals
FROM kept GROUP BY cond""", ("fx_pixels",))
def _(t):
    s = M.scc(M.diag_pearson(cells(t), ["cond"], N_BINS), ["cond"], N_BINS)
    return s.select(
        "cond", round6(F.col("mean_diag_pearson")).alias("mean_diag_pearson"), "n_diagonals"
    )


def side_curve(name: str, source: str) -> str:
    return f"""
, {name} AS (
  SELECT c.cond, g.d, coalesce(s.sv, 0.0) / ({N_BINS} - g.d) AS p
  FROM (SELECT DISTINCT cond FROM {source}) c
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS d FROM range({N_BINS})) g
  LEFT JOIN (SELECT cond, j - i AS d, sum(v) AS sv FROM {source} GROUP BY ALL) s
    ON s.cond = c.cond AND s.d = g.d)
"""


BOTH_CURVES = CELLS + side_curve("ps_s", "sm") + side_curve("ps_e", "ex")
PSC = """
, psc AS (SELECT cond, CASE WHEN count(*) > 2 THEN round(corr(log10(a.p + 1e-10), log10(b.p + 1e-10)), 6) ELSE 0.0 END AS ps_curve_corr
          FROM ps_s a JOIN ps_e b USING (cond, d) WHERE a.p > 0 AND b.p > 0 GROUP BY cond)
"""
INSC = insulation_sql("is_s", "sm") + insulation_sql("is_e", "ex") + """
, insc AS (SELECT cond, CASE WHEN count(*) > 10 THEN round(corr(a.score, b.score), 6) + 0.0 ELSE 0.0 END AS insulation_corr
           FROM is_s a JOIN is_e b USING (cond, bin) WHERE a.score IS NOT NULL AND b.score IS NOT NULL
           GROUP BY cond)
"""


@query("ag17_ps_curve_corr", BOTH_CURVES + PSC + "SELECT * FROM psc", ("fx_pixels",))
def _(t):
    s, e = [C.ps_curve(m, ["cond"], N_BINS) for m in sides(t)]
    return M.ps_curve_corr(s, e, ["cond"]).withColumn("ps_curve_corr", round6(F.col("ps_curve_corr")))


@query("ag18_insulation_corr", CELLS + INSC + "SELECT * FROM insc", ("fx_pixels",))
def _(t):
    s, e = [M.insulation(m, ["cond"], N_BINS, WIN) for m in sides(t)]
    return M.insulation_corr(s, e, ["cond"]).withColumn(
        "insulation_corr", round6(F.col("insulation_corr"))
    )


def side_metrics(side: str) -> str:
    source = f"ps_{side[0]}"
    pts = f"""
, pt_{side} AS (SELECT cond, d, d * {RES} AS s, log10(d * {RES}) AS lx, log10(p) AS ly
                FROM {source} WHERE d > 0 AND p > 0)
""" + gradient(f"pt_{side}", "lx", "ly", f"g0_{side}") + f"""
, g_{side} AS (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY d) - 1 AS rk,
                 count(*) OVER (PARTITION BY cond) AS nv FROM g0_{side})
, m_{side} AS (SELECT c.cond"""
    for label, bp in C.MAGNITUDE_AT_BP.items():
        pts += f", round(max(c.p) FILTER (c.d = {bp // RES}), 6) + 0.0 AS {side}_p_{label}"
    pts += f""", (SELECT round(-regr_slope(ly, lx), 6) + 0.0 FROM pt_{side} q
        WHERE q.cond = c.cond AND s >= 2000 AND s < 30000) AS {side}_exponent
, (SELECT round(regr_intercept(ly, lx), 6) + 0.0 FROM pt_{side} q
        WHERE q.cond = c.cond AND s >= 2000 AND s < 30000) AS {side}_log_intercept"""
    for label, bp in C.SLOPE_AT_BP.items():
        pts += f""", (SELECT CASE WHEN rk >= 2 AND rk < nv - 2 AND nv > 5 THEN round(slope, 6) + 0.0 END FROM g_{side} q
        WHERE q.cond = c.cond ORDER BY abs(s - {bp}), s LIMIT 1) AS {side}_slope_{label}"""
    return pts + f" FROM {source} c GROUP BY c.cond)"


@query("ag19_compare_maps", BOTH_CURVES + DIAG + PSC + INSC + side_metrics("sim") + side_metrics("exp") + """
, op AS (SELECT cond, round(corr(sim, exp), 6) AS overall_pearson FROM cells
         WHERE i < j AND (sim > 0 OR exp > 0) GROUP BY cond)
, sc AS (SELECT cond, round(sum(w * r) / sum(w), 6) + 0.0 AS stratum_adjusted_corr,
                round(avg(r), 6) + 0.0 AS mean_diag_pearson, count(*) AS n_diagonals
         FROM kept GROUP BY cond)
SELECT * FROM op LEFT JOIN sc USING (cond) LEFT JOIN psc USING (cond) LEFT JOIN insc USING (cond)
LEFT JOIN m_sim USING (cond) LEFT JOIN m_exp USING (cond)""", ("fx_pixels",))
def _(t):
    out = M.compare_maps(*sides(t), ["cond"], N_BINS, RES, window=WIN)
    return out.select(*[
        F.col(c) if c in ("cond", "n_diagonals") else round6(F.col(c)).alias(c) for c in out.columns
    ])


@query("ag19_max_diag", CELLS + f"""
, near AS (SELECT * FROM cells WHERE j - i <= 20)
, sums AS (SELECT cond, j - i AS d, {N_BINS} - (j - i) AS n, sum(sim) AS sx, sum(exp) AS sy,
                  sum(sim * exp) AS sxy, sum(sim * sim) AS sxx, sum(exp * exp) AS syy
           FROM near WHERE j - i BETWEEN 1 AND 19 GROUP BY ALL)
SELECT cond, d, n, round((n * sxy - sx * sy) / sqrt(n * sxx - sx * sx) / sqrt(n * syy - sy * sy), 6) + 0.0 AS r
FROM sums WHERE n * sxx > sx * sx AND n * syy > sy * sy""", ("fx_pixels",))
def _(t):
    near = M.limit_distance(cells(t), 20)
    return M.diag_pearson(near, ["cond"], N_BINS, 20).withColumn("r", round6(F.col("r")))


OE = PS + """
, oe AS (SELECT m.cond, i, j, m.v, p AS expected, CASE WHEN p > 0 THEN m.v / p ELSE 0.0 END AS oe
         FROM fx_maps m JOIN ps ON ps.cond = m.cond AND ps.d = m.j - m.i)
"""


def oe(t):
    return M.observed_over_expected(t.fx("fx_maps"), curve(t), ["cond"])


@query("jn11_obs_over_exp", OE + """
SELECT cond, i, j, round(expected, 6) + 0.0 AS expected, round(oe, 6) + 0.0 AS oe FROM oe""", ("fx_maps",))
def _(t):
    return oe(t).select(
        "cond", "i", "j", round6(F.col("expected")).alias("expected"), round6(F.col("oe")).alias("oe")
    )


@query("ag79_log2_oe_map", OE + """
SELECT cond, i, j, CASE WHEN oe > 0 THEN round(log2(oe), 6) + 0.0 END AS log2_oe FROM oe""", ("fx_maps",))
def _(t):
    return oe(t).select("cond", "i", "j", round6(F.col("log2_oe")).alias("log2_oe"))


@query("ag78_map_difference", CELLS + "SELECT cond, i, j, sim - exp AS delta FROM cells", ("fx_pixels",))
def _(t):
    return M.map_difference(*sides(t), ["cond"])


@query("jn9_balance_pixels", """
SELECT cond, m.i, m.j, round(v * a.weight * b.weight, 6) + 0.0 AS v
FROM fx_maps m JOIN fx_bins a ON a.bin = m.i JOIN fx_bins b ON b.bin = m.j""", ("fx_maps", "fx_bins"))
def _(t):
    return M.balance(t.fx("fx_maps"), t.fx("fx_bins"), ["cond"], "weight").withColumn(
        "v", round6(F.col("v"))
    )


@query("jn9_balance_divisive", """
SELECT cond, m.i, m.j, round(v / (a.kr * b.kr), 6) + 0.0 AS v
FROM fx_maps m JOIN fx_bins a ON a.bin = m.i JOIN fx_bins b ON b.bin = m.j""", ("fx_maps", "fx_bins"))
def _(t):
    return M.balance(t.fx("fx_maps"), t.fx("fx_bins"), ["cond"], "kr").withColumn("v", round6(F.col("v")))


@query("ag7_ps_experimental", f"""
, bal AS (SELECT cond, m.i, m.j, v * a.weight * b.weight AS v
          FROM fx_maps m JOIN fx_bins a ON a.bin = m.i JOIN fx_bins b ON b.bin = m.j)
""" + side_curve("ps", "bal") + """
SELECT cond, d, CASE WHEN d >= 2 THEN round(p, 6) + 0.0 END AS p FROM ps""", ("fx_maps", "fx_bins"))
def _(t):
    balanced = M.balance(t.fx("fx_maps"), t.fx("fx_bins"), ["cond"], "weight")
    return C.ps_curve(balanced, ["cond"], N_BINS, min_diag=2).withColumn("p", round6(F.col("p")))


@query("ag63_colour_scale", """
SELECT cond, round(quantile_cont(v, 0.02), 6) AS vmin, round(quantile_cont(v, 0.99), 6) AS vmax
FROM fx_pixels WHERE v > 0 GROUP BY cond""", ("fx_pixels",))
def _(t):
    s = M.colour_scale(t.fx("fx_pixels"), ["cond"], 2.0, 99.0)
    return s.select("cond", round6(F.col("vmin")).alias("vmin"), round6(F.col("vmax")).alias("vmax"))


# Hi-C bins and pixels in genome coordinates: bins of two chromosomes from part, pixels from lineitem
HIC_SQL = """
, hb AS (SELECT 'chr' || (p_partkey % 2 + 1) AS chrom, CAST(floor(p_partkey / 2) * 1000 AS BIGINT) AS "start",
                CAST(floor(p_partkey / 2) * 1000 + 1000 AS BIGINT) AS "end", p_partkey AS bin,
                CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size / 25.0 END AS weight FROM part)
, hp AS (SELECT least(l_partkey, o_custkey) AS bin1, greatest(l_partkey, o_custkey) AS bin2, count(*) AS n
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
"""


def hic_bins(t):
    start = (F.floor(F.col("p_partkey") / 2) * 1000).cast("long")
    return t("part").select(
        F.concat(F.lit("chr"), F.col("p_partkey") % 2 + 1).alias("chrom"),
        start.alias("start"), (start + 1000).alias("end"), F.col("p_partkey").alias("bin"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 25.0).alias("weight"),
    )


def hic_pixels(t):
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(
        F.least("l_partkey", "o_custkey").alias("bin1"), F.greatest("l_partkey", "o_custkey").alias("bin2")
    ).agg(F.count(F.lit(1)).alias("n"))


HIC_WINDOW = """
SELECT CAST((a."start" - 20000) // 1000 AS INTEGER) AS i, CAST((b."start" - 20000) // 1000 AS INTEGER) AS j,
       round(coalesce(n * a.weight * b.weight, 0.0), 6) + 0.0 AS v
FROM hp JOIN hb a ON a.bin = bin1 JOIN hb b ON b.bin = bin2
WHERE a.chrom = 'chr1' AND b.chrom = 'chr1' AND a."start" >= 20000 AND a."start" < 400000
  AND b."start" >= 20000 AND b."start" < 400000"""


@query("src12_read_hic_region", "WITH x AS (SELECT 1)" + HIC_SQL + HIC_WINDOW)
def _(t):
    window = H.hic_region(
        hic_pixels(t), hic_bins(t), "chr1", 20_000, 400_000, 1000, column="weight"
    )
    return window.withColumn("v", round6(F.col("v")))


#: Base pairs of a block in the stored queries, so that the given bins fill several.
STORED_BLOCK = 100_000


def stored_pixels(t):
    path = t.scratch("pixels")
    H.store_pixels(hic_pixels(t), hic_bins(t), path, STORED_BLOCK)
    return path


@query("src12_stored_hic_region", "WITH x AS (SELECT 1)" + HIC_SQL + HIC_WINDOW)
def _(t):
    window = H.stored_region(t.spark, stored_pixels(t), "chr1", 20_000, 400_000, 1000, "weight", block=STORED_BLOCK)
    return window.withColumn("v", round6(F.col("v")))


@query("src13_check_hic_resolution", "WITH x AS (SELECT 1)" + HIC_SQL + """
SELECT min("end" - "start") AS bin_lo, max("end" - "start") AS bin_hi,
       min("end" - "start") = 1000 AND max("end" - "start") = 1000 AS ok FROM hb""")
def _(t):
    return H.resolution_check(hic_bins(t), 1000)


@query("ag7_longest_chromosome", "WITH x AS (SELECT 1)" + HIC_SQL + """
SELECT chrom, max("end") AS size FROM hb GROUP BY chrom ORDER BY size DESC, chrom LIMIT 1""")
def _(t):
    return H.longest_chromosome(hic_bins(t))


LONGEST_PS = "WITH x AS (SELECT 1)" + HIC_SQL + """
, lc AS (SELECT chrom, max("end") AS size FROM hb GROUP BY chrom ORDER BY size DESC, chrom LIMIT 1)
, w AS (SELECT floor(b."start" / 1000) - floor(a."start" / 1000) AS d, coalesce(n * a.weight * b.weight, 0.0) AS v
  FROM hp JOIN hb a ON a.bin = bin1 JOIN hb b ON b.bin = bin2 WHERE a.chrom = (SELECT chrom FROM lc) AND b.chrom = (SELECT chrom FROM lc))
, s AS (SELECT d, sum(v) AS sv FROM w GROUP BY d)
SELECT lc.chrom AS region, CAST(g.d AS INTEGER) AS d, CASE WHEN g.d >= 2 THEN round(coalesce(sv, 0.0) / (ceil(size / 1000) - g.d), 6) + 0.0 END AS p
FROM lc CROSS JOIN (SELECT unnest(range((SELECT CAST(ceil(size / 1000) AS BIGINT) FROM lc))) AS d) g LEFT JOIN s ON s.d = g.d"""


@query("ag7_ps_longest_chromosome", LONGEST_PS)
def _(t):
    c = H.ps_experimental(hic_pixels(t), hic_bins(t), 1000, column="weight")
    return c.withColumn("p", round6(F.col("p")))


@query("ag7_ps_stored_chromosome", LONGEST_PS)
def _(t):
    top = H.longest_chromosome(hic_bins(t)).first()
    window = H.stored_region(t.spark, stored_pixels(t), top["chrom"], 0, top["size"], 1000, "weight", block=STORED_BLOCK)
    return H.ps_of_window(window, top["chrom"], 0, top["size"], 1000).withColumn("p", round6(F.col("p")))


@query("prj15_balance_column", """
SELECT bin, round(weight, 6) AS by_true, round(weight, 6) AS by_auto, round(kr, 6) AS by_name,
       CAST(1.0 AS DOUBLE) AS by_false
FROM fx_bins""", ("fx_bins",))
def _(t):
    bins = t.fx("fx_bins")

    def chosen(asked):
        name = H.balance_column(bins.columns, asked)
        return round6(F.col(name) if name else F.lit(1.0))

    return bins.select(
        "bin", chosen(True).alias("by_true"), chosen("auto").alias("by_auto"),
        chosen("kr").alias("by_name"), chosen(False).alias("by_false"),
    )
