"""Loop queries: pile-ups, strength, observed over expected, background-subtracted scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromloom.catalog.fixtures import N_BINS
from chromloom.catalog.q_curves import PS, curve
from chromloom.catalog.q_maps import dense
from chromloom.catalog.registry import query
from chromloom.functions.numeric import round6
from chromloom.operators import loops as L
from chromloom.operators.sites import convergent_pairs

# loops: convergent pairs of every type and locus, looked up in the map of every condition
LOOPS = """
, loops AS (SELECT m.cond, p.anchor1, p.anchor2 FROM (
    SELECT a.bin AS anchor1, b.bin AS anchor2 FROM fx_sites a JOIN fx_sites b
      ON a.ctcf_type = b.ctcf_type AND a.locus = b.locus
    WHERE a.ori = 1 AND b.ori = -1 AND b.bin - a.bin >= 5 AND b.bin - a.bin < 40) p,
  (SELECT DISTINCT cond FROM fx_maps) m)
""" + dense("mm", "fx_maps")
FX = ("fx_sites", "fx_maps")


def site_loops(t):
    pairs = convergent_pairs(t.fx("fx_sites"), ["ctcf_type", "locus"], 5, 40)
    return pairs.withColumn(
        "cond", F.explode(F.array(*[F.lit(c) for c in ("A", "N", "R")]))
    ).select("cond", "anchor1", "anchor2")


PAD = 5
PILE = LOOPS + f"""
, used AS (SELECT *, 1.0 AS sc FROM loops WHERE anchor1 >= {PAD} AND anchor2 + {PAD + 1} <= {N_BINS})
"""
PILE_OE = PS + LOOPS + f"""
, used AS (SELECT loops.*, 1.0 / p AS sc FROM loops JOIN ps ON ps.cond = loops.cond AND ps.d = anchor2 - anchor1
           WHERE anchor1 >= {PAD} AND anchor2 + {PAD + 1} <= {N_BINS} AND p > 0)
"""
IMAGE = f"""
, off AS (SELECT CAST(range AS INTEGER) AS o FROM range(-{PAD}, {PAD} + 1))
, lc AS (SELECT cond, anchor1, anchor2, count(*) AS c, any_value(sc) AS sc FROM used GROUP BY ALL)
, img AS (SELECT lc.cond, x.o AS di, y.o AS dj, sum(c * sc * coalesce(v, 0)) AS s, sum(c) AS n_used
          FROM lc CROSS JOIN off x CROSS JOIN off y
          LEFT JOIN mm ON mm.cond = lc.cond AND mm.i = anchor1 + x.o AND mm.j = anchor2 + y.o
          GROUP BY ALL)
"""
STRENGTH = """
SELECT cond, round(avg(s / n_used) FILTER (di BETWEEN -1 AND 1 AND dj BETWEEN -1 AND 1)
       / avg(s / n_used) FILTER (di BETWEEN -4 AND -2 AND dj BETWEEN -4 AND -2), 6) + 0.0 AS strength
FROM img GROUP BY cond"""


@query("ag20_apa_pileup", PILE + IMAGE + """
SELECT cond, di, dj, round(s / n_used, 6) + 0.0 AS v, CAST(n_used AS BIGINT) AS n_used FROM img""", FX)
def _(t):
    return _pileup(t).withColumn("v", round6(F.col("v")))


@query("ag20_apa_pileup_oe", PILE_OE + IMAGE + """
SELECT cond, di, dj, round(s / n_used, 6) + 0.0 AS v, CAST(n_used AS BIGINT) AS n_used FROM img""", FX)
def _(t):
    return _pileup(t, curve(t)).withColumn("v", round6(F.col("v")))


@query("ag21_loop_strength", PILE + IMAGE + STRENGTH, FX)
def _(t):
    return L.loop_strength(_pileup(t), ["cond"]).withColumn("strength", round6(F.col("strength")))


def _pileup(t, expected=None):
    return L.apa_pileup(t.fx("fx_maps"), site_loops(t), ["cond"], N_BINS, PAD, expected)


@query("jn12_image_around_loop", LOOPS + """
SELECT l.cond, anchor1, anchor2, CAST(mm.i - anchor1 AS INTEGER) AS di, CAST(mm.j - anchor2 AS INTEGER) AS dj, v
FROM (SELECT DISTINCT * FROM loops) l JOIN mm ON mm.cond = l.cond
 AND mm.i BETWEEN anchor1 - 2 AND anchor1 + 2 AND mm.j BETWEEN anchor2 - 2 AND anchor2 + 2""", FX)
def _(t):
    at = L.distinct_loops(site_loops(t), ["cond"]).drop("copies")
    return L.image_cells(t.fx("fx_maps"), at, ["cond"], 2)


@query("ag26_loop_oe", PS + LOOPS + """
SELECT l.cond, anchor1, anchor2, count(*) AS copies, round(coalesce(any_value(m.v), 0.0), 6) AS observed,
       CASE WHEN any_value(p) > 0 THEN round(coalesce(any_value(m.v), 0.0) / any_value(p), 6) END AS oe
FROM loops l LEFT JOIN fx_maps m ON m.cond = l.cond AND m.i = anchor1 AND m.j = anchor2
JOIN ps ON ps.cond = l.cond AND ps.d = anchor2 - anchor1 GROUP BY l.cond, anchor1, anchor2""", FX)
def _(t):
    at = L.distinct_loops(site_loops(t), ["cond"])
    return L.loop_oe(t.fx("fx_maps"), at, curve(t), ["cond"]).select(
        "cond", "anchor1", "anchor2", "copies", round6(F.col("observed")).alias("observed"),
        round6(F.col("oe")).alias("oe"),
    )


LOCAL, DISK, CUT = 8, 3, 2
ABLE = PS + LOOPS + f"""
, lp AS (SELECT cond, anchor1, anchor2, count(*) AS copies FROM loops GROUP BY ALL)
, off AS (SELECT CAST(range AS INTEGER) AS o FROM range(-{LOCAL}, {LOCAL} + 1))
, im0 AS (
  SELECT lp.cond, anchor1, anchor2, x.o AS x, y.o AS y, greatest(anchor2 - anchor1 + y.o - x.o, 0) AS s,
    anchor1 + x.o < 0 OR anchor1 + x.o >= {N_BINS} AS off_r, anchor2 + y.o < 0 OR anchor2 + y.o >= {N_BINS} AS off_c
  FROM lp CROSS JOIN off x CROSS JOIN off y)
, im AS (
  SELECT im0.*, coalesce(mm.v, 0.0) AS v, p, abs(x) + abs(y) <= {LOCAL} AS dia
  FROM im0 JOIN ps ON ps.cond = im0.cond AND ps.d = least(s, {N_BINS - 1})
  LEFT JOIN mm ON mm.cond = im0.cond AND mm.i = anchor1 + x AND mm.j = anchor2 + y)
, st AS (
  SELECT cond, anchor1, anchor2, bool_or(off_r OR off_c) AS stripe,
    coalesce(bool_or((off_r AND abs(x) <= 5) OR (off_c AND abs(y) <= 5)), false) AS near,
    median(CASE WHEN p > 0 THEN v / p ELSE CAST('Infinity' AS DOUBLE) END)
      FILTER (dia AND NOT off_r AND NOT off_c AND (p > 0 OR v > 0)) AS med
  FROM im GROUP BY ALL)
, fi AS (
  SELECT im.*, st.stripe, st.near, st.med,
    CASE WHEN off_r OR off_c THEN med * p WHEN p > 0 THEN v WHEN stripe THEN 0.0 END AS w
  FROM im JOIN st USING (cond, anchor1, anchor2))
, sc AS (
  SELECT cond, anchor1, anchor2, any_value(near) AS near, any_value(stripe) AS stripe, any_value(med) AS med,
    sum(p * w) FILTER (dia AND s > {CUT}) / sum(p * p) FILTER (dia AND s > {CUT} AND w IS NOT NULL) AS c,
    sum(w) FILTER (x * x + y * y <= {DISK * DISK}) AS disk,
    avg(w) FILTER (x * x + y * y <= {DISK * DISK}) AS center,
    sum(p) FILTER (x * x + y * y <= {DISK * DISK} AND w IS NOT NULL) AS bg,
    avg(p) FILTER (x * x + y * y <= {DISK * DISK}) AS bgm
  FROM fi GROUP BY ALL)
"""


@query("ag22_able_score", ABLE + """
SELECT cond, anchor1, anchor2,
  CASE WHEN NOT near THEN round(disk - c * bg, 4) + 0.0 END AS strength,
  CASE WHEN NOT near THEN round(center, 6) + 0.0 END AS center_mean,
  CASE WHEN NOT near THEN round(c * bgm, 6) + 0.0 END AS background_mean,
  CASE WHEN NOT near THEN round(c, 6) + 0.0 END AS c_best_fit
FROM sc""", FX)
def _(t):
    return _rounded(_able(t, False))


@query("ag24_resolve_nan_stripes", ABLE + """
SELECT cond, anchor1, anchor2, CASE WHEN stripe AND NOT near THEN round(med, 6) END AS fill,
       NOT near AS usable FROM sc""", FX)
def _(t):
    s = _able(t, False)
    return s.select(
        "cond", "anchor1", "anchor2", round6(F.col("fill")).alias("fill"),
        F.col("strength").isNotNull().alias("usable"),
    )


@query("ag22_able_linear", ABLE + f"""
SELECT cond, anchor1, anchor2, round(disk - c * bg, 4) + 0.0 AS strength,
  round(center, 6) + 0.0 AS center_mean, round(c * bgm, 6) + 0.0 AS background_mean, round(c, 6) + 0.0 AS c_best_fit
FROM sc WHERE anchor1 >= {LOCAL} AND anchor2 + {LOCAL + 1} <= {N_BINS}""", FX)
def _(t):
    s = L.able_linear(
        t.fx("fx_maps"), site_loops(t), curve(t), ["cond"], N_BINS, LOCAL, DISK, CUT
    )
    return _rounded(s)


def _rounded(s):
    return s.select(
        "cond", "anchor1", "anchor2", (F.round("strength", 4) + F.lit(0.0)).alias("strength"),
        *[round6(F.col(c)).alias(c) for c in ("center_mean", "background_mean", "c_best_fit")],
    )


def _able(t, outliers):
    return L.able_score(
        t.fx("fx_maps"), site_loops(t), curve(t), ["cond"], N_BINS, LOCAL, DISK, CUT,
        sigma=2.0, outlier_radius=2.0, outliers=outliers,
    )


# the blur and local-maximum search has no SQL form: rows-only here, analytic cases in the tests
@query("ag23_able_outliers")
def _(t):
    s = _able(t, True)
    return s.select(
        "cond", "anchor1", "anchor2", "n_outliers", (F.round("strength", 4) + F.lit(0.0)).alias("strength")
    )


@query("ag25_able_across_conditions", ABLE + """
, want AS (SELECT DISTINCT c.cond, anchor1, anchor2 FROM lp,
           (SELECT DISTINCT cond FROM fx_maps UNION ALL SELECT 'X') c)
SELECT want.cond, want.anchor1, want.anchor2, CASE WHEN NOT near THEN round(disk - c * bg, 4) + 0.0 END AS strength
FROM want LEFT JOIN sc ON sc.cond = want.cond AND sc.anchor1 = want.anchor1 AND sc.anchor2 = want.anchor2""", FX)
def _(t):
    pairs = L.distinct_loops(site_loops(t).drop("cond"), []).drop("copies")
    wanted = pairs.withColumn("cond", F.explode(F.array(*[F.lit(c) for c in "ANRX"])))
    s = L.able_across_maps(_able(t, False), wanted, ["cond"])
    return s.select(
        "cond", "anchor1", "anchor2", (F.round("strength", 4) + F.lit(0.0)).alias("strength")
    )


@query("ag51_apa_strength_summary", ABLE + """
, r AS (SELECT sc.cond, disk - c * bg AS s, near FROM loops JOIN sc USING (cond, anchor1, anchor2))
SELECT cond, count(*) AS n_pairs, round(median(s) FILTER (NOT near), 4) + 0.0 AS median_strength,
       round(avg(s) FILTER (NOT near), 4) + 0.0 AS mean_strength FROM r GROUP BY cond""", FX)
def _(t):
    s = L.apa_strength_summary(_able(t, False), ["cond"])
    return s.select(
        "cond", "n_pairs", (F.round("median_strength", 4) + F.lit(0.0)).alias("median_strength"),
        (F.round("mean_strength", 4) + F.lit(0.0)).alias("mean_strength"),
    )
