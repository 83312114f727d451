"""Summary queries: harvest of result files, pivots, significance, timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromloom.catalog.q_dynamics import r6
from chromloom.catalog.registry import query
from chromloom.functions import text as X
from chromloom.plans import summary as P

# result files written from orders: one per (priority, key) with a kind chosen by the key
RUNS = """
WITH fr AS (SELECT 'cond' || substr(o_orderpriority, 1, 1) AS condition, o_orderkey AS k, o_custkey AS c, CAST(floor(o_orderkey / 4) AS BIGINT) % 6 AS kind,
   CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey AS INTEGER) END AS replicate, o_orderkey % 100 AS n_blocks FROM orders)
"""


def files(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.floor(k / 4) % 6
    stem = F.concat(
        F.lit("cond"), F.substring("o_orderpriority", 1, 1), F.lit("_"), k % 100, F.lit("blk_"),
        F.when(k % 4 != 0, F.concat(F.lit("rep"), k)).otherwise("pooled"), F.lit("_"),
    )
    suffix = (
        F.when(kind == 0, "ps_metrics").when(kind == 1, "calibration").when(kind == 2, "metrics")
        .when(kind == 3, "loop_fractions").when(kind == 4, F.concat(F.lit("msd_a-"), k % 3))
        .otherwise("apa_loops_quant")
    )
    body = (
        F.when(kind == 0, F.format_string(
            '{"metrics": {"P(s=10kb)": %d, "dlogP_dlogs_at_5kb": -%d.5, "note": "x"}, "fit": {"exponent": %d, "window": 3}}', c, c, k))
        .when(kind == 1, F.format_string('{"nm_per_monomer": %d, "source": "hic", "metadata": {"bp_per_monomer": %d}}', c, k))
        .when(kind == 2, F.format_string('{"overall_pearson": 0.%d, "mean_diag_pearson": null}', c))
        .when(kind == 3, F.format_string('[{"label": "a", "looped_fraction": 0.%d}, {"label": "b", "looped_fraction": null}]', c))
        .when(kind == 4, F.format_string(
            '{"alpha_fit": {"alpha": %d, "K_alpha": %d}, "saturation_fit": {"J": 2.5}, "pair": {"sep_monomers": 10}}', c, k))
        .otherwise(F.format_string('{"n_pairs": 3, "loops": [{"strength": %d}, {"strength": %d}, {"strength": null}]}', c, k))
    )
    broken = F.when(k % 50 == 7, "{broken").otherwise(body)
    name = F.when(k % 50 == 8, F.concat(F.lit("other_"), k)).otherwise(F.concat(stem, suffix, F.lit(".json")))
    # a generated row keeps the long expressions from being copied into every parsing step
    return t("orders").select(F.explode(F.array(F.struct(name.alias("name"), broken.alias("value")))).alias("f")).select("f.*")


HARVEST = RUNS + """
, ok AS (SELECT * FROM fr WHERE k % 50 NOT IN (7, 8))
, nm AS (SELECT * FROM fr WHERE k % 50 <> 8)
, hv AS (
 SELECT condition, n_blocks, replicate, 'P(s)' AS "group", 'P(s=10kb)' AS metric, CAST(c AS DOUBLE) AS value FROM ok WHERE kind = 0
 UNION ALL SELECT condition, n_blocks, replicate, 'P(s)_derivative', 'dlogP_dlogs_at_5kb', -(c + 0.5) FROM ok WHERE kind = 0
 UNION ALL SELECT condition, n_blocks, replicate, 'P(s)', 'fit_exponent', k FROM ok WHERE kind = 0
 UNION ALL SELECT condition, n_blocks, replicate, 'provenance', 'n_pooled_conformations', n_blocks FROM nm WHERE kind = 0 AND replicate IS NULL
 UNION ALL SELECT condition, n_blocks, replicate, 'calibration', 'nm_per_monomer', c FROM ok WHERE kind = 1
 UNION ALL SELECT condition, n_blocks, replicate, 'calibration', 'bp_per_monomer', k FROM ok WHERE kind = 1
 UNION ALL SELECT condition, n_blocks, replicate, 'sim_vs_exp', 'overall_pearson', CAST('0.' || c AS DOUBLE) FROM ok WHERE kind = 2
 UNION ALL SELECT condition, n_blocks, replicate, 'dynamics', 'looped_fraction[a]', CAST('0.' || c AS DOUBLE) FROM ok WHERE kind = 3
 UNION ALL SELECT condition, n_blocks, replicate, 'MSD', 'alpha[a-' || k % 3 || ']', c FROM ok WHERE kind = 4
 UNION ALL SELECT condition, n_blocks, replicate, 'MSD', 'K_alpha[a-' || k % 3 || ']', k FROM ok WHERE kind = 4
 UNION ALL SELECT condition, n_blocks, replicate, 'MSD', 'sat_J[a-' || k % 3 || ']', 2.5 FROM ok WHERE kind = 4
 UNION ALL SELECT condition, n_blocks, replicate, 'MSD', 'sep_monomers[a-' || k % 3 || ']', 10 FROM ok WHERE kind = 4
 UNION ALL SELECT condition, n_blocks, replicate, 'AbLE', 'apa_n_pairs', 3 FROM ok WHERE kind = 5
 UNION ALL SELECT condition, n_blocks, replicate, 'AbLE', 'apa_strength_median', (c + k) / 2.0 FROM ok WHERE kind = 5
 UNION ALL SELECT condition, n_blocks, replicate, 'AbLE', 'apa_strength_mean', (c + k) / 2.0 FROM ok WHERE kind = 5)
"""


@query("ag54_harvest_metrics", HARVEST + """SELECT condition, n_blocks, replicate, "group", metric, value FROM hv""")
def _(t):
    return P.harvest(files(t))


@query("src18_read_metric_json", HARVEST + """
SELECT condition, n_blocks, replicate, CASE kind WHEN 0 THEN 'ps_metrics' WHEN 1 THEN 'calibration' WHEN 2 THEN 'metrics' WHEN 3 THEN 'loop_fractions'
  WHEN 4 THEN 'msd' ELSE 'apa_loops_quant' END AS artefact, CASE WHEN kind = 4 THEN 'a-' || k % 3 END AS label FROM nm""")
def _(t):
    return P.parse_names(files(t)).select("condition", "n_blocks", "replicate", "artefact", "label")


@query("sc5_calibration_sources", HARVEST + """
SELECT condition, 'calibration' AS "group", 'source' AS metric, 'hic' AS value_str FROM ok WHERE kind = 1 AND replicate IS NULL""")
def _(t):
    return P.harvest_sources(files(t))


TABLE = """
WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, 'c' || o_orderkey AS condition FROM orders)
"""


def table_files(t, fmt, *cells):
    return t("orders").select(F.format_string(fmt, *cells).alias("value"))


@query("ag54_derivative_table", TABLE + """
SELECT condition, 'P(s)_derivative' AS "group", 'slope_min' AS metric, -CAST(c AS DOUBLE) AS value, NULL AS value_str FROM r
UNION ALL SELECT condition, 'P(s)_derivative', 'search_bp', NULL, '20000-' || '2e+06' FROM r""")
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return P.harvest_derivative_table(table_files(
        t, '{"table": {"c%d": {"slope_min": -%d, "search_bp": [20000.0, 2000000.0], "note": "x"}}}', k, c
    ))


@query("ag54_able_table", TABLE + """
SELECT condition, 'AbLE' AS "group", m || '[1-2]' AS metric, CAST(v AS DOUBLE) AS value FROM (
  SELECT condition, 'able_strength' AS m, c AS v FROM r UNION ALL SELECT condition, 'able_center', k FROM r UNION ALL SELECT condition, 'able_background', 3 FROM r)""")
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return P.harvest_able_table(table_files(
        t, '{"pair_labels": ["1-2"], "strength": {"1-2": {"c%d": %d, "z": null}}, "center_mean": {"1-2": {"c%d": %d}}, "background_mean": {"1-2": {"c%d": 3}}}',
        k, c, k, k, k,
    ))


@query("ag54_msd_stats", TABLE + """
SELECT condition, 'MSD' AS "group", m || '[p]' AS metric, CAST(v AS DOUBLE) AS value FROM (
  SELECT condition, 'alpha_mean_perrep' AS m, c AS v FROM r UNION ALL SELECT condition, 'alpha_sem_perrep', 2 FROM r
  UNION ALL SELECT condition, 'n_replicates_fit', 4 FROM r UNION ALL SELECT condition, 'K_alpha_mean_perrep', k FROM r)""")
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return P.harvest_msd_stats(table_files(
        t, '{"pairs": {"p": {"conditions": {"c%d": {"alpha_summary": {"mean": %d, "sem": 2, "n": 4}, "K_alpha_summary": {"mean": %d}}}}}}', k, c, k
    ))


METRICS = """
, mx AS (SELECT cond AS condition, rep AS replicate, CASE metric WHEN 'F' THEN 'MSD' WHEN 'O' THEN 'P(s)' ELSE 'zeta' END AS "group",
   CASE metric WHEN 'F' THEN 'K_alpha' ELSE metric END AS metric, value FROM fx_metrics)
"""
CONDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def metrics(t):
    m = F.col("metric")
    return t.fx("fx_metrics").select(
        F.col("cond").alias("condition"), F.col("rep").alias("replicate"),
        F.when(m == "F", "MSD").when(m == "O", "P(s)").otherwise("zeta").alias("group"),
        F.when(m == "F", "K_alpha").otherwise(m).alias("metric"), "value",
    )


def pooled(t):
    """The mean over all replicates of a condition."""
    return metrics(t).groupBy("condition", "group", "metric").agg(F.avg("value").alias("value"))


def columns(expr: str, names=CONDS) -> str:
    return ", ".join(f"""{expr.format(c=c)} AS "{c}" """ for c in names)


@query("ag52_summary_pivot", METRICS + """
SELECT "group", metric, """ + columns("round(avg(value) FILTER (condition = '{c}'), 6)") + """,
 CASE "group" WHEN 'MSD' THEN 6 WHEN 'P(s)' THEN 3 ELSE 9 END AS group_place FROM mx GROUP BY "group", metric""", ("fx_metrics",))
def _(t):
    wide = P.summary_pivot(pooled(t), CONDS)
    return r6(wide, *CONDS)


@query("ag53_per_replicate_pivot", METRICS + """
SELECT "group", metric, """ + ", ".join(
    f"""round(max(value) FILTER (condition = '{c}' AND replicate = {r}), 6) AS "{c}_rep{r}" """
    for c in CONDS for r in range(4)
) + """ FROM mx GROUP BY "group", metric""", ("fx_metrics",))
def _(t):
    m = metrics(t)
    wide = P.per_replicate_pivot(m, P.pivot_columns(m))
    return r6(wide, *[c for c in wide.columns if c not in ("group", "metric")])


@query("snk5_write_metric_tables", METRICS + """
SELECT "group", metric, """ + columns("coalesce(printf('%.4f', avg(value) FILTER (condition = '{c}')), '')") + """
FROM mx GROUP BY "group", metric""", ("fx_metrics",))
def _(t):
    wide = P.summary_pivot(pooled(t), CONDS).drop("group_place")
    return P.formatted(wide, CONDS)


@query("srt4_group_order", METRICS + """
SELECT "group", CAST(row_number() OVER (ORDER BY CASE "group" WHEN 'MSD' THEN 6 WHEN 'P(s)' THEN 3 ELSE 9 END) AS INTEGER) AS place FROM (SELECT DISTINCT "group" FROM mx)""",
       ("fx_metrics",))
def _(t):
    from chromloom.operators.runs import place_by

    groups = metrics(t).select("group").distinct().withColumn("_p", P.group_place(F.col("group")))
    return place_by(groups, "_p", "group").select("group", "place")


@query("sc7_table_cells", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 1e4 THEN format('{:.4g}', o_totalprice) ELSE printf('%.4f', o_totalprice) END AS big,
  CASE WHEN o_totalprice / 1e9 < 1e-3 THEN format('{:.4g}', o_totalprice / 1e9) ELSE printf('%.4f', o_totalprice / 1e9) END AS tiny FROM orders""")
def _(t):
    v = F.col("o_totalprice")
    return t("orders").select("o_orderkey", X.table_cell(v).alias("big"), X.table_cell(v / 1e9).alias("tiny"))


# significance uses resampling: rows-only here, parts of it have SQL forms above
@query("bnd4_significance_table")
def _(t):
    return P.significance_cells(P.significance(metrics(t)))


@query("bnd4_build_summary", HARVEST + """
SELECT condition, replicate, "group", metric, value, NULL AS value_str FROM hv
UNION ALL SELECT condition, NULL, 'calibration', 'source', NULL, 'hic' FROM ok WHERE kind = 1 AND replicate IS NULL""")
def _(t):
    return P.build_summary(files(t))


@query("ag55_benchmark_summary", """
SELECT o_orderpriority AS "rule", o_orderstatus AS job,
  CAST(max(o_totalprice) AS BIGINT) // 1 AS dummy FROM orders GROUP BY ALL""".replace(
    "CAST(max(o_totalprice) AS BIGINT) // 1 AS dummy",
    "printf('%d:%02d:%02d', CAST(floor(max(o_totalprice) / 3600) AS BIGINT), CAST(floor(max(o_totalprice) / 60) AS BIGINT) % 60, CAST(floor(max(o_totalprice)) AS BIGINT) % 60) AS s, max(o_custkey) AS mem",
))
def _(t):
    jobs = t("orders").select(
        F.col("o_orderpriority").alias("rule"), F.col("o_orderstatus").alias("job"),
        F.col("o_totalprice").alias("s"), F.col("o_custkey").alias("mem"),
    )
    return P.benchmark_summary(jobs)


@query("src19_job_labels", """
SELECT o_orderkey, 'r' || o_custkey AS "rule", 'x_' || o_orderkey AS job FROM orders""")
def _(t):
    from chromloom.sources.tables import label_jobs

    stem = F.concat(F.lit("r"), F.col("o_custkey"), F.lit("_x_"), F.col("o_orderkey"))
    return label_jobs(t("orders").select("o_orderkey", stem.alias("_stem")))


@query("sc9_json_values", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'k' AS name FROM events""")
def _(t):
    props = F.from_json("props", P.STRING_MAP)
    return t("events").select("event_id", F.explode(props).alias("name", "k")).select(
        "event_id", F.col("k").cast("bigint").alias("k"), "name"
    )
