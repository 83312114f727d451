"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromloom.catalog.registry import query
from chromloom.functions import numeric as M
from chromloom.functions import text as X
from chromloom.functions.numeric import round6


@query("sc1_math", """
SELECT event_id, CASE WHEN value > 0 THEN round(log10(value), 6) + 0.0 END AS lg10, CASE WHEN value > 0 THEN round(log2(value), 6) + 0.0 END AS lg2,
  round(pow(value, 1.5), 4) AS pw, round(sqrt(value), 6) AS rt, least(greatest(value, 10.0), 50.0) AS clipped FROM events""")
def _(t):
    v = F.col("value")
    return t("events").select(
        "event_id", round6(M.log10_pos(v)).alias("lg10"), round6(F.when(v > 0, F.log2(v))).alias("lg2"),
        F.round(F.pow(v, 1.5), 4).alias("pw"), round6(F.sqrt(v)).alias("rt"),
        F.least(F.greatest(v, F.lit(10.0)), F.lit(50.0)).alias("clipped"),
    )


@query("sc3_guards", """
SELECT event_id, value > 20 AS positive, value >= 20 AND value <> 20 AS finite,
  CASE WHEN value > 20 THEN round(1 / (value - 20), 6) + 0.0 END AS inverse FROM events""".replace("value >= 20 AND value <> 20", "value > 20"))
def _(t):
    v = F.col("value") - 20
    odd = F.when(v > 0, v).when(v == 0, F.lit(float("nan"))).when(v < -10, F.lit(float("inf")))
    return t("events").select(
        "event_id", M.is_positive(odd).alias("positive"), M.is_finite(odd).alias("finite"),
        round6(M.ratio(F.lit(1.0), F.when(M.is_positive(odd), odd))).alias("inverse"),
    )


@query("sc4_human_bp", """
SELECT o_orderkey, CASE WHEN b >= 1000000 THEN CASE WHEN abs(b / 1e6 - round(b / 1e6)) < 1e-6 THEN format('{:.0f}', b / 1e6) ELSE format('{:g}', b / 1e6) END || 'Mb'
  WHEN b >= 1000 THEN CASE WHEN abs(b / 1e3 - round(b / 1e3)) < 1e-6 THEN format('{:.0f}', b / 1e3) ELSE format('{:g}', b / 1e3) END || 'kb'
  ELSE format('{:.0f}', CAST(b AS DOUBLE)) || 'bp' END AS label
FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 5 % 3000000 AS b FROM orders)""")
def _(t):
    b = F.col("o_orderkey") * F.col("o_orderkey") * 5 % 3_000_000
    return t("orders").select("o_orderkey", X.human_bp(b).alias("label"))


@query("sc6_safe_label", """
SELECT o_orderkey, 'a_' || o_custkey || '_' || o_orderkey AS label FROM orders""")
def _(t):
    label = F.concat(F.lit("a:"), F.col("o_custkey"), F.lit("/"), F.col("o_orderkey"))
    return t("orders").select("o_orderkey", X.safe_label(label).alias("label"))


@query("sc8_hms", """
SELECT o_orderkey, printf('%d:%02d:%02d', CAST(floor(o_totalprice / 3600) AS BIGINT), CAST(floor(o_totalprice / 60) AS BIGINT) % 60, CAST(floor(o_totalprice) AS BIGINT) % 60) AS t FROM orders""")
def _(t):
    return t("orders").select("o_orderkey", X.hms(F.col("o_totalprice")).alias("t"))


@query("sc10_range_label", """
SELECT o_orderkey, format('{:g}', CAST(o_orderkey AS DOUBLE)) || '-' || format('{:g}', CAST(o_custkey * 1000 AS DOUBLE)) AS label FROM orders""")
def _(t):
    pair = F.array(F.col("o_orderkey").cast("double"), (F.col("o_custkey") * 1000).cast("double"))
    return t("orders").select("o_orderkey", X.range_label(pair).alias("label"))


@query("sc11_gene_label", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Gm' || p_partkey WHEN p_partkey % 3 = 1 THEN p_name ELSE '?' END AS label,
  p_partkey % 3 = 0 AS placeholder FROM part""")
def _(t):
    k = F.col("p_partkey")
    symbol = F.when(k % 3 == 0, F.concat(F.lit(" Gm"), k)).otherwise("  ")
    label = X.gene_label(symbol, F.when(k % 3 == 1, F.col("p_name")))
    return t("part").select(k, label.alias("label")).withColumn(
        "placeholder", X.is_placeholder_gene(F.col("label"))
    )


@query("sc12_genome_tag", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'mm10' WHEN p_partkey % 3 = 1 THEN 'GRCh38' END AS tag FROM part""")
def _(t):
    k = F.col("p_partkey")
    path = F.concat(
        F.lit("hg19/"), F.when(k % 3 == 0, "ctcf_MM10_").when(k % 3 == 1, "x_grch38").otherwise("y"), k, F.lit(".bed")
    )
    return t("part").select("p_partkey", X.genome_tag(path).alias("tag"))


@query("sc13_log_rule", """
SELECT p_partkey, p_partkey % 5 <> 4 AS log10 FROM part""")
def _(t):
    names = F.array(*[F.lit(n) for n in (
        "K_alpha[a-b]", "looped_fraction[x]", "apa_strength_median", "apa_n_pairs", "alpha[a-b]"
    )])
    metric = F.get(names, (F.col("p_partkey") % 5).cast("int"))
    return t("part").select("p_partkey", X.uses_log10(metric).alias("log10"))


@query("sc14_seed_of", """
SELECT o_orderkey, 42 + (o_orderkey % 5) * 10000 + (o_custkey % 7) * 1000 AS seed FROM orders""")
def _(t):
    return t("orders").select(
        "o_orderkey", X.seed_of(F.lit(42), F.col("o_orderkey") % 5, F.col("o_custkey") % 7).alias("seed")
    )
