"""Quality check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromloom.catalog.q_io import LINES, WINDOW, bed_lines
from chromloom.catalog.registry import query
from chromloom.operators import checks as K
from chromloom.sources import intervals as I

PK = ("fx_peaks",)
LOCI = ("fx_peaks", "fx_loci")


@query("jn15_peaks_per_locus", """
SELECT l.name, count(p.name) AS n, CASE WHEN count(p.name) > 0 THEN 'PASS' ELSE 'WARN' END AS status
FROM fx_loci l LEFT JOIN fx_peaks p ON p.chrom = l.chrom AND p."end" > l.region_start AND p."start" < l.region_end GROUP BY l.name""", LOCI)
def _(t):
    return K.peaks_per_locus(t.fx("fx_peaks"), t.fx("fx_loci"))


@query("jn15_peak_locus_pairs", """
SELECT p.name, l.name AS locus FROM fx_loci l JOIN fx_peaks p ON p.chrom = l.chrom AND p."end" > l.region_start AND p."start" < l.region_end""", LOCI)
def _(t):
    windows = t.fx("fx_loci").select(
        F.col("name").alias("locus"), "chrom", F.col("region_start").alias("start"), F.col("region_end").alias("end")
    )
    peaks = t.fx("fx_peaks").select("name", "chrom", "start", "end")
    return K.interval_pairs(peaks, windows, 20_000).select("name", F.col("r_locus").alias("locus"))


BED = LINES + f"""
, ck AS (SELECT sample, nf < 6 OR s IS NULL OR e IS NULL AS bad, f[1] = '{WINDOW[0]}' AND NOT (nf < 6 OR s IS NULL OR e IS NULL) AS here,
  f[1] AS chrom, s, e, f[6] AS strand, floor((s + e) / 2) AS summit FROM fl)
, cw AS (SELECT *, here AND summit >= {WINDOW[1]} AND summit < {WINDOW[2]} AS ins, e - s AS w FROM ck)
, rp AS (SELECT sample, count(*) FILTER (NOT bad) AS sites, count(*) FILTER (bad) AS bad_lines, count(*) FILTER (here) AS on_chrom,
  count(*) FILTER (NOT bad AND chrom <> '{WINDOW[0]}') AS off_chrom, count(*) FILTER (here AND strand NOT IN ('+', '-')) AS bad_strand,
  count(*) FILTER (here AND strand = '+') AS plus, count(*) FILTER (here AND strand = '-') AS minus,
  count(*) FILTER (ins) AS in_window, count(*) FILTER (here AND NOT ins) AS out_of_window, count(*) FILTER (here AND s >= e) AS start_not_before_end,
  count(*) FILTER (here AND NOT (w > 10 AND w < 1000)) AS odd_width_1000, count(*) FILTER (here AND NOT (w > 10 AND w < 10000)) AS odd_width,
  min(w) FILTER (here) AS width_min, max(w) FILTER (here) AS width_max,
  count(*) FILTER (ins) - count(DISTINCT floor((summit - {WINDOW[1]}) / 1000)) FILTER (ins) AS duplicate_bins,
  round(count(*) FILTER (ins) / {(WINDOW[2] - WINDOW[1]) // 1000 / 100.0}, 6) AS per_100_bins FROM cw GROUP BY sample)
"""


def report(t):
    return K.bed_quality_report(I.parse_checked(bed_lines(t)), *WINDOW, 1000, ["sample"])


@query("ag56_bed_quality_report", BED + "SELECT * EXCLUDE (odd_width_1000) FROM rp")
def _(t):
    return report(t).withColumn("per_100_bins", F.round("per_100_bins", 6))


@query("ag56_upper_median_width", BED + """
SELECT sample, list_sort(list(w))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS width_median FROM cw WHERE here GROUP BY sample""")
def _(t):
    lines = I.parse_checked(bed_lines(t)).where(
        (F.col("n_fields") >= 6) & (F.col("chrom") == WINDOW[0]) & F.col("start").isNotNull() & F.col("end").isNotNull()
    )
    return K.upper_median_width(lines, ["sample"])


@query("ag56_status_rows", BED + """
, st AS (SELECT sample, unnest(['bad_lines', 'bad_strand', 'start_not_before_end', 'off_chrom', 'odd_width', 'duplicate_bins', 'on_chrom', 'in_window']) AS "check",
  unnest([bad_lines, bad_strand, start_not_before_end, off_chrom, odd_width, duplicate_bins, on_chrom, in_window]) AS n,
  unnest(['FAIL', 'FAIL', 'FAIL', 'WARN', 'WARN', 'WARN', 'some', 'some']) AS kind FROM rp)
SELECT sample, "check", n, CASE WHEN kind = 'some' THEN CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END WHEN n = 0 THEN 'PASS' ELSE kind END AS status FROM st""")
def _(t):
    return K.status_rows(report(t), ["sample"])


@query("ag57_check_summary", BED + """
, st AS (SELECT sample, unnest([bad_lines, bad_strand, start_not_before_end, off_chrom, odd_width, duplicate_bins, on_chrom, in_window]) AS n,
  unnest(['FAIL', 'FAIL', 'FAIL', 'WARN', 'WARN', 'WARN', 'some', 'some']) AS kind FROM rp)
, ss AS (SELECT sample, CASE WHEN kind = 'some' THEN CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END WHEN n = 0 THEN 'PASS' ELSE kind END AS status FROM st)
SELECT sample, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'FAIL') AS fail FROM ss GROUP BY sample""")
def _(t):
    return K.check_summary(K.status_rows(report(t), ["sample"]), ["sample"])


SIZES = """
, sz AS (SELECT chrom, CAST(max("end") - CASE chrom WHEN 'chr2' THEN 1 ELSE 0 END AS BIGINT) AS size FROM fx_peaks WHERE chrom <> 'chr4' GROUP BY chrom
  UNION ALL SELECT '4', max("end") FROM fx_peaks WHERE chrom = 'chr4')
"""


def sizes(t):
    top = t.fx("fx_peaks").groupBy("chrom").agg(F.max("end").cast("bigint").alias("size"))
    return top.select(
        F.when(F.col("chrom") == "chr4", "4").otherwise(F.col("chrom")).alias("chrom"),
        (F.col("size") - F.when(F.col("chrom") == "chr2", 1).otherwise(0)).alias("size"),
    )


@query("ag57_chromosome_checks", SIZES + """
SELECT l.name, l.chrom, CASE WHEN size IS NULL OR region_end > size THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN size IS NULL AND EXISTS (SELECT 1 FROM sz o WHERE o.chrom = substr(l.chrom, 4)) THEN substr(l.chrom, 4) END AS hint
FROM fx_loci l LEFT JOIN sz ON sz.chrom = l.chrom""", LOCI)
def _(t):
    named = t.fx("fx_loci").select("name", "chrom", F.col("region_end").alias("end"))
    return K.chromosome_checks(named, sizes(t))


@query("ag57_peaks_past_end", SIZES + """
SELECT sample, p.chrom, max("end") AS last, any_value(size) AS size FROM fx_peaks p JOIN sz ON sz.chrom = p.chrom GROUP BY ALL HAVING max("end") > any_value(size)""", PK)
def _(t):
    return K.peaks_past_end(t.fx("fx_peaks"), sizes(t), ["sample"])


@query("ag57_size_agreement", SIZES + """
, hc AS (SELECT chrom, CAST(max("end") AS BIGINT) AS hic_size FROM fx_peaks GROUP BY chrom)
SELECT hc.chrom, hic_size, size AS genome_size, CASE WHEN size IS NULL THEN 'WARN' WHEN size = hic_size THEN 'PASS' ELSE 'FAIL' END AS status
FROM hc LEFT JOIN sz ON sz.chrom = hc.chrom""", PK)
def _(t):
    hic = t.fx("fx_peaks").groupBy("chrom").agg(F.max("end").cast("bigint").alias("size"))
    return K.size_agreement(hic, sizes(t))


@query("ag57_input_check_report", SIZES + """
, ls AS (SELECT sample, chrom, max("end") AS last FROM fx_peaks WHERE NOT (sample = 'P' AND chrom = 'chr3') GROUP BY ALL)
, ins AS (SELECT DISTINCT p.sample, l.name FROM fx_peaks p JOIN fx_loci l ON p.chrom = l.chrom AND p."end" > region_start AND p."start" < region_end
   WHERE NOT (p.sample = 'P' AND p.chrom = 'chr3'))
SELECT 'window' AS "check", name AS subject, l.chrom AS detail, CASE WHEN size IS NULL OR region_end > size THEN 'FAIL' ELSE 'PASS' END AS status
  FROM fx_loci l LEFT JOIN sz ON sz.chrom = l.chrom
UNION ALL SELECT 'peaks in window', s.sample, l.name, CASE WHEN ls.last IS NULL THEN 'FAIL' WHEN ins.name IS NOT NULL THEN 'PASS' ELSE 'WARN' END
  FROM fx_loci l CROSS JOIN (SELECT DISTINCT sample FROM ls) s LEFT JOIN ls ON ls.sample = s.sample AND ls.chrom = l.chrom
  LEFT JOIN ins ON ins.sample = s.sample AND ins.name = l.name
UNION ALL SELECT 'peaks inside chromosomes', ls.sample, '', CASE WHEN bool_or(coalesce(last > size, false)) THEN 'FAIL' ELSE 'PASS' END FROM ls LEFT JOIN sz ON sz.chrom = ls.chrom GROUP BY ls.sample
UNION ALL SELECT 'chromosome length', hc.chrom, '', CASE WHEN size IS NULL THEN 'WARN' WHEN size = m THEN 'PASS' ELSE 'FAIL' END
  FROM (SELECT chrom, max("end") AS m FROM fx_peaks GROUP BY chrom) hc LEFT JOIN sz ON sz.chrom = hc.chrom""", LOCI)
def _(t):
    peaks = t.fx("fx_peaks")
    hic = peaks.groupBy("chrom").agg(F.max("end").cast("bigint").alias("size"))
    return K.input_check_report(
        t.fx("fx_loci"), sizes(t), peaks.where("NOT (sample = 'P' AND chrom = 'chr3')"), hic
    )


@query("ag58_locus_checks", """
WITH lo AS (SELECT c_name AS name, 'chr' || (c_custkey % 3) AS chrom,
   CASE WHEN c_custkey % 11 = 0 THEN '64.21Mb' ELSE CAST(c_custkey * 500 AS VARCHAR) END AS region_start,
   CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey * 500 + 10000 END AS VARCHAR) AS region_end FROM customer)
, pr AS (SELECT *, try_cast(region_start AS BIGINT) AS s, try_cast(region_end AS BIGINT) AS e, CASE chrom WHEN 'chr1' THEN 100000 WHEN 'chr2' THEN 900000 END AS size FROM lo)
SELECT name, CASE WHEN s IS NULL OR e IS NULL THEN 'not whole numbers' WHEN s < 0 OR e <= s THEN 'empty window' WHEN s % 1000 <> 0 OR e % 1000 <> 0 THEN 'off grid'
  WHEN size IS NULL THEN 'unknown chromosome' WHEN e > size THEN 'past chromosome end' END AS problem,
  CAST(floor(s / 1000) * 1000 AS BIGINT) AS aligned_start, CAST(ceil(e / 1000) * 1000 AS BIGINT) AS aligned_end FROM pr""")
def _(t):
    c = F.col("c_custkey")
    loci = t("customer").select(
        F.col("c_name").alias("name"), F.concat(F.lit("chr"), c % 3).alias("chrom"),
        F.when(c % 11 == 0, "64.21Mb").otherwise((c * 500).cast("string")).alias("region_start"),
        F.when(c % 7 == 0, F.lit(0)).otherwise(c * 500 + 10000).cast("string").alias("region_end"),
    )
    known = t.spark.createDataFrame([("chr1", 100_000), ("chr2", 900_000)], "chrom string, size long")
    return K.locus_checks(loci, known, 1000)


@query("ag64_chrom_counts", """
SELECT sample, chrom, count(*) AS n, count(*) FILTER (off % 2 = 0) AS plus, count(*) FILTER (off % 2 = 1) AS minus FROM fx_peaks GROUP BY ALL""", PK)
def _(t):
    sites = t.fx("fx_peaks").withColumn("strand", F.when(F.col("off") % 2 == 0, "+").otherwise("-"))
    return K.chrom_counts(sites, ["sample"])


@query("ag71_condition_checks", """
SELECT o_orderkey AS name, CASE WHEN o_custkey % 130 / 100.0 > 1 THEN 'capture' WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'peaks column'
  WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'span' WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'factor' END AS problem FROM orders""")
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    conds = t("orders").select(
        k.alias("name"), F.lit(0.0).alias("capture_min"), (c % 130 / 100.0).alias("capture_max"),
        F.when(F.col("o_orderstatus") == "F", "loading").alias("feature"),
        F.when(k % 5 != 0, "peaks").alias("peaks"),
        F.when(k % 3 == 0, "gene").when(k % 2 == 0, "peak").alias("span"), (k % 7).cast("double").alias("factor"),
    )
    return K.condition_checks(conds)


@query("ag71_factor_checks", """
WITH fc AS (SELECT o_custkey AS name, 'f' || (o_orderkey % 40) AS factor FROM orders)
, cr AS (SELECT o_custkey AS name, 'f' || (o_orderkey % 40) AS factor_a, 'f' || (o_orderkey % 39) AS factor_b FROM orders)
SELECT name, 'repeated factor' AS problem, factor AS detail FROM fc GROUP BY name, factor HAVING count(*) > 1
UNION ALL SELECT DISTINCT name, 'unknown factor', f FROM (SELECT name, factor_a AS f FROM cr UNION ALL SELECT name, factor_b FROM cr) x
WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.name = x.name AND fc.factor = x.f)""")
def _(t):
    name, a = F.col("o_custkey").alias("name"), F.concat(F.lit("f"), F.col("o_orderkey") % 40)
    factors = t("orders").select(name, a.alias("factor"))
    cross = t("orders").select(
        name, a.alias("factor_a"), F.concat(F.lit("f"), F.col("o_orderkey") % 39).alias("factor_b")
    )
    return K.factor_checks(factors, cross)


SAMPLES = """
, sa AS (SELECT condition AS name, CASE WHEN lower(trim(peaks)) NOT IN ('', 'na', 'none', '.') THEN trim(peaks) END AS peaks,
  CASE WHEN lower(trim(hic)) NOT IN ('', 'na', 'none', '.') THEN trim(hic) END AS hic FROM fx_samples)
, co AS (SELECT c_custkey AS name, 'NATION_' || (c_custkey % 30) AS ctcf_type, CASE WHEN c_custkey % 2 = 0 THEN 'peaks' END AS loading_column,
  CASE WHEN c_custkey % 3 = 0 THEN 'NATION_1' END AS loading_sample, 'hic' AS pausing_column, CAST(NULL AS VARCHAR) AS pausing_sample FROM customer)
"""


def conditions(t):
    c = F.col("c_custkey")
    return t("customer").select(
        c.alias("name"), F.concat(F.lit("NATION_"), c % 30).alias("ctcf_type"),
        F.when(c % 2 == 0, "peaks").alias("loading_column"), F.when(c % 3 == 0, "NATION_1").alias("loading_sample"),
        F.lit("hic").alias("pausing_column"), F.lit(None).cast("string").alias("pausing_sample"),
    )


def sample_files(t):
    from chromloom.catalog.q_io import samples

    return samples(t).select(F.col("condition").alias("name"), "peaks", "hic")


@query("jn16_missing_samples", SAMPLES + """
SELECT co.name, ctcf_type, CASE WHEN sa.name IS NULL THEN 'no sample' ELSE 'no file' END AS problem
FROM co LEFT JOIN sa ON sa.name = ctcf_type WHERE sa.peaks IS NULL""", ("fx_samples",))
def _(t):
    return K.missing_samples(conditions(t), sample_files(t), "ctcf_type", "peaks")


@query("jn16_feature_files", SAMPLES + """
, fe AS (SELECT name, 'loading' AS feature, coalesce(loading_sample, ctcf_type) AS sample, loading_column AS "column" FROM co WHERE loading_column IS NOT NULL
  UNION ALL SELECT name, 'pausing', coalesce(pausing_sample, ctcf_type), pausing_column FROM co)
SELECT fe.name, feature, fe.sample, "column", CASE "column" WHEN 'peaks' THEN sa.peaks ELSE sa.hic END AS file FROM fe LEFT JOIN sa ON sa.name = fe.sample""", ("fx_samples",))
def _(t):
    return K.feature_files(conditions(t), sample_files(t), ["loading", "pausing"])
