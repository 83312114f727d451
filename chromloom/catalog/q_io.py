"""Source and sink queries: text lines derived from the tables, parsed and formatted."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromloom.catalog.q_curves import PS, RES, curve
from chromloom.catalog.registry import query
from chromloom.operators import motifs, sites
from chromloom.sinks import bed, tables as out_tables
from chromloom.sources import intervals as I
from chromloom.sources import tables as S

WINDOW = ("chr1", 50_000, 350_000)
N = 300

LINES = """
WITH bl AS (SELECT o_orderkey AS line, o_orderstatus AS sample,
 CASE WHEN k % 17 = 0 THEN '# note ' || k WHEN k % 19 = 0 THEN 'track name=t' || k
  WHEN k % 53 = 0 THEN 'browser position' WHEN k % 41 = 0 THEN '   '
  WHEN k % 23 = 0 THEN concat_ws(chr(9), chrom, s)
  WHEN k % 29 = 0 THEN concat_ws(chr(9), chrom, s, e)
  WHEN k % 31 = 0 THEN concat_ws(chr(9), chrom, s, e, 'p' || k, 'x', st)
  WHEN k % 37 = 0 THEN concat_ws(chr(9), chrom, 'abc', e, 'p' || k, k % 1000, st)
  WHEN k % 43 = 0 THEN concat_ws(chr(9), chrom, s, e, 'p' || k, k % 1000)
  ELSE concat_ws(chr(9), chrom, s, e, 'p' || k, k % 1000, st, ((k * 7) % 1000) || '.5', 3, 2,
     CASE WHEN k % 11 = 0 THEN '-1' WHEN k % 13 = 0 THEN 'x' ELSE CAST(k % 500 AS VARCHAR) END) END AS value
 FROM (SELECT *, o_orderkey AS k, 'chr' || (o_custkey % 4 + 1) AS chrom, CAST(floor(o_totalprice) AS INTEGER) AS s,
   CAST(floor(o_totalprice) + 500 + o_orderkey % 1000 AS INTEGER) AS e,
   CASE o_orderkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS st FROM orders))
, raw AS (SELECT line, sample, value, string_split(value, chr(9)) AS f,
    regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS v FROM bl)
, fl AS (SELECT line, sample, f, len(f) AS nf, try_cast(f[2] AS INTEGER) AS s, try_cast(f[3] AS INTEGER) AS e,
    starts_with(value, 'browser') AS br
  FROM raw WHERE v <> '' AND NOT starts_with(value, '#') AND NOT starts_with(value, 'track'))
"""


def bed_lines(t):
    k = F.col("o_orderkey")
    chrom = F.concat(F.lit("chr"), F.col("o_custkey") % 4 + 1)
    s = F.floor("o_totalprice").cast("int")
    e = (s + 500 + k % 1000).cast("int")
    st = F.when(k % 3 == 0, "+").when(k % 3 == 1, "-").otherwise(".")
    name, score = F.concat(F.lit("p"), k), k % 1000

    def tab(*cells):
        return F.concat_ws("\t", *[c.cast("string") for c in cells])

    off = F.when(k % 11 == 0, "-1").when(k % 13 == 0, "x").otherwise((k % 500).cast("string"))
    value = (
        F.when(k % 17 == 0, F.concat(F.lit("# note "), k))
        .when(k % 19 == 0, F.concat(F.lit("track name=t"), k))
        .when(k % 53 == 0, "browser position").when(k % 41 == 0, "   ")
        .when(k % 23 == 0, tab(chrom, s)).when(k % 29 == 0, tab(chrom, s, e))
        .when(k % 31 == 0, tab(chrom, s, e, name, F.lit("x"), st))
        .when(k % 37 == 0, tab(chrom, F.lit("abc"), e, name, score, st))
        .when(k % 43 == 0, tab(chrom, s, e, name, score))
        .otherwise(tab(chrom, s, e, name, score, st, F.concat((k * 7) % 1000, F.lit(".5")),
                       F.lit(3), F.lit(2), off))
    )
    # a generated row keeps the long expression from being copied into every parsing step
    return t("orders").select(
        k.alias("line"), F.col("o_orderstatus").alias("sample"), F.explode(F.array(value)).alias("value")
    )


PEAKS = LINES + """
, pk AS (SELECT line, sample, f[1] AS chrom, s AS "start", e AS "end", CASE WHEN nf > 3 THEN f[4] ELSE '.' END AS name,
   CASE WHEN nf > 4 THEN try_cast(f[5] AS DOUBLE) ELSE 0.0 END AS score, CASE WHEN nf > 5 THEN f[6] ELSE '.' END AS strand,
   CASE WHEN nf >= 10 AND try_cast(f[10] AS INTEGER) IS NOT NULL THEN CAST(s + try_cast(f[10] AS INTEGER) AS INTEGER)
        ELSE CAST(floor((s + e) / 2) AS INTEGER) END AS summit
 FROM fl WHERE nf >= 3 AND s IS NOT NULL AND e IS NOT NULL)
"""


@query("src1_read_peaks", PEAKS + "SELECT * FROM pk")
def _(t):
    return I.parse_peaks(bed_lines(t))


@query("src1_unreadable_lines", LINES + """
SELECT sample, count(*) AS n_lines, count(*) FILTER (nf < 3 OR s IS NULL OR e IS NULL) AS n_bad FROM fl GROUP BY sample""")
def _(t):
    return I.unreadable_lines(bed_lines(t), 3, ["sample"])


@query("src1_read_peaks_region", PEAKS + f"""
SELECT * FROM pk WHERE chrom = '{WINDOW[0]}' AND "end" >= {WINDOW[1]} AND "start" <= {WINDOW[2]}""")
def _(t):
    return I.parse_peaks(bed_lines(t), WINDOW)


SIGNAL = LINES + f"""
, sp AS (SELECT line, sample, f[1] AS chrom, s AS "start", e AS "end",
   coalesce(CASE WHEN nf > 6 THEN try_cast(f[7] AS DOUBLE) WHEN nf > 4 THEN try_cast(f[5] AS DOUBLE) END, 1.0) AS signal,
   CASE WHEN nf > 9 AND try_cast(f[10] AS INTEGER) >= 0 THEN s + try_cast(f[10] AS INTEGER) ELSE floor((s + e) / 2) END AS summit
 FROM fl WHERE nf >= 3 AND NOT br AND f[1] = '{WINDOW[0]}' AND e > {WINDOW[1]} AND s < {WINDOW[2]})
"""


@query("src2_read_signal_peaks", SIGNAL + f"""
SELECT line, sample, chrom, "start", "end", signal, CAST(floor((summit - {WINDOW[1]}) / 1000) AS INTEGER) AS bin FROM sp
WHERE floor((summit - {WINDOW[1]}) / 1000) BETWEEN 0 AND {N - 1}""")
def _(t):
    return I.parse_signal_peaks(bed_lines(t), *WINDOW, 1000)


SPAN = SIGNAL + f"""
, span AS (SELECT *, unnest(range(CAST(greatest(0, floor(("start" - {WINDOW[1]}) / 1000)) AS BIGINT),
   CAST(least({N - 1}, floor(("end" - 1 - {WINDOW[1]}) / 1000)) AS BIGINT) + 1)) AS b FROM sp)
"""


@query("prj3_bins_spanned", SPAN + """
SELECT line, sample, chrom, "start", "end", signal, CAST(b AS INTEGER) AS bin FROM span""")
def _(t):
    return I.parse_signal_peaks(bed_lines(t), *WINDOW, 1000, span="peak")


@query("ag66_signal_max_per_bin", SPAN + """
SELECT sample, CAST(b AS INTEGER) AS bin, max(signal) AS signal FROM span GROUP BY ALL""")
def _(t):
    return sites.signal_max_per_bin(
        I.parse_signal_peaks(bed_lines(t), *WINDOW, 1000, span="peak"), ["sample"]
    )


@query("src3_read_peak_intervals", LINES + """
SELECT line, sample, f[1] AS chrom, s AS "start", e AS "end" FROM fl WHERE NOT br AND s IS NOT NULL AND e IS NOT NULL""")
def _(t):
    return I.parse_intervals(bed_lines(t))


ORIENTED = LINES + f"""
, ob AS (SELECT line, sample, f[1] AS chrom, s AS "start", e AS "end", f[4] AS name, coalesce(try_cast(f[5] AS DOUBLE), 0.0) AS score,
   f[6] AS strand FROM fl WHERE nf >= 6 AND s IS NOT NULL AND e IS NOT NULL
   AND f[1] = '{WINDOW[0]}' AND e >= {WINDOW[1]} AND s <= {WINDOW[2]})
"""


@query("src4_read_oriented_bed", ORIENTED + "SELECT * FROM ob")
def _(t):
    return I.parse_oriented(bed_lines(t), WINDOW)


SITES = LINES + f"""
, st AS (SELECT line, sample, CAST(floor((floor((s + e) / 2) - {WINDOW[1]}) / 1000) AS INTEGER) AS bin,
   CASE WHEN nf <= 5 OR f[6] = '+' THEN 1 ELSE -1 END AS ori, CASE WHEN nf > 3 THEN f[4] ELSE '' END AS name
  FROM fl WHERE nf >= 3 AND f[1] = '{WINDOW[0]}')
"""


@query("src5_load_sites", SITES + f"SELECT * FROM st WHERE bin >= 0 AND bin < {N}")
def _(t):
    return I.load_sites(bed_lines(t), WINDOW[0], WINDOW[1], N, 1000)


@query("snk9_sites_in_window_list", SITES + f"""
SELECT sample, bin, ori, count(*) AS n FROM st WHERE bin >= 0 AND bin < {N} GROUP BY ALL""")
def _(t):
    s = I.load_sites(bed_lines(t), WINDOW[0], WINDOW[1], N, 1000)
    return s.groupBy("sample", "bin", "ori").agg(F.count(F.lit(1)).alias("n"))


@query("src6_read_elements_bed", LINES + f"""
, el AS (SELECT line, sample, CAST(floor((floor((s + e) / 2) - {WINDOW[1]}) / 1000) AS INTEGER) AS bin
  FROM fl WHERE nf >= 3 AND f[1] = '{WINDOW[0]}' AND e >= {WINDOW[1]} AND s <= {WINDOW[2]})
SELECT * FROM el WHERE bin >= 0 AND bin < {N}""")
def _(t):
    return I.parse_elements(bed_lines(t), *WINDOW, 1000, N)


@query("src7_read_samplesheet", """
SELECT concat_ws('_', project, cell_type, condition) AS name, project, cell_type, condition,
  CASE WHEN lower(trim(peaks)) NOT IN ('', 'na', 'none', '.') THEN trim(peaks) END AS peaks,
  CASE WHEN lower(trim(hic)) NOT IN ('', 'na', 'none', '.') THEN trim(hic) END AS hic FROM fx_samples""",
       ("fx_samples",))
def _(t):
    return samples(t)


def samples(t):
    return S.tidy_samplesheet(
        t.fx("fx_samples"), ["project", "cell_type", "condition"], ["peaks", "hic"]
    )


@query("src7_duplicate_names", """
SELECT cell_type AS name, count(*) AS n FROM fx_samples GROUP BY cell_type HAVING count(*) > 1""", ("fx_samples",))
def _(t):
    return S.duplicate_names(S.tidy_samplesheet(t.fx("fx_samples"), ["cell_type"], ["peaks"]))


@query("prj10_run_name", """
SELECT concat_ws('_', CASE WHEN min(project) = max(project) THEN min(project) END,
  CASE WHEN min(cell_type) = max(cell_type) THEN min(cell_type) END,
  CASE WHEN min(condition) = max(condition) THEN min(condition) END) AS run_name FROM fx_samples""", ("fx_samples",))
def _(t):
    return S.shared_metadata(samples(t), ["project", "cell_type", "condition"])


@query("snk6_write_samplesheet", """
SELECT project, cell_type, condition,
  CASE WHEN lower(trim(peaks)) NOT IN ('', 'na', 'none', '.') THEN trim(peaks) END AS peaks,
  CASE WHEN lower(trim(hic)) NOT IN ('', 'na', 'none', '.') THEN trim(hic) END AS hic,
  concat_ws('_', project, cell_type, condition) AS "sampleName" FROM fx_samples""", ("fx_samples",))
def _(t):
    s = samples(t)
    return s.select(*[c for c in s.columns if c != "name"], F.col("name").alias("sampleName"))


@query("src8_read_genome_sizes", """
SELECT c_name AS chrom, CAST(c_custkey * 1000 + 500 AS BIGINT) AS size FROM customer""")
def _(t):
    rows = t("customer").select(
        F.col("c_name").alias("a"), (F.col("c_custkey") * 1000 + 500).cast("string").alias("b"),
        F.lit("0").alias("c"),
    )
    return S.parse_genome_sizes(rows)


@query("src9_genome_sizes_from_fasta", """
SELECT 'seq' || doc_id AS chrom, CAST(coalesce(list_sum([length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) for x in string_split(replace(text, '>', 'N'), chr(10))]), 0) AS BIGINT) AS size FROM documents""")
def _(t):
    # every document a sequence of many lines in real files, so most splits begin inside one
    folder = t.scratch("sequences")
    t("documents").select(F.concat(
        F.lit(">seq"), F.col("doc_id"), F.lit(" "), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce(F.replace("text", F.lit(">"), F.lit("N")), F.lit(""))
    ).alias("value")).write.text(folder)
    return S.genome_sizes_from_fasta(t.spark, folder)


@query("src11_read_contact_map", "SELECT cond, i, j, v FROM fx_maps", ("fx_maps",))
def _(t):
    from chromloom.sources.frames import conform_map

    return conform_map(t.fx("fx_maps"), ["cond"])


@query("src14_read_loops_tsv", """
SELECT CAST(floor((o_custkey * 100 - 5000) / 1000) AS INTEGER) AS anchor1, CAST(floor((o_orderkey * 10 - 5000) / 1000) AS INTEGER) AS anchor2
FROM orders WHERE o_orderkey % 4 = 1 AND floor((o_custkey * 100 - 5000) / 1000) >= 0
 AND floor((o_custkey * 100 - 5000) / 1000) < floor((o_orderkey * 10 - 5000) / 1000) AND floor((o_orderkey * 10 - 5000) / 1000) < 500""")
def _(t):
    rows = t("orders").select(
        F.concat(F.lit("chr"), F.col("o_orderkey") % 4).alias("chrom"),
        (F.col("o_custkey") * 100).cast("string").alias("anchor1"),
        (F.col("o_orderkey") * 10).cast("string").alias("anchor2"),
    )
    return I.parse_loops(rows, "chr1", 5000, 500, 1000)


@query("src15_read_bedpe_loops", """
SELECT o_orderkey AS line, 'chr1' AS chrom1, CAST(o_custkey AS INTEGER) AS start1, CAST(o_custkey + 10 AS INTEGER) AS end1,
  'chr1' AS chrom2, CAST(o_custkey + 500 AS INTEGER) AS start2, CAST(o_custkey + 510 AS INTEGER) AS end2 FROM orders""")
def _(t):
    k = F.col("o_custkey")
    value = F.concat_ws("\t", F.lit("chr1"), k, k + 10, F.lit("chr1"), k + 500, k + 510, F.lit("x"))
    return I.parse_bedpe(t("orders").select(F.col("o_orderkey").alias("line"), value.alias("value")))


@query("src16_read_experimental_msd", """
SELECT user_id, CAST(event_id AS DOUBLE) AS dt_s, value AS msd_um2 FROM events WHERE event_id % 10 <> 3""")
def _(t):
    rows = t("events").select(
        "user_id", F.col("event_id").cast("string").alias("DT_s"),
        F.when(F.col("event_id") % 10 == 3, "n/a").otherwise(F.col("value").cast("string")).alias("Msd_um2"),
    )
    return S.parse_experimental_msd(rows)


@query("src17_read_motif_hits", """
SELECT l_orderkey AS line, 'w' || l_orderkey AS sequence_name, CASE l_returnflag WHEN 'R' THEN '-' ELSE '+' END AS strand,
  round(l_tax + 0.001, 3) AS p, CAST(l_partkey AS INTEGER) AS "start", CAST(l_partkey + 19 AS INTEGER) AS stop
FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_suppkey % 9 <> 0""")
def _(t):
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("line"), F.concat(F.lit("w"), "l_orderkey").alias("Sequence Name"),
        F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "+").otherwise(".").alias("strand"),
        F.round(F.col("l_tax") + 0.001, 3).cast("string").alias("P-value"),
        F.when(F.col("l_suppkey") % 9 == 0, "bad").otherwise(F.col("l_partkey").cast("string")).alias("start"),
        (F.col("l_partkey") + 19).cast("string").alias("End"),
    )
    return I.parse_motif_hits(rows)


def windows(t):
    start = F.floor("o_totalprice").cast("int")
    return t("orders").select(
        F.concat(F.lit("w"), "o_orderkey").alias("name"),
        F.concat(F.lit("chr"), F.col("o_custkey") % 4 + 1).alias("chrom"),
        F.greatest(start - 100, F.lit(0)).alias("start0"), (start + 100).alias("end"),
        F.col("o_orderkey").alias("key"),
    )


def motif_hits(t):
    """Hits that name their window, a region of it, or the chromosome, by line number."""
    start = F.col("l_extendedprice").cast("int")
    kind = F.col("l_suppkey") % 3
    name = (
        F.when(kind == 0, F.concat(F.lit("w"), "l_orderkey", F.lit("::chr1:5-9")))
        .when(kind == 1, F.concat(F.lit("chr"), F.col("l_partkey") % 4 + 1, F.lit(":"), start, F.lit("-"), start + 200))
        .otherwise(F.concat(F.lit("chr"), F.col("l_partkey") % 4 + 1))
    )
    at = F.when(kind == 1, F.col("l_linenumber") * 9).otherwise(start + F.col("l_linenumber"))
    return t("lineitem").select(
        name.alias("sequence_name"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
        F.round(F.col("l_tax") + 0.001, 3).alias("p"), at.cast("int").alias("start"),
        (at + 19).cast("int").alias("stop"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line"),
    )


MATCH = """
WITH wn AS (SELECT 'w' || o_orderkey AS name, 'chr' || (o_custkey % 4 + 1) AS chrom,
   CAST(greatest(floor(o_totalprice) - 100, 0) AS INTEGER) AS start0, CAST(floor(o_totalprice) + 100 AS INTEGER) AS "end", o_orderkey AS key FROM orders)
, mh AS (SELECT l_orderkey, l_suppkey % 3 AS kind, 'chr' || (l_partkey % 4 + 1) AS chrom, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
   round(l_tax + 0.001, 3) AS p,
   trunc(l_extendedprice) + CASE WHEN l_suppkey % 3 = 1 THEN l_linenumber * 9 ELSE l_linenumber END AS s FROM lineitem)
, mt AS (SELECT key, strand, p FROM mh JOIN wn ON kind = 0 AND wn.name = 'w' || l_orderkey
  UNION ALL SELECT key, strand, p FROM mh JOIN wn ON kind <> 0 AND wn.chrom = mh.chrom AND start0 < s AND s + 19 <= "end")
"""


@query("jn14_motif_hit_windows", MATCH + """
SELECT key, count(*) AS n, min(p) AS p, count(*) FILTER (strand = '+') AS plus FROM mt GROUP BY key""")
def _(t):
    return motifs.hits_per_window(motif_hits(t), windows(t))


BEST = """
, best AS (SELECT peak, strand, p FROM (SELECT *, row_number() OVER (PARTITION BY peak ORDER BY p, l_linenumber, l_partkey, l_suppkey, strand) AS rn
  FROM fx_hits) WHERE rn = 1)
"""
TIE = ("l_linenumber", "l_partkey", "l_suppkey")


@query("win10_best_motif_hit", BEST + "SELECT * FROM best", ("fx_hits",))
def _(t):
    return motifs.best_hit(t.fx("fx_hits"), ["peak"], TIE)


@query("win11_orient_peaks", BEST + """
, pk AS (SELECT o_orderkey AS peak, o_orderpriority AS file,
   CASE WHEN o_orderpriority LIKE '1%' THEN CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END ELSE '.' END AS strand FROM orders)
, gate AS (SELECT file, min(CASE WHEN strand IN ('+', '-') THEN 1 ELSE 0 END) AS al FROM pk GROUP BY file)
SELECT pk.peak, pk.file, CASE WHEN al = 1 THEN pk.strand ELSE best.strand END AS strand, CASE WHEN al = 0 THEN best.p END AS motif_p,
  CASE WHEN CASE WHEN al = 1 THEN pk.strand ELSE best.strand END = '+' THEN 1 ELSE -1 END AS orientation
FROM pk JOIN gate ON gate.file = pk.file LEFT JOIN best ON best.peak = pk.peak WHERE al = 1 OR best.peak IS NOT NULL""", ("fx_hits",))
def _(t):
    return motifs.orient_peaks(
        _order_peaks(t), motifs.best_hit(t.fx("fx_hits"), ["peak"], TIE), ["peak"], ["file"]
    )


def _order_peaks(t):
    given = F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-")
    return t("orders").select(
        F.col("o_orderkey").alias("peak"), F.col("o_orderpriority").alias("file"),
        F.when(F.col("o_orderpriority").startswith("1"), given).otherwise(".").alias("strand"),
    )


@query("snk1_write_oriented_bed", PEAKS + """
SELECT concat_ws(chr(9), chrom, "start", "end", name, CAST(trunc(score) AS INTEGER), strand) AS value FROM pk
WHERE strand IN ('+', '-') AND score IS NOT NULL""")
def _(t):
    peaks = I.parse_peaks(bed_lines(t)).where(F.col("strand").isin("+", "-") & F.col("score").isNotNull())
    return bed.oriented_bed_lines(
        peaks.withColumn("orientation", F.when(F.col("strand") == "+", 1).otherwise(-1))
    )


@query("snk2_write_relative_bed", ORIENTED + f"""
, b AS (SELECT *, CAST(floor((floor(("start" + "end") / 2) - {WINDOW[1]}) / 1000) AS INTEGER) AS bin FROM ob)
SELECT concat_ws(chr(9), chrom, "start", "end", name, printf('%.2f', score), strand, bin, CASE WHEN strand = '+' THEN '+1' ELSE '-1' END) AS value
FROM b WHERE bin >= 0 AND bin < {N}""")
def _(t):
    return bed.relative_bed_lines(I.parse_oriented(bed_lines(t), WINDOW), WINDOW[1], 1000, N)


@query("snk3_write_conserved_bed", """
, cons AS (SELECT DISTINCT locus * 50 + bin AS bin, ori FROM fx_sites GROUP BY locus, bin, ori HAVING count(DISTINCT ctcf_type) = 3)
, nb AS (SELECT *, row_number() OVER (ORDER BY bin, ori) - 1 AS k FROM cons)
SELECT bin, ori, concat_ws(chr(9), 'chr1', 1000 + bin * 1000 + 500, 1000 + bin * 1000 + 501, printf('CTCF_cons_%04d', k), 600,
  CASE WHEN ori = 1 THEN '+' ELSE '-' END) AS value FROM nb""", ("fx_sites",))
def _(t):
    kept = sites.conserved_sites(t.fx("fx_sites"), ["locus"], ["T0", "T1", "T2"])
    wide = kept.select((F.col("locus") * 50 + F.col("bin")).alias("bin"), "ori").distinct()
    return bed.conserved_bed_lines(wide, "chr1", 1000, 1000)


@query("snk8_write_summit_bed", PEAKS + f"""
SELECT concat_ws(chr(9), chrom, summit, summit + 1, name, CAST(trunc(score) AS INTEGER), CASE WHEN strand = '-' THEN '-' ELSE '+' END) AS value
FROM pk WHERE chrom = '{WINDOW[0]}' AND summit BETWEEN {WINDOW[1]} AND {WINDOW[2]} AND score IS NOT NULL""")
def _(t):
    peaks = I.parse_peaks(bed_lines(t)).where(F.col("score").isNotNull())
    return bed.summit_bed_lines(
        peaks.withColumn("orientation", F.when(F.col("strand") == "-", -1).otherwise(1)), *WINDOW
    )


@query("snk4_write_curve_tables", PS + f"""
SELECT cond AS curve, CAST(d * {RES} AS VARCHAR) AS s_bp, format('{{:.6g}}', p) AS ps FROM ps""", ("fx_maps",))
def _(t):
    c = curve(t).select("cond", (F.col("d") * RES).alias("s_bp"), F.col("p").alias("ps"))
    return out_tables.curve_lines(c, "cond", "s_bp", "ps", whole_x=True)


@query("prj7_parse_region", """
SELECT o_orderkey, 'chr' || (o_custkey % 4 + 1) AS chrom, CAST(o_orderkey * 1000 AS BIGINT) AS "start", CAST(o_orderkey * 1000 + 1234567 AS BIGINT) AS "end" FROM orders""")
def _(t):
    from chromloom.functions.coords import parse_region

    k = F.col("o_orderkey") * 1000
    text = F.concat(
        F.lit("chr"), F.col("o_custkey") % 4 + 1, F.lit(":"), F.format_number(k, 0), F.lit("-"),
        F.format_number(k + 1234567, 0),
    )
    return t("orders").select("o_orderkey", parse_region(text).alias("r")).select("o_orderkey", "r.*")


