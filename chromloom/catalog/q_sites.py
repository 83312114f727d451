"""Site queries: pairs, conserved sites, ranks, factors, probe pairs, coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromloom.catalog.registry import ORACLES, query
from chromloom.functions import coords as G
from chromloom.functions.numeric import round6
from chromloom.operators import sites as S

FX = ("fx_sites",)
KEYS = ["ctcf_type", "locus"]
TYPES = ["T0", "T1", "T2"]


def pairs_sql(top: str) -> str:
    return f"""
SELECT a.ctcf_type, a.locus, a.bin AS anchor1, b.bin AS anchor2, CAST(b.bin - a.bin AS INTEGER) AS size_bins
FROM fx_sites a JOIN fx_sites b ON a.ctcf_type = b.ctcf_type AND a.locus = b.locus
WHERE a.ori = 1 AND b.ori = -1 AND b.bin > a.bin AND b.bin - a.bin >= 5 AND b.bin - a.bin {top}"""


@query("jn2_convergent_pairs", pairs_sql("< 40"), FX)
def _(t):
    return S.convergent_pairs(t.fx("fx_sites"), KEYS, 5, 40)


@query("jn3_convergent_pairs_closed", pairs_sql("<= 40"), FX)
def _(t):
    return S.convergent_pairs(t.fx("fx_sites"), KEYS, 5, 40, closed=True)


@query("jn4_adjacent_convergent", """
, n AS (SELECT *, lead(ori) OVER (PARTITION BY ctcf_type, locus ORDER BY bin, ori) AS nx FROM fx_sites)
SELECT ctcf_type, locus, count(*) FILTER (ori = 1 AND nx = -1) AS convergent FROM n GROUP BY ALL""", FX)
def _(t):
    return S.adjacent_convergent(t.fx("fx_sites"), KEYS)


CONS = """
SELECT locus, bin, ori FROM fx_sites GROUP BY ALL HAVING count(DISTINCT ctcf_type) = 3"""


@query("jn5_conserved_sites", CONS, FX)
def _(t):
    return S.conserved_sites(t.fx("fx_sites"), ["locus"], TYPES)


@query("set2_intersect_sites", """
SELECT locus, bin, ori FROM fx_sites WHERE ctcf_type = 'T0' INTERSECT
SELECT locus, bin, ori FROM fx_sites WHERE ctcf_type = 'T1' INTERSECT
SELECT locus, bin, ori FROM fx_sites WHERE ctcf_type = 'T2'""", FX)
def _(t):
    sites = t.fx("fx_sites")
    one = [sites.where(F.col("ctcf_type") == k).select("locus", "bin", "ori") for k in TYPES]
    return one[0].intersect(one[1]).intersect(one[2])


@query("jn5_conserved_sites_tolerance", """
SELECT a.locus, a.bin, a.ori FROM fx_sites a WHERE a.ctcf_type = 'T0'
AND EXISTS (SELECT 1 FROM fx_sites b WHERE b.ctcf_type = 'T1' AND b.locus = a.locus AND b.ori = a.ori AND abs(b.bin - a.bin) <= 2)
AND EXISTS (SELECT 1 FROM fx_sites b WHERE b.ctcf_type = 'T2' AND b.locus = a.locus AND b.ori = a.ori AND abs(b.bin - a.bin) <= 2)""", FX)
def _(t):
    return S.conserved_sites(t.fx("fx_sites"), ["locus"], TYPES, tol=2)


TYPE_PAIRS = """
, tp(pair, a, b) AS (VALUES ('T0/T1', 'T0', 'T1'), ('T0/T2', 'T0', 'T2'), ('T1/T2', 'T1', 'T2'))
, sa AS (SELECT pair, locus, bin, ori FROM fx_sites JOIN tp ON ctcf_type = a), sb AS (SELECT pair, locus, bin, ori FROM fx_sites JOIN tp ON ctcf_type = b)
"""


def type_pairs(t):
    """Sites of the first and of the second type of every pair of types, told apart by ``pair``."""
    sites, pairs = t.fx("fx_sites"), [(a, b) for k, a in enumerate(TYPES) for b in TYPES[k + 1:]]
    out = []
    for side in (0, 1):
        names = F.array(*[F.struct(F.lit(f"{p[0]}/{p[1]}").alias("pair"), F.lit(p[side]).alias("of")) for p in pairs])
        every = sites.withColumn("p", F.explode(F.filter(names, lambda p: p["of"] == F.col("ctcf_type"))))
        out.append(every.select("p.pair", "locus", "bin", "ori"))
    return out


@query("jn6_shared_or_specific", TYPE_PAIRS + """
, x AS (SELECT pair, locus, 'a' AS side, EXISTS (SELECT 1 FROM sb WHERE sb.pair = sa.pair AND sb.locus = sa.locus AND abs(sb.bin - sa.bin) <= 2) AS near FROM sa
  UNION ALL SELECT pair, locus, 'b', EXISTS (SELECT 1 FROM sa WHERE sb.pair = sa.pair AND sb.locus = sa.locus AND abs(sb.bin - sa.bin) <= 2) FROM sb)
SELECT pair, locus, count(*) FILTER (side = 'a' AND near) AS shared, count(*) FILTER (side = 'a' AND NOT near) AS a_only,
  count(*) FILTER (side = 'b' AND NOT near) AS b_only FROM x GROUP BY ALL""", FX)
def _(t):
    return S.shared_or_specific(*type_pairs(t), ["pair", "locus"], 2)


@query("set3_specific_sites", TYPE_PAIRS + """
SELECT DISTINCT pair, locus, bin FROM sa WHERE NOT EXISTS (
  SELECT 1 FROM sb WHERE sb.pair = sa.pair AND sb.locus = sa.locus AND sb.bin = sa.bin)""", FX)
def _(t):
    a, b = type_pairs(t)
    return a.join(b, ["pair", "locus", "bin"], "left_anti").select("pair", "locus", "bin").distinct()


@query("jn7_site_signal", """
, pk AS (SELECT o_orderstatus AS sample, 'p' || (o_orderkey % 4000) AS name, o_totalprice AS signal, o_orderkey AS line FROM orders)
, bn AS (SELECT sample, name, arg_max(signal, line) AS signal FROM pk GROUP BY ALL)
, st AS (SELECT l_orderkey AS id, l_linenumber AS k, CASE WHEN l_suppkey % 5 = 0 THEN 'zz' ELSE 'p' || (l_orderkey % 4000) END AS name,
   CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'X' END AS sample FROM lineitem)
, jn AS (SELECT st.*, bn.signal AS s FROM st LEFT JOIN bn ON bn.sample = st.sample AND bn.name = st.name)
SELECT id, k, name, sample, round(coalesce(s, (SELECT median(s) FROM jn j WHERE j.sample = jn.sample), 1.0), 6) AS signal FROM jn""".replace(", pk AS", "WITH pk AS", 1))
def _(t):
    peaks = t("orders").select(
        F.col("o_orderstatus").alias("sample"),
        F.concat(F.lit("p"), F.col("o_orderkey") % 4000).alias("name"),
        F.col("o_totalprice").alias("signal"), F.col("o_orderkey").alias("line"),
    )
    sites = t("lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"),
        F.when(F.col("l_suppkey") % 5 == 0, "zz")
        .otherwise(F.concat(F.lit("p"), F.col("l_orderkey") % 4000)).alias("name"),
        F.when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "N", "O")
        .otherwise("X").alias("sample"),
    )
    out = S.site_signal(sites, peaks, ["sample"])
    return out.withColumn("signal", round6(F.col("signal")))


BEDPE = """
WITH lp AS (SELECT o_orderkey AS loop_id, 'chr' || (o_custkey % 4 + 1) AS chrom, CAST(floor(o_totalprice) AS INTEGER) AS s,
   o_orderstatus AS cls FROM orders)
, st AS (SELECT 'chr' || (l_partkey % 4 + 1) AS chrom, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
   CAST(trunc(l_extendedprice) * 4 AS INTEGER) AS s, l_linestatus AS st FROM lineitem)
, calls AS (SELECT loop_id, cls, EXISTS (SELECT 1 FROM st WHERE st.chrom = lp.chrom AND strand = '+' AND st.st = 'O' AND st.s + 20 > lp.s AND st.s < lp.s + 100)
   AND EXISTS (SELECT 1 FROM st WHERE st.chrom = lp.chrom AND strand = '-' AND st.st = 'O' AND st.s + 20 > lp.s + 2000 AND st.s < lp.s + 2100) AS in_a,
   EXISTS (SELECT 1 FROM st WHERE st.chrom = lp.chrom AND strand = '+' AND st.st = 'F' AND st.s + 20 > lp.s AND st.s < lp.s + 100)
   AND EXISTS (SELECT 1 FROM st WHERE st.chrom = lp.chrom AND strand = '-' AND st.st = 'F' AND st.s + 20 > lp.s + 2000 AND st.s < lp.s + 2100) AS in_b FROM lp)
"""


def anchor_loops(t):
    s = F.floor("o_totalprice").cast("int")
    return t("orders").select(
        F.col("o_orderkey").alias("loop_id"), F.concat(F.lit("chr"), F.col("o_custkey") % 4 + 1).alias("chrom"),
        s.alias("a_start"), (s + 100).alias("a_end"), (s + 2000).alias("b_start"), (s + 2100).alias("b_end"),
        F.col("o_orderstatus").alias("cls"),
    )


def stranded(t, status):
    s = (F.col("l_extendedprice").cast("int") * 4).cast("int")
    return t("lineitem").where(F.col("l_linestatus") == status).select(
        F.concat(F.lit("chr"), F.col("l_partkey") % 4 + 1).alias("chrom"), s.alias("start"), (s + 20).alias("end"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
    ).distinct()


def calls(t):
    loops = anchor_loops(t)
    a = S.anchor_overlap(loops, stranded(t, "O"), 2_000).select("loop_id", "cls", F.col("convergent").alias("in_a"))
    b = S.anchor_overlap(loops, stranded(t, "F"), 2_000).select("loop_id", F.col("convergent").alias("in_b"))
    return a.join(b, "loop_id")


@query("jn8_anchor_overlap", BEDPE + "SELECT loop_id, in_a AS convergent FROM calls")
def _(t):
    return S.anchor_overlap(anchor_loops(t), stranded(t, "O"), 2_000).select("loop_id", "convergent")


@query("ag77_loop_site_change", BEDPE + """
, ch AS (SELECT cls, CASE WHEN in_a AND in_b THEN 'kept' WHEN in_a THEN 'lost' WHEN in_b THEN 'gained' ELSE 'none' END AS change FROM calls)
SELECT cls, change, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cls), 6) AS share FROM ch GROUP BY cls, change""")
def _(t):
    s = S.change_share(S.loop_site_change(calls(t)), ["cls"])
    return s.withColumn("share", round6(F.col("share")))


RANK = """
, rk AS (SELECT *, (rank() OVER w - 1 + (count(*) OVER (PARTITION BY ctcf_type, signal) - 1) / 2.0) AS r,
   count(*) OVER (PARTITION BY ctcf_type) AS n FROM fx_sites WINDOW w AS (PARTITION BY ctcf_type ORDER BY signal))
, cap AS (SELECT ctcf_type, locus, bin, ori, signal, 0.2 + 0.6 * r / (n - 1) AS p FROM rk)
"""


def captured(t):
    return S.rank_capture(t.fx("fx_sites"), ["ctcf_type"], "signal", 0.2, 0.8)


@query("win1_rank_capture", RANK + """
SELECT ctcf_type, locus, bin, ori, signal, round(p, 6) AS p FROM cap""", FX)
def _(t):
    return captured(t).withColumn("p", round6(F.col("p")))


@query("ag65_stall_map", RANK + """
SELECT ctcf_type, locus, bin, CASE WHEN ori = 1 THEN 'left' ELSE 'right' END AS side, round(max(p), 6) AS p FROM cap GROUP BY ALL""", FX)
def _(t):
    return S.stall_map(captured(t), KEYS).withColumn("p", round6(F.col("p")))


FACTORS = """
, fb AS (SELECT locus, bin, list_sort(list(DISTINCT ctcf_type)) AS factors FROM fx_sites GROUP BY ALL)
, ty AS (SELECT factors, dense_rank() OVER (ORDER BY factors) AS type_id FROM (SELECT DISTINCT factors FROM fb))
"""


def bound(t):
    return t.fx("fx_sites").select(F.col("locus"), "bin", F.col("ctcf_type").alias("factor"))


def typed(t):
    wide = bound(t).select((F.col("locus") * 1000 + F.col("bin")).alias("bin"), "factor")
    return S.factor_types(wide, [])


@query("ag67_factor_types", FACTORS + """
SELECT locus * 1000 + bin AS bin, CAST(type_id AS INTEGER) AS type_id, array_to_string(fb.factors, '+') AS label
FROM fb JOIN ty ON ty.factors = fb.factors""", FX)
def _(t):
    return typed(t).select("bin", "type_id", "label")


@query("ag68_interaction_matrix", FACTORS + """
, en AS (SELECT * FROM (VALUES ('T0', 'T0', 2.0), ('T1', 'T1', 3.0), ('T0', 'T2', 1.0)) v(a, b, e))
, sy AS (SELECT a, b, e FROM en UNION SELECT b, a, e FROM en)
, al AS (SELECT 0 AS type_id, CAST([] AS VARCHAR[]) AS factors UNION ALL SELECT type_id, factors FROM ty)
SELECT CAST(x.type_id AS INTEGER) AS type_a, CAST(y.type_id AS INTEGER) AS type_b,
  CAST(coalesce(max(e) FILTER (list_contains(x.factors, a) AND list_contains(y.factors, b)), 0) AS DOUBLE) AS energy
FROM al x CROSS JOIN al y CROSS JOIN sy GROUP BY ALL""", FX)
def _(t):
    energies = t.spark.createDataFrame(
        [("T0", "T0", 2.0), ("T1", "T1", 3.0), ("T0", "T2", 1.0)],
        "factor_a string, factor_b string, energy double",
    )
    return S.interaction_matrix(typed(t), energies, [])


@query("ag69_gene_longest_transcript", """
SELECT symbol, strand, tx_start, tx_end FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY tx_end - tx_start DESC, tx_start) AS rn FROM fx_genes) WHERE rn = 1""",
       ("fx_genes",))
def _(t):
    return S.longest_transcript(t.fx("fx_genes"))


CAND = """
, cs AS (SELECT locus, bin, ori FROM fx_sites GROUP BY ALL HAVING count(DISTINCT ctcf_type) >= 2)
, cd AS (SELECT a.locus, a.bin AS l, b.bin AS r, CASE WHEN a.bin < 25 AND b.bin > 25 THEN 0 ELSE 1 END AS tier, abs((a.bin + b.bin) / 2.0 - 25) AS o
  FROM cs a JOIN cs b ON a.locus = b.locus WHERE a.ori = 1 AND b.ori = -1 AND b.bin - a.bin BETWEEN 5 AND 45)
"""


def candidates(t):
    shared = t.fx("fx_sites").select("locus", "bin", "ori", "ctcf_type").groupBy("locus", "bin", "ori").agg(
        F.count(F.lit(1)).alias("n")
    ).where("n >= 2").drop("n")
    return S.rank_probe_pairs(shared, ["locus"], 25, 5, 45)


@query("srt2_ranked_pairs", CAND + """
SELECT locus, l AS "left", r AS "right", tier, CAST(o AS DOUBLE) AS "offset" FROM cd""", FX)
def _(t):
    return candidates(t)


@query("win12_auto_probe_pairs", CAND + """
, r1 AS (SELECT locus, l, r FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY tier, o, l, r) AS k FROM cd) WHERE k = 1)
, c2 AS (SELECT cd.* FROM cd JOIN r1 ON r1.locus = cd.locus WHERE cd.l NOT IN (r1.l, r1.r) AND cd.r NOT IN (r1.l, r1.r))
, r2 AS (SELECT locus, l, r FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY tier, o, l, r) AS k FROM c2) WHERE k = 1)
, lf AS (SELECT locus, l, r FROM (SELECT cd.*, row_number() OVER (PARTITION BY cd.locus ORDER BY tier, o, cd.l, cd.r) AS k FROM cd JOIN r1 ON r1.locus = cd.locus
    WHERE NOT (cd.l = r1.l AND cd.r = r1.r) AND cd.locus NOT IN (SELECT locus FROM r2)) WHERE k = 1)
SELECT locus, 1 AS place, l AS "left", r AS "right" FROM r1 UNION ALL SELECT locus, 2, l, r FROM r2 UNION ALL SELECT locus, 2, l, r FROM lf""", FX)
def _(t):
    return S.auto_probe_pairs(candidates(t), ["locus"], 2).select("locus", "place", "left", "right")


@query("win12_four_pairs", CAND + """
, so AS (SELECT locus, l, r, row_number() OVER (PARTITION BY locus ORDER BY tier, o, l, r) AS k FROM cd)
, pk AS (SELECT locus, l, r, k, [l, r] AS used, 1 AS place FROM so WHERE k = 1
  UNION ALL SELECT locus, l, r, k, used, place FROM (SELECT so.locus, so.l, so.r, so.k, list_concat(pk.used, [so.l, so.r]) AS used, place + 1 AS place,
     row_number() OVER (PARTITION BY so.locus ORDER BY so.k) AS f FROM pk JOIN so ON so.locus = pk.locus AND so.k > pk.k AND place < 4
     AND NOT list_contains(pk.used, so.l) AND NOT list_contains(pk.used, so.r)) WHERE f = 1)
, hv AS (SELECT locus, max(place) AS n FROM pk GROUP BY locus)
, fl AS (SELECT so.locus, l, r, n + row_number() OVER (PARTITION BY so.locus ORDER BY k) AS place FROM so JOIN hv ON hv.locus = so.locus
  WHERE NOT EXISTS (SELECT 1 FROM pk WHERE pk.locus = so.locus AND pk.k = so.k))
SELECT locus, CAST(place AS INTEGER) AS place, l AS "left", r AS "right" FROM pk
UNION ALL SELECT locus, CAST(place AS INTEGER), l, r FROM fl WHERE place <= 4""", FX)
def _(t):
    return S.auto_probe_pairs(candidates(t), ["locus"], 4).select("locus", "place", "left", "right")


ORACLES["win12_four_pairs"] = ORACLES["win12_four_pairs"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("win13_probe_pairs", CAND + """
, ex AS (SELECT DISTINCT locus, 1 AS l, 40 AS r FROM fx_sites WHERE locus % 3 = 0)
, r1 AS (SELECT locus, l, r FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY tier, o, l, r) AS k FROM cd) WHERE k = 1)
SELECT locus, l AS "left", r AS "right", '1-40' AS label FROM ex
UNION ALL SELECT locus, l, r, 'auto:' || l || '-' || r FROM r1 WHERE locus NOT IN (SELECT locus FROM ex)""", FX)
def _(t):
    explicit = t.fx("fx_sites").where("locus % 3 = 0").select(
        "locus", F.lit(1).alias("left"), F.lit(40).alias("right"), F.lit(None).cast("string").alias("label")
    ).distinct()
    return S.probe_pairs(explicit, S.auto_probe_pairs(candidates(t), ["locus"], 1), ["locus"])


@query("ag59_near_anchor_counts", """
SELECT ctcf_type, locus, count(*) FILTER (bin >= 20 AND bin < 30) AS near_50kb, count(*) FILTER (bin >= 15 AND bin < 35) AS near_100kb
FROM fx_sites GROUP BY ALL""", FX)
def _(t):
    return S.near_anchor_counts(t.fx("fx_sites"), KEYS, 25, {"near_50kb": 5, "near_100kb": 10})


@query("ag74_blocker_counts", """
SELECT ctcf_type, locus, count(DISTINCT bin) FILTER (ori = 1) AS left_blockers, count(DISTINCT bin) FILTER (ori = -1) AS right_blockers,
  count(DISTINCT bin) AS occupied FROM fx_sites GROUP BY ALL""", FX)
def _(t):
    return S.blocker_counts(t.fx("fx_sites"), KEYS)


@query("ag74_loader_crosscheck", TYPE_PAIRS + """
SELECT *, 'a' AS only_in FROM (SELECT * FROM sa EXCEPT ALL SELECT * FROM sb) UNION ALL
SELECT *, 'b' FROM (SELECT * FROM sb EXCEPT ALL SELECT * FROM sa)""", FX)
def _(t):
    return S.same_sites(*type_pairs(t), ["pair", "locus", "bin", "ori"])


@query("srt1_sites_in_order", """
SELECT ctcf_type, locus, bin, ori, row_number() OVER (PARTITION BY ctcf_type, locus ORDER BY bin, ori) AS place FROM fx_sites""", FX)
def _(t):
    from chromloom.functions.skew import row_numbers

    return row_numbers(
        t.fx("fx_sites").drop("signal"), KEYS, ["bin", "ori"], F.floor(F.col("bin") / 16), "place"
    )


PEAK_FX = ("fx_peaks",)


@query("prj1_bin_of_summit", """
SELECT name, CAST(floor(("start" + off - 100000) / 1000) AS INTEGER) AS bin FROM fx_peaks
WHERE floor(("start" + off - 100000) / 1000) BETWEEN 0 AND 99""", PEAK_FX)
def _(t):
    bin_ = G.bin_of(F.col("start") + F.col("off"), 100_000, 1000)
    return t.fx("fx_peaks").select("name", bin_.alias("bin")).where(G.in_bins(F.col("bin"), 100))


@query("prj2_bp_of_bin", """
SELECT ctcf_type, locus, bin, ori, CAST(100000 + bin * 1000 + 500 AS BIGINT) AS bp FROM fx_sites""", FX)
def _(t):
    return t.fx("fx_sites").select(
        "ctcf_type", "locus", "bin", "ori", G.bp_of(F.col("bin"), 100_000, 1000).alias("bp")
    )


@query("prj4_tile_positions", """
SELECT ctcf_type, locus, bin, ori, CAST(k * 100 + 10 + bin AS INTEGER) AS position FROM fx_sites, (SELECT unnest([0, 1, 2]) AS k)""", FX)
def _(t):
    return t.fx("fx_sites").select(
        "ctcf_type", "locus", "bin", "ori", F.explode(G.tile_positions(F.col("bin"), 100, 10, 3)).alias("position")
    )


@query("prj8_parse_run_name", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'x' || o_orderkey ELSE o_orderpriority || '_ctcf-T' END AS condition,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_custkey END AS INTEGER) AS replicate FROM orders""")
def _(t):
    return runs(t).select("o_orderkey", G.parse_run_name(F.col("run")).alias("r")).select("o_orderkey", "r.*")


def runs(t):
    full = F.concat(F.lit("merged_"), "o_orderpriority", F.lit("_ctcf-T_rep"), F.col("o_custkey"))
    plain = F.concat(F.lit("merged_x"), F.col("o_orderkey"))
    return t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, plain).otherwise(full).alias("run"))


@query("prj18_output_prefix", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'merged_x' || o_orderkey || '_' || o_orderkey || 'blk'
  ELSE o_orderpriority || '_ctcf-T_' || o_orderkey || 'blk_rep' || o_custkey END AS prefix FROM orders""")
def _(t):
    return runs(t).select("o_orderkey", G.output_prefix(F.col("run"), F.col("o_orderkey")).alias("prefix"))


@query("prj9_chrom_style", """
SELECT DISTINCT chrom, substr(chrom, 4) AS other, chrom AS back FROM fx_peaks""", PEAK_FX)
def _(t):
    one = t.fx("fx_peaks").select("chrom").distinct()
    return one.select(
        "chrom", G.other_chrom_style(F.col("chrom")).alias("other"),
        G.other_chrom_style(G.other_chrom_style(F.col("chrom"))).alias("back"),
    )


@query("prj11_tiling_of", """
SELECT name, 100 AS n_bins, 140 AS tile_size, 7 AS n_tiles, 980 AS chain_size, true AS fits FROM fx_loci""", ("fx_loci",))
def _(t):
    tl = G.tiling(F.col("region_start"), F.col("region_end"), 1000, 20, 1000)
    return t.fx("fx_loci").select("name", tl.alias("t")).select("name", "t.*")


@query("prj12_region_filter", """
SELECT sample, count(*) FILTER (chrom = 'chr1' AND "end" >= 100500 AND "start" <= 200000) AS closed,
  count(*) FILTER (chrom = 'chr1' AND "end" > 100500 AND "start" < 200000) AS half_open FROM fx_peaks GROUP BY sample""", PEAK_FX)
def _(t):
    here = F.col("chrom") == "chr1"

    def n(closed):
        return F.count(F.when(here & G.overlaps(F.col("start"), F.col("end"), 100_500, 200_000, closed), 1))

    return t.fx("fx_peaks").groupBy("sample").agg(n(True).alias("closed"), n(False).alias("half_open"))


@query("prj19_bin_centre", """
SELECT name, round((floor(("start" + "end") / 2) - 100000) / 10000, 6) AS center_bin FROM fx_peaks
WHERE chrom = 'chr1' AND "start" >= 100000 AND "end" <= 300000""", PEAK_FX)
def _(t):
    at = G.fractional_bin(F.col("start"), F.col("end"), 100_000, 10_000)
    return t.fx("fx_peaks").where("chrom = 'chr1' AND start >= 100000 AND end <= 300000").select(
        "name", round6(at).alias("center_bin")
    )


@query("prj20_window_for_loop", """
SELECT name, CAST(greatest(0, floor(("start" - greatest(250000, ("end" * 3 - "start") / 2)) / 10000) * 10000) AS BIGINT) AS "start",
  CAST(least(1990000, ceil(("end" * 3 + greatest(250000, ("end" * 3 - "start") / 2)) / 10000) * 10000) AS BIGINT) AS "end" FROM fx_peaks""", PEAK_FX)
def _(t):
    w = G.window_for_loop(F.col("start"), F.col("end") * 3, F.lit(1_999_000), 10_000)
    return t.fx("fx_peaks").select("name", w.alias("w")).select("name", "w.*")


@query("prj21_extrusion_scales", """
SELECT o_orderkey, CAST(o_custkey * 0.5 AS DOUBLE) AS processivity,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(70000 / (o_orderkey % 7 * 100.0)) AS BIGINT) END AS cohesins,
  CASE WHEN o_orderkey % 7 <> 0 THEN round(CAST(o_custkey / (o_orderkey % 7 * 100.0) AS DOUBLE), 6) END AS coverage FROM orders""")
def _(t):
    sep = F.nullif(F.col("o_orderkey") % 7 * 100, F.lit(0))
    e = G.extrusion_scales(F.col("o_custkey"), sep, F.lit(70_000), F.lit(0.5))
    return t("orders").select("o_orderkey", e.alias("e")).select(
        "o_orderkey", "e.processivity", "e.cohesins", round6(F.col("e.coverage")).alias("coverage")
    )
