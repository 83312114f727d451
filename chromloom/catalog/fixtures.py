"""Views that restate the given tables as chromatin data, in Spark and as SQL text.

Each view uses its source tables whole. Sums run over whole numbers so that any order of
addition gives the same result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chromloom.functions.skew import row_numbers

N_BINS = 60
RES = 1000
CHAIN = 200
RADIUS = 0.2
N_BEADS = 21
PARTS_PER_LOCUS = 150


def _pixels(t):
    a, b = F.col("l_partkey") % N_BINS, F.col("l_orderkey") % N_BINS
    return (
        t("lineitem")
        .select(
            F.col("l_returnflag").alias("cond"),
            (F.col("l_suppkey") % 3).alias("rep"),
            F.least(a, b).cast("int").alias("i"),
            F.greatest(a, b).cast("int").alias("j"),
            "l_quantity",
        )
        .where("i <> j")
        .groupBy("cond", "rep", "i", "j")
        .agg(F.sum("l_quantity").alias("v"))
    )


def _maps(t):
    """Pixels pooled over replicates, one map per condition."""
    return _pixels(t).groupBy("cond", "i", "j").agg(F.sum("v").alias("v"))


def _bins(t):
    return (
        t("part")
        .groupBy((F.col("p_partkey") % N_BINS).cast("int").alias("bin"))
        .agg(
            (F.sum("p_size") / F.count(F.lit(1)) / 25.0).alias("weight"),
            (
                F.sum(F.round(F.col("p_retailprice") * 100).cast("long"))
                / F.count(F.lit(1)) / 100000.0
            ).alias("kr"),
        )
    )


def positions():
    """21 bead positions from 63 elements of the vector, all moved by its last element."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(N_BEADS - 1)),
        lambda b: F.struct(
            *[
                (F.get(F.col("embedding"), b * 3 + k).cast("double") + F.get(F.col("embedding"), F.lit(3 * N_BEADS)).cast("double")).alias(axis)
                for k, axis in enumerate("xyz")
            ]
        ),
    )


def _frames(t):
    """One row per (chain, frame): an array of 21 bead positions."""
    numbered = row_numbers(
        t("embeddings").select("vec_id", F.col("label").alias("chain"), "embedding"),
        ["chain"], ["vec_id"], F.floor(F.col("vec_id") / 4096),
    )
    return numbered.select("chain", (F.col("rn") - 1).cast("int").alias("frame"), positions().alias("pos"))


def _beads(t):
    return _frames(t).select(
        "chain", "frame", F.posexplode("pos").alias("bead", "p")
    ).select("chain", "frame", "bead", "p.x", "p.y", "p.z")


def _pair(t):
    d = [(F.col("pos")[10][a] - F.col("pos")[0][a]).alias(f"d{a}") for a in "xyz"]
    return (
        _frames(t)
        .select("chain", "frame", *d)
        .withColumn("dist", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
                                   + F.col("dz") * F.col("dz")))
    )


def _trace(t):
    numbered = row_numbers(
        t("events").select("user_id", "ts", "event_id", "value"),
        ["user_id"], ["ts", "event_id"], F.unix_date(F.col("ts").cast("date")) * 24 + F.hour("ts"),
    )
    return numbered.select(
        F.col("user_id").alias("series"),
        (F.col("rn") - 1).cast("int").alias("t"),
        "value",
        (F.col("value") < 50).alias("hit"),
    )


def _sites(t):
    return (
        t("part")
        .select(
            F.concat(F.lit("T"), F.col("p_partkey") % 3).alias("ctcf_type"),
            F.floor(F.col("p_partkey") / PARTS_PER_LOCUS).cast("int").alias("locus"),
            F.col("p_size").alias("bin"),
            F.when(F.floor(F.col("p_partkey") / 3) % 2 == 0, 1).otherwise(-1).alias("ori"),
            "p_retailprice",
        )
        .groupBy("ctcf_type", "locus", "bin", "ori")
        .agg(F.max("p_retailprice").alias("signal"))
    )


def _peaks(t):
    start = F.floor("o_totalprice").cast("int")
    return t("orders").select(
        F.col("o_orderstatus").alias("sample"),
        F.concat(F.lit("chr"), F.col("o_custkey") % 4 + 1).alias("chrom"),
        start.alias("start"),
        (start + 500 + F.col("o_orderkey") % 1000).cast("int").alias("end"),
        (F.col("o_orderkey") % 500).cast("int").alias("off"),
        F.concat(F.lit("p"), F.col("o_orderkey")).alias("name"),
        F.col("o_totalprice").alias("signal"),
    )


def _loci(t):
    start = (F.col("r_regionkey") * 50000).cast("int")
    return t("region").select(
        F.col("r_name").alias("name"),
        F.concat(F.lit("chr"), F.col("r_regionkey") % 4 + 1).alias("chrom"),
        start.alias("region_start"),
        (start + 100000).cast("int").alias("region_end"),
    )


def _hits(t):
    return t("lineitem").select(
        F.col("l_orderkey").alias("peak"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
        F.round(F.col("l_tax") + 0.001, 3).alias("p"),
        "l_linenumber", "l_partkey", "l_suppkey",
    )


def _legs(t):
    a, b = F.col("l_partkey") % CHAIN, F.col("l_orderkey") % CHAIN
    return t("lineitem").select(
        (F.col("l_orderkey") % 50).cast("int").alias("snap"),
        F.least(a, b).cast("int").alias("l"),
        F.greatest(a, b).cast("int").alias("r"),
    ).where("l <> r")


def _metrics(t):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return (
        t("orders")
        .groupBy(
            F.col("o_orderpriority").alias("cond"),
            (F.col("o_orderkey") % 4).cast("int").alias("rep"),
            F.col("o_orderstatus").alias("metric"),
        )
        .agg((F.sum(cents) / F.count(F.lit(1)) / 10000000.0).alias("value"))
    )


def _genes(t):
    start = F.col("p_partkey") * 10
    return t("part").select(
        F.col("p_name").alias("symbol"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        start.alias("tx_start"),
        (start + F.col("p_size") * 100).alias("tx_end"),
    )


def _samples(t):
    """Sample rows with metadata columns, one value shared by all rows."""
    return t("nation").join(
        t("region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        F.lit("FOLD").alias("project"),
        F.col("r_name").alias("cell_type"),
        F.col("n_name").alias("condition"),
        F.when(F.col("n_nationkey") % 5 == 0, " NA ")
        .when(F.col("n_nationkey") % 5 == 1, "none")
        .otherwise(F.concat(F.lit("peaks/"), F.col("n_name"), F.lit(".bed"))).alias("peaks"),
        F.when(F.col("n_nationkey") % 2 == 0, ".")
        .otherwise(F.concat(F.lit("hic/"), F.col("n_name"), F.lit(".cool"))).alias("hic"),
    )


VIEWS = {
    "fx_pixels": _pixels, "fx_maps": _maps, "fx_bins": _bins, "fx_frames": _frames,
    "fx_beads": _beads, "fx_pair": _pair, "fx_trace": _trace, "fx_sites": _sites,
    "fx_peaks": _peaks, "fx_loci": _loci, "fx_hits": _hits, "fx_legs": _legs,
    "fx_metrics": _metrics, "fx_genes": _genes, "fx_samples": _samples,
}

SQL = {
    "fx_pixels": f"""
        SELECT l_returnflag AS cond, l_suppkey % 3 AS rep,
               CAST(least(l_partkey % {N_BINS}, l_orderkey % {N_BINS}) AS INTEGER) AS i,
               CAST(greatest(l_partkey % {N_BINS}, l_orderkey % {N_BINS}) AS INTEGER) AS j,
               sum(l_quantity) AS v
        FROM lineitem WHERE l_partkey % {N_BINS} <> l_orderkey % {N_BINS}
        GROUP BY ALL""",
    "fx_maps": "SELECT cond, i, j, sum(v) AS v FROM fx_pixels GROUP BY ALL",
    "fx_bins": f"""
        SELECT CAST(p_partkey % {N_BINS} AS INTEGER) AS bin,
               sum(p_size) / count(*) / 25.0 AS weight,
               sum(CAST(round(p_retailprice * 100) AS BIGINT)) / count(*) / 100000.0 AS kr
        FROM part GROUP BY ALL""",
    "fx_beads": f"""
        SELECT chain, frame, bead,
               CAST(embedding[3 * bead + 1] AS DOUBLE) + CAST(embedding[{3 * N_BEADS + 1}] AS DOUBLE) AS x,
               CAST(embedding[3 * bead + 2] AS DOUBLE) + CAST(embedding[{3 * N_BEADS + 1}] AS DOUBLE) AS y,
               CAST(embedding[3 * bead + 3] AS DOUBLE) + CAST(embedding[{3 * N_BEADS + 1}] AS DOUBLE) AS z
        FROM (SELECT label AS chain, embedding,
                     CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame
              FROM embeddings),
             (SELECT CAST(range AS INTEGER) AS bead FROM range({N_BEADS}))""",
    "fx_pair": """
        SELECT b.chain, b.frame, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz,
               sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)
                    + (b.z - a.z) * (b.z - a.z)) AS dist
        FROM fx_beads a JOIN fx_beads b ON a.chain = b.chain AND a.frame = b.frame
        WHERE a.bead = 0 AND b.bead = 10""",
    "fx_trace": """
        SELECT user_id AS series,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t,
               value, value < 50 AS hit FROM events""",
    "fx_sites": f"""
        SELECT 'T' || (p_partkey % 3) AS ctcf_type,
               CAST(floor(p_partkey / {PARTS_PER_LOCUS}) AS INTEGER) AS locus, p_size AS bin,
               CASE WHEN floor(p_partkey / 3) % 2 = 0 THEN 1 ELSE -1 END AS ori,
               max(p_retailprice) AS signal
        FROM part GROUP BY ALL""",
    "fx_peaks": """
        SELECT o_orderstatus AS sample, 'chr' || (o_custkey % 4 + 1) AS chrom,
               CAST(floor(o_totalprice) AS INTEGER) AS "start",
               CAST(floor(o_totalprice) + 500 + o_orderkey % 1000 AS INTEGER) AS "end",
               CAST(o_orderkey % 500 AS INTEGER) AS off, 'p' || o_orderkey AS name,
               o_totalprice AS signal
        FROM orders""",
    "fx_loci": """
        SELECT r_name AS name, 'chr' || (r_regionkey % 4 + 1) AS chrom,
               CAST(r_regionkey * 50000 AS INTEGER) AS region_start,
               CAST(r_regionkey * 50000 + 100000 AS INTEGER) AS region_end
        FROM region""",
    "fx_hits": """
        SELECT l_orderkey AS peak, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
               round(l_tax + 0.001, 3) AS p, l_linenumber, l_partkey, l_suppkey
        FROM lineitem""",
    "fx_legs": f"""
        SELECT CAST(l_orderkey % 50 AS INTEGER) AS snap,
               CAST(least(l_partkey % {CHAIN}, l_orderkey % {CHAIN}) AS INTEGER) AS l,
               CAST(greatest(l_partkey % {CHAIN}, l_orderkey % {CHAIN}) AS INTEGER) AS r
        FROM lineitem WHERE l_partkey % {CHAIN} <> l_orderkey % {CHAIN}""",
    "fx_metrics": """
        SELECT o_orderpriority AS cond, CAST(o_orderkey % 4 AS INTEGER) AS rep,
               o_orderstatus AS metric,
               sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 10000000.0 AS value
        FROM orders GROUP BY ALL""",
    "fx_genes": """
        SELECT p_name AS symbol, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
               p_partkey * 10 AS tx_start, p_partkey * 10 + p_size * 100 AS tx_end
        FROM part""",
    "fx_samples": """
        SELECT 'FOLD' AS project, r_name AS cell_type, n_name AS condition,
               CASE WHEN n_nationkey % 5 = 0 THEN ' NA ' WHEN n_nationkey % 5 = 1 THEN 'none'
                    ELSE 'peaks/' || n_name || '.bed' END AS peaks,
               CASE WHEN n_nationkey % 2 = 0 THEN '.' ELSE 'hic/' || n_name || '.cool' END AS hic
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
}

NEEDS = {"fx_maps": ("fx_pixels",), "fx_pair": ("fx_beads",)}


def with_clause(names: tuple[str, ...]) -> str:
    """The WITH clause that defines the named views and the views they build on."""
    order: list[str] = []
    for name in names:
        for dep in (*NEEDS.get(name, ()), name):
            if dep not in order:
                order.append(dep)
    if not order:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
