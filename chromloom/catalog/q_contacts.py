"""Contact queries: the radius join, maps, pooling, shard merging, tiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromloom.catalog.fixtures import N_BEADS, RADIUS
from chromloom.catalog.registry import query
from chromloom.functions.numeric import round6
from chromloom.operators import contacts as K
from chromloom.sources import frames as S

CONDREP = """'c' || (chain % 2) AS cond, CAST(floor(chain / 2) AS INTEGER) AS rep"""

PAIRS = f"""
, pairs AS (
  SELECT a.chain, a.frame, a.bead AS i, b.bead AS j,
         (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2
  FROM fx_beads a JOIN fx_beads b
    ON a.chain = b.chain AND a.frame = b.frame AND a.bead < b.bead
  WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)
        <= {RADIUS} * {RADIUS})
"""
COUNTS = PAIRS + f"""
, fr AS (SELECT DISTINCT chain, frame FROM fx_beads)
, cnt AS (SELECT {CONDREP}, i, j, count(*) AS n FROM pairs GROUP BY ALL)
, sub AS (SELECT {CONDREP}, count(*) AS n_sub FROM fr GROUP BY ALL)
"""


def runs(t):
    """Frames labelled with a condition and a replicate taken from the chain."""
    return t.fx("fx_frames").select(
        F.concat(F.lit("c"), F.col("chain") % 2).alias("cond"),
        F.floor(F.col("chain") / 2).cast("int").alias("rep"), "frame", "pos",
    )


@query("jn1_contacts_within_radius", PAIRS + """
SELECT chain, frame, i, j, round(d2, 6) AS d2 FROM pairs""", ("fx_beads",))
def _(t):
    pairs = K.contacts_within_radius(t.fx("fx_beads"), ["chain", "frame"], RADIUS)
    return pairs.withColumn("d2", round6(F.col("d2")))


@query("ag1_contact_map", COUNTS + """
SELECT cond, rep, i, j, n, n_sub, round(n / n_sub, 6) AS v FROM cnt JOIN sub USING (cond, rep)""",
       ("fx_beads",))
def _(t):
    return K.contact_map(runs(t), ["cond", "rep"], N_BEADS, RADIUS).withColumn("v", round6(F.col("v")))


@query("ag1_contact_map_grid", COUNTS + "SELECT cond, rep, i, j, n FROM cnt", ("fx_beads",))
def _(t):
    return K.count_contacts(runs(t), ["cond", "rep"], N_BEADS, RADIUS, strategy="grid")


@query("ag2_pool_replicates", COUNTS + """
SELECT cond, i, j, CAST(sum(n) AS BIGINT) AS n, any_value(s.n_sub) AS n_sub, round(sum(n) / any_value(s.n_sub), 6) AS v
FROM cnt JOIN (SELECT cond, CAST(sum(n_sub) AS BIGINT) AS n_sub FROM sub GROUP BY cond) s USING (cond)
GROUP BY cond, i, j""", ("fx_beads",))
def _(t):
    frames = runs(t)
    counts = K.count_contacts(frames, ["cond", "rep"], N_BEADS, RADIUS)
    pooled = K.pool_replicates(counts, K.sub_regions(frames, ["cond", "rep"]), ["cond"])
    return pooled.withColumn("v", round6(F.col("v")))


@query("ag3_pool_lef_maps", """
, m AS (SELECT cond, count(DISTINCT rep) AS m FROM fx_pixels GROUP BY cond)
SELECT cond, i, j, round(sum(v) / any_value(m), 6) + 0.0 AS v FROM fx_pixels JOIN m USING (cond)
GROUP BY cond, i, j""", ("fx_pixels",))
def _(t):
    return K.mean_of_maps(t.fx("fx_pixels"), ["cond"], "rep").withColumn("v", round6(F.col("v")))


@query("ag5_merge_maps", "SELECT cond, i, j, sum(v) AS v FROM fx_pixels GROUP BY ALL", ("fx_pixels",))
def _(t):
    return K.merge_maps(t.fx("fx_pixels"), ["cond"])


@query("ag4_merge_shards", """
WITH e AS (SELECT user_id AS run, event_type AS shard, event_id AS frame FROM events)
SELECT run, shard, frame AS source_frame,
       row_number() OVER (PARTITION BY run ORDER BY shard, frame) - 1 AS frame,
       (SELECT count(DISTINCT shard) FROM e s WHERE s.run = e.run) AS n_shards
FROM e""")
def _(t):
    return K.merge_shards(_shards(t), ["run"])


@query("win14_frame_renumber", """
WITH e AS (SELECT user_id AS run, event_type AS shard, event_id AS frame FROM events)
SELECT run, max(frame) AS last, count(*) AS n FROM (
  SELECT run, row_number() OVER (PARTITION BY run ORDER BY shard, frame) - 1 AS frame FROM e)
GROUP BY run""")
def _(t):
    return K.merge_shards(_shards(t), ["run"]).groupBy("run").agg(
        F.max("frame").alias("last"), F.count(F.lit(1)).alias("n")
    )


def _shards(t):
    return t("events").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("shard"),
        F.col("event_id").alias("frame"), F.col("event_id").alias("source_frame"),
    )


TILED = (7, 1, 5)  # tile size, padding, locus bins: three copies on a 21-bead chain


@query("prj5_untile_beads", """
SELECT chain, frame, CAST(bead // 7 AS INTEGER) AS tile, CAST(bead % 7 - 1 AS INTEGER) AS bead,
       x, y, z FROM fx_beads WHERE bead % 7 BETWEEN 1 AND 5""", ("fx_beads",))
def _(t):
    return K.untile_beads(t.fx("fx_beads"), *TILED)


TILED_SQL = f"""
, u AS (SELECT chain, frame, bead // 7 AS tile, CAST(bead % 7 - 1 AS INTEGER) AS bead, x, y, z
        FROM fx_beads WHERE bead % 7 BETWEEN 1 AND 5)
SELECT a.chain, a.bead AS i, b.bead AS j, count(*) AS n
FROM u a JOIN u b ON a.chain = b.chain AND a.frame = b.frame AND a.tile = b.tile AND a.bead < b.bead
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)
      <= {RADIUS} * {RADIUS}
GROUP BY ALL"""


@query("ag1_tiled_contact_map", TILED_SQL, ("fx_beads",))
def _(t):
    return K.count_contacts(
        t.fx("fx_frames"), ["chain"], 5, RADIUS, tile_size=7, padding=1, n_tiles=3
    )


@query("prj6_select_beads", """
SELECT chain, frame, bead, x, y, z FROM fx_beads WHERE bead IN (0, 10)""", ("fx_beads",))
def _(t):
    return S.select_beads(t.fx("fx_frames"), ["chain", "frame"], [0, 10])


@query("src10_read_frames", """
SELECT 'c' || (chain % 2) AS cond, CAST(floor(chain / 2) AS INTEGER) AS rep, count(DISTINCT frame) AS n_frames,
       max(bead) + 1 AS n_beads FROM fx_beads GROUP BY ALL""", ("fx_beads",))
def _(t):
    return S.frame_index(S.conform(runs(t)), ["cond", "rep"])


@query("set5_chain_replicates", """
SELECT cond, row_number() OVER (PARTITION BY cond ORDER BY rep, frame) - 1 AS frame, rep
FROM (SELECT DISTINCT 'c' || (chain % 2) AS cond, CAST(floor(chain / 2) AS INTEGER) AS rep, frame
      FROM fx_beads)""", ("fx_beads",))
def _(t):
    return S.chain_replicates(runs(t).select("cond", "rep", "frame"), ["cond"])
