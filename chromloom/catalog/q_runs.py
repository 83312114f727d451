"""Run bookkeeping queries: replicate choice, depth matching, shards, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromloom.catalog.q_dynamics import r6
from chromloom.catalog.registry import query
from chromloom.operators import runs as R

# runs named from orders: merged copies, bare copies and shards
RUNS = """
WITH rn AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'merged_' ELSE '' END || 'cond' || (o_custkey % 200) || '_rep' || (o_orderkey % 10)
    || CASE WHEN o_orderkey % 5 = 0 THEN '_shard' || (o_custkey % 7) ELSE '' END AS name, max(o_orderkey % 97) AS n_blocks FROM orders GROUP BY ALL)
, ds AS (SELECT regexp_extract(regexp_replace(name, '^merged_', ''), '^(.+)_rep(\\d+)$', 1) AS condition,
    CAST(regexp_extract(regexp_replace(name, '^merged_', ''), '^(.+)_rep(\\d+)$', 2) AS INTEGER) AS replicate, name, n_blocks,
    starts_with(name, 'merged_') AS mg FROM rn WHERE NOT regexp_matches(name, '_shard\\d+$'))
, ru AS (SELECT condition, replicate, name, n_blocks FROM (SELECT *, row_number() OVER (PARTITION BY condition, replicate ORDER BY mg DESC, name DESC) AS k FROM ds) WHERE k = 1 AND n_blocks > 0)
"""


def named(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(
        F.when(k % 3 == 0, "merged_").otherwise(""), F.lit("cond"), c % 200, F.lit("_rep"), k % 10,
        F.when(k % 5 == 0, F.concat(F.lit("_shard"), c % 7)).otherwise(""),
    )
    return t("orders").groupBy(name.alias("name")).agg(F.max(k % 97).alias("n_blocks"))


@query("win5_discover_runs", RUNS + "SELECT * FROM ru")
def _(t):
    return R.discover_runs(named(t))


CHOSEN = RUNS + """
, ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY n_blocks DESC, replicate) AS new_rep FROM ru WHERE n_blocks >= 20) WHERE new_rep <= 3)
"""


@query("win5_choose_replicates", CHOSEN + """
SELECT condition, replicate, name, n_blocks, CAST(new_rep AS INTEGER) AS new_rep FROM ch""")
def _(t):
    return R.choose_replicates(R.discover_runs(named(t)), 3, 20)


DEPTH = """
WITH fr AS (SELECT user_id AS condition, event_type AS replicate, event_id AS block, value FROM events)
, nb AS (SELECT condition, replicate, count(DISTINCT block) AS n_blocks FROM fr GROUP BY ALL)
, ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY n_blocks DESC, replicate) AS new_rep FROM nb WHERE n_blocks >= 5) WHERE new_rep <= 2)
, pl AS (SELECT fr.*, n_blocks, new_rep, row_number() OVER (PARTITION BY fr.condition, fr.replicate ORDER BY block) AS k FROM fr JOIN ch ON ch.condition = fr.condition AND ch.replicate = fr.replicate)
SELECT condition, replicate, block, value, CAST(new_rep AS INTEGER) AS new_rep FROM pl WHERE """


def depth(t, mode):
    frames = t("events").select(
        F.col("user_id").alias("condition"), F.col("event_type").alias("replicate"),
        F.col("event_id").alias("block"), "value",
    )
    runs = frames.groupBy("condition", "replicate").agg(F.count(F.lit(1)).alias("n_blocks"))
    chosen = R.choose_replicates(runs, 2, 5)
    return R.depth_match(frames, chosen, ["condition", "replicate"], "block", 5, mode)


@query("prj13_depth_match_tail", DEPTH + "k > n_blocks - 5")
def _(t):
    return depth(t, "tail")


@query("prj13_depth_match_head", DEPTH + "k <= 5")
def _(t):
    return depth(t, "head")


@query("prj14_drop_shards", RUNS + "SELECT name, n_blocks FROM rn WHERE NOT regexp_matches(name, '_shard\\d+$')")
def _(t):
    return R.drop_shards(named(t))


@query("win15_latest_pooled", """
SELECT o_custkey AS condition, max(o_orderkey % 50) AS n_blocks, arg_max('f' || (100000 + o_orderkey), row(o_orderkey % 50, 'f' || (100000 + o_orderkey))) AS path FROM orders GROUP BY o_custkey""")
def _(t):
    runs = t("orders").select(
        F.col("o_custkey").alias("condition"), (F.col("o_orderkey") % 50).alias("n_blocks"),
        F.concat(F.lit("f"), F.col("o_orderkey") + 100000).alias("path"),
    )
    return R.latest_pooled(runs)


COUNTS = """
WITH e AS (SELECT DISTINCT a.user_id AS condition, b.event_type AS replicate FROM (SELECT DISTINCT user_id FROM events) a CROSS JOIN (SELECT DISTINCT event_type FROM events) b)
, n AS (SELECT user_id AS condition, event_type AS replicate, count(*) AS n FROM events GROUP BY ALL)
, fc AS (SELECT e.condition, e.replicate, coalesce(n, 0) AS n_frames FROM e LEFT JOIN n ON n.condition = e.condition AND n.replicate = e.replicate)
"""


def counted(t):
    frames = t("events").select(F.col("user_id").alias("condition"), F.col("event_type").alias("replicate"))
    kinds = frames.agg(F.collect_set("replicate").alias("k"))
    expected = frames.select("condition").distinct().withColumn("replicate", F.explode(kinds.scalar()))
    return R.frame_counts(frames, expected, ["condition", "replicate"])


@query("ag62_frame_counts", COUNTS + "SELECT * FROM fc")
def _(t):
    return counted(t)


@query("ag75_run_completeness", COUNTS + """
SELECT condition, count(*) FILTER (n_frames >= 20) AS complete, count(*) FILTER (n_frames > 0 AND n_frames < 20) AS partial,
  count(*) FILTER (n_frames = 0) AS empty FROM fc GROUP BY condition""")
def _(t):
    return R.completeness(counted(t), "condition", 20)


@query("ag72_shard_groups", RUNS + """
, g AS (SELECT regexp_extract(name, '^(.+_rep\\d+)_shard(\\d+)$', 1) AS base FROM rn)
, gc AS (SELECT base, count(*) AS n_found FROM g WHERE base <> '' GROUP BY base)
, md AS (SELECT DISTINCT base, 2 AS n FROM gc WHERE base LIKE 'merged%')
SELECT gc.base, n_found, CAST(coalesce(n, 0) AS BIGINT) AS n_merged FROM gc LEFT JOIN md ON md.base = gc.base WHERE n_found > coalesce(n, 0)""")
def _(t):
    shards = named(t)
    merged = shards.select(F.regexp_extract("name", r"^(merged.+_rep\d+)_shard\d+$", 1).alias("base")).where(
        "base <> ''"
    ).distinct().withColumn("n_shards", F.lit(2).cast("long"))
    return R.shard_groups(shards, merged)


@query("jn17_runs_to_conditions", RUNS + """
, ky AS (SELECT DISTINCT 'cond' || (o_custkey % 30) AS key FROM orders)
, st AS (SELECT name, n_blocks, regexp_replace(regexp_replace(name, '^merged_', ''), '_rep\\d+$', '') AS stem FROM rn)
SELECT name, any_value(n_blocks) AS n_blocks, arg_max(key, length(key)) AS condition_key FROM st LEFT JOIN ky ON starts_with(stem, key) GROUP BY name""")
def _(t):
    keys = t("orders").select(F.concat(F.lit("cond"), F.col("o_custkey") % 30).alias("key")).distinct()
    return R.match_conditions(named(t), keys)


@query("prj17_keyed_override", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'n' || o_orderkey WHEN o_orderstatus = 'F' THEN 'tF' ELSE 'd' END AS value FROM orders""")
def _(t):
    items = t("orders").select(
        F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("type"), F.lit("d").alias("default")
    )
    by_name = t("orders").where("o_orderkey % 3 = 0").select(
        F.col("o_orderkey").alias("name"), F.concat(F.lit("n"), F.col("o_orderkey")).alias("value")
    )
    by_type = t("orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderstatus").alias("type"), F.lit("tF").alias("value")
    ).distinct()
    return R.keyed_override(items, by_name, by_type).select(F.col("name").alias("id"), "value")


@query("ag70_best_condition", """
, m AS (SELECT metric, cond, avg(value) AS value FROM fx_metrics GROUP BY ALL)
SELECT metric, arg_max(cond, value) AS best, round(max(value), 6) AS value FROM m GROUP BY metric""", ("fx_metrics",))
def _(t):
    m = t.fx("fx_metrics").groupBy("metric", "cond").agg(F.avg("value").alias("value"))
    return r6(R.best_condition(m), "value")


@query("ag61_metric_mean_std", """
SELECT metric, cond, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM fx_metrics GROUP BY ALL""", ("fx_metrics",))
def _(t):
    return r6(R.metric_mean_std(t.fx("fx_metrics"), ["metric", "cond"]), "mean", "std")


@query("set4_ordered_union", """
, l AS (SELECT DISTINCT cond AS name, 0 AS k, cond AS p FROM fx_metrics UNION ALL SELECT DISTINCT metric, 1, metric FROM fx_metrics
  UNION ALL SELECT DISTINCT cond, 2, cond FROM fx_metrics)
, f AS (SELECT name, min(k || p) AS o FROM l GROUP BY name)
SELECT name, CAST(row_number() OVER (ORDER BY o, name) AS INTEGER) AS place FROM f""", ("fx_metrics",))
def _(t):
    m = t.fx("fx_metrics")

    def listed(df, c):
        return R.place_by(df.select(F.col(c).alias("name")).distinct(), "name", "name")

    return R.ordered_union(listed(m, "cond"), listed(m, "metric"), listed(m, "cond"))


@query("bnd5_runs_by_reference", """
SELECT o_orderkey AS run, o_orderstatus AS target, r.reference, o_orderstatus = r.reference AS is_target
FROM orders CROSS JOIN (SELECT DISTINCT o_orderstatus AS reference FROM orders) r""")
def _(t):
    runs = t("orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("target"))
    return R.expand_references(runs, runs.select(F.col("target").alias("reference")))
