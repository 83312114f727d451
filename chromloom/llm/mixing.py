"""Mixing sources to target weights: hierarchical token budgets over a domain-language-source tree.

A budget flows from the root by weight. A child that holds less than its part takes all it has
(its tokens times the number of epochs); what it leaves goes to its siblings by weight, and only
what a whole family cannot take is left to the family's own siblings, as a node never gets more
than its subtree holds. A leaf's sequence is its documents in a seeded order, once an epoch with
another seed; the leaf takes the longest prefix of that sequence within its budget: whole epochs,
then a token prefix of the next.

Only sums by leaf and by bucket of the seeded order are shuffled; rows are sorted within the one
bucket of a leaf in which its prefix ends, of bounded size, so a hot source is no single task's
work. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromloom.llm.common import WORD, stored, with_columns

#: Documents in a bucket of the seeded order, on average.
BUCKET_ROWS = 4096


def token_count(text: Column) -> Column:
    """Words of the text; none for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(level: Column, weights: Mapping[str, int]) -> Column:
    """Whole-number weight of a node; 1 for names without one."""
    found = F.lit(1)
    for name, w in sorted(weights.items()):
        found = F.when(level == name, F.lit(int(w))).otherwise(found)
    return found.cast("double")


def fill(nodes: DataFrame, family: Sequence[str], name: str) -> DataFrame:
    """Give each family's budget ``__budget`` to its members by ``__weight`` up to ``__room``.

    Members sorted by room per weight fill up first; the others share what is left by weight.
    Adds ``__share``. A family's members are the nodes of one parent.
    """
    order = Window.partitionBy(*family).orderBy(F.col("__room") / F.col("__weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ratio = F.col("__room") / F.col("__weight")
    level = (F.col("__budget") - F.col("__taken")) / F.col("__left")
    full = nodes.withColumn("__taken", F.coalesce(F.sum("__room").over(before), F.lit(0.0))).withColumn("__left", F.sum("__weight").over(rest))
    # the level at the first member that is not filled holds for all that follow; it falls from
    # there on, so it is the highest of those that are not filled, ties of the ratio included
    shared = full.withColumn("__level", F.max(F.when(ratio > level, level)).over(Window.partitionBy(*family)))
    share = F.when(F.col("__level").isNull(), F.col("__room")).otherwise(F.least(F.col("__room"), F.col("__weight") * F.col("__level")))
    return shared.withColumn("__share", share).drop("__taken", "__left", "__level")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: Column, epochs: int) -> DataFrame:
    """``levels, tokens, docs, budget`` for each leaf of ``leaves`` (``levels, tokens, docs``)."""
    part = leaves.withColumn("__budget", budget)
    for depth, level in enumerate(levels):
        family, node = list(levels[:depth]), list(levels[: depth + 1])
        if not family:
            part = part.withColumn("__root", F.lit(0))
            family = ["__root"]
        nodes = (
            part.groupBy(*dict.fromkeys([*family, *node])).agg(F.sum("tokens").alias("__t"), F.first("__budget").alias("__budget"))
            .withColumn("__room", (F.col("__t") * epochs).cast("double")).withColumn("__weight", weight_of(F.col(level), weights.get(level, {})))
        )
        given = fill(nodes, family, level).select(*node, F.col("__share").alias("__given"))
        part = part.drop("__root").join(given, node).withColumn("__budget", F.col("__given")).drop("__given")
    return part.withColumnRenamed("__budget", "budget")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Sixteen hex digits: a document's place in the seeded order of an epoch."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 16)


def mix(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], budget_percent: int = 70,
    epochs: int = 2, seed: int = 17, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Every document with its levels, ``tokens`` and ``copies``: how often the mix takes it.

    ``levels`` names the tree's levels from the top, each with its expression; a null level is
    the empty name. The budget is a percentage of all tokens, rounded down. Ties in the seeded
    order (repeated ids) go by tokens. A document without words costs nothing and is taken where
    the prefix reaches it. Weights of names that are not listed are 1. A leaf's part is cut to
    whole tokens. An empty table gives no rows. Input columns named like a level, tokens or
    copies give way.
    """
    names = list(levels)
    base = with_columns(docs, {**{k: F.coalesce(v, F.lit("")) for k, v in levels.items()}, "tokens": token_count(F.col(text))})
    small = stored(base.select(F.col(doc_id).alias("__doc"), *names, "tokens"), "op6-rows")
    leaves = small.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    total = small.agg(F.sum("tokens")).first()[0] or 0
    goals = leaf_budgets(leaves, names, weights, F.lit(float(total * budget_percent // 100)), epochs).select(
        *names, F.floor(F.col("budget")).alias("__goal"), F.col("tokens").alias("__all"),
        F.ceil(F.col("docs") / BUCKET_ROWS).alias("__buckets"),
    )
    whole = F.when(F.col("__all") > 0, F.floor(F.col("__goal") / F.col("__all"))).otherwise(0).cast("long")
    goals = stored(goals.withColumn("__whole", whole).withColumn("__over", F.col("__goal") - F.col("__whole") * F.col("__all")), "op6-goals")

    def placed(df: DataFrame, key: Column) -> DataFrame:
        """With the leaf's goal, the document's key in the cut epoch and its bucket."""
        at = F.conv(F.substring(F.col("__key"), 1, 8), 16, 10).cast("long")
        return (
            df.join(goals, names).withColumn("__key", order_key(seed, F.col("__whole") + 1, key))
            .withColumn("__bucket", F.floor(at * F.col("__buckets") / F.lit(1 << 32)))
        )

    upto = Window.partitionBy(*names).orderBy("__bucket")
    sums = placed(small, F.col("__doc")).groupBy(*names, "__bucket", "__over").agg(F.sum("tokens").alias("__t"))
    # the first bucket whose running sum passes what is over; none where all of the epoch fits
    edge = (
        sums.withColumn("__upto", F.sum("__t").over(upto)).filter(F.col("__upto") > F.col("__over"))
        .groupBy(*names).agg(F.min(F.struct("__bucket", (F.col("__upto") - F.col("__t")).alias("before"))).alias("__edge"))
    )
    edges = stored(edge.select(*names, F.col("__edge.__bucket").alias("__cut"), F.col("__edge.before").alias("__before")), "op6-edges")
    every = placed(base, F.col(doc_id)).join(edges, names, "left")
    again = F.col("__whole") < epochs  # a leaf that gives all its epochs has no further one
    kept = [F.col(f"`{c}`") for c in base.columns if c.lower() != "copies"]
    at_edge = F.coalesce(F.col("__bucket") == F.col("__cut"), F.lit(False))
    clear = every.filter(~at_edge).select(
        *kept, (F.col("__whole") + F.when(again & F.coalesce(F.col("__bucket") < F.col("__cut"), F.lit(True)), 1).otherwise(0)).alias("copies"))
    run = Window.partitionBy(*names).orderBy("__key", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = every.filter(at_edge).withColumn("__sum", F.sum("tokens").over(run) + F.col("__before")).select(
        *kept, (F.col("__whole") + F.when(again & (F.col("__sum") <= F.col("__over")), 1).otherwise(0)).alias("copies"))
    return clear.unionByName(cut)
