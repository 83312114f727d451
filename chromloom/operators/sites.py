"""Oriented binding sites: convergent pairs, conserved sites, signals, probe pairs, factors.

Sites are rows (keys, bin, ori). Range joins go through buckets as wide as the range, so both
sides meet in an equi-join and no pair outside the range is built beyond one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromloom.functions.joins import attach
from chromloom.functions.skew import percentiles, running_total, value_bucket

LOOP_MIN_BINS, LOOP_MAX_BINS = 20, 1_000


def pairs_within(
    left: DataFrame, right: DataFrame, keys: Sequence[str], lo: int, hi: int, at: str = "bin",
) -> DataFrame:
    """Rows of ``left`` (columns prefixed a_) and ``right`` (b_) with lo <= b.at - a.at <= hi."""
    keys = list(keys)
    width = max(1, hi - lo + 1)
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in left.columns if c not in keys])
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in right.columns if c not in keys])
    first = F.floor((F.col(f"a_{at}") + lo) / width)
    last = F.floor((F.col(f"a_{at}") + hi) / width)
    gap = F.col(f"b_{at}") - F.col(f"a_{at}")
    return (
        a.withColumn("_bk", F.explode(F.sequence(first, last)))
        .join(b.withColumn("_bk", F.floor(F.col(f"b_{at}") / width)), [*keys, "_bk"])
        .where((gap >= lo) & (gap <= hi))
        .drop("_bk")
    )


def convergent_pairs(
    sites: DataFrame, keys: Sequence[str], min_bins: int = LOOP_MIN_BINS,
    max_bins: int = LOOP_MAX_BINS, closed: bool = False,
) -> DataFrame:
    """Pairs of a forward site and a later reverse site: (keys, anchor1, anchor2, size_bins).

    Sizes lie in [min, max), or in [min, max] when ``closed``.
    """
    plus = sites.where(F.col("ori") == 1).select(*keys, "bin")
    minus = sites.where(F.col("ori") == -1).select(*keys, "bin")
    top = max_bins if closed else max_bins - 1
    return pairs_within(plus, minus, keys, max(min_bins, 1), top).select(
        *keys, F.col("a_bin").alias("anchor1"), F.col("b_bin").alias("anchor2"),
        (F.col("b_bin") - F.col("a_bin")).alias("size_bins"),
    )


def adjacent_convergent(sites: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of forward sites directly followed by a reverse site in position order.

    Sites of one type and locus are at most two per bin of the locus.
    """
    following = F.lead("ori").over(W.partitionBy(*keys).orderBy("bin", "ori"))
    return sites.withColumn("_next", following).groupBy(*keys).agg(
        F.count(F.when((F.col("ori") == 1) & (F.col("_next") == -1), 1)).alias("convergent")
    )


def conserved_sites(
    sites: DataFrame, keys: Sequence[str], types: Sequence[str], type_column: str = "ctcf_type",
    tol: int = 0,
) -> DataFrame:
    """Sites present in every type: (keys, bin, ori).

    With ``tol`` the first type's sites are kept if every other type has a site of the same
    orientation within ``tol`` bins.
    """
    keys = list(keys)
    one = sites.select(*keys, type_column, "bin", "ori").distinct()
    if tol <= 0:
        return (
            one.where(F.col(type_column).isin(list(types)))
            .groupBy(*keys, "bin", "ori").agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") == len(types)).drop("_n")
        )
    kept = one.where(F.col(type_column) == types[0]).drop(type_column)
    for other in types[1:]:
        there = one.where(F.col(type_column) == other).drop(type_column)
        near = pairs_within(kept, there, [*keys, "ori"], -tol, tol).select(
            *keys, "ori", F.col("a_bin").alias("bin")
        )
        kept = kept.join(near.distinct(), [*keys, "ori", "bin"], "left_semi")
    return kept.select(*keys, "bin", "ori")


def shared_or_specific(
    a: DataFrame, b: DataFrame, keys: Sequence[str], tol: int = 2
) -> DataFrame:
    """Sites of a with a neighbour in b within ``tol`` bins, of a alone and of b alone.

    Orientation is not compared.
    """
    keys = list(keys)

    def split(x: DataFrame, y: DataFrame, here: str, alone: str) -> DataFrame:
        at = x.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_c"))
        near = pairs_within(
            at.select(*keys, "bin"), y.select(*keys, "bin").distinct(), keys, -tol, tol
        ).select(*keys, F.col("a_bin").alias("bin")).distinct().withColumn("_near", F.lit(True))
        return at.join(near, [*keys, "bin"], "left").groupBy(*keys).agg(
            F.sum(F.when(F.col("_near"), F.col("_c")).otherwise(0)).alias(here),
            F.sum(F.when(F.col("_near"), 0).otherwise(F.col("_c"))).alias(alone),
        )

    left = split(a, b, "shared", "a_only")
    right = split(b, a, "_drop", "b_only").drop("_drop")
    zero = F.lit(0).cast("long")
    return left.join(right, keys, "full").select(
        *keys, *[F.coalesce(c, zero).alias(c) for c in ("shared", "a_only", "b_only")]
    )


def site_signal(sites: DataFrame, peaks: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """Signal of the peak a site came from, by name; the last line of a name wins.

    Unmatched sites get the median of the matched ones of their ``keys``, or 1 if none match.
    """
    keys = list(keys)
    by_name = peaks.where(F.col("signal").isNotNull()).groupBy(*keys, "name").agg(
        F.max_by("signal", line).alias("_signal")
    )
    joined = sites.join(by_name, [*keys, "name"], "left")
    middle = percentiles(joined, keys, "_signal", [0.5]).select(
        *keys, F.col("value").alias("_median")
    )
    return attach(joined, middle, keys, "left").withColumn(
        "signal", F.coalesce("_signal", "_median", F.lit(1.0))
    ).drop("_signal", "_median")


def anchor_overlap(loops: DataFrame, sites: DataFrame, bucket: int = 10_000) -> DataFrame:
    """Loops (loop_id, chrom, a_start, a_end, b_start, b_end) marked convergent when the first
    anchor overlaps a forward site and the second a reverse site (half-open intervals).

    Distinct anchors meet distinct sites; the answer per anchor is then looked up by the loops.
    """
    from chromloom.operators.checks import interval_pairs

    place = ["chrom", "start", "end"]
    out, no = loops, F.lit(False)
    for side, strand, name in (("a", "+", "_plus"), ("b", "-", "_minus")):
        at = [F.col("chrom"), F.col(f"{side}_start").alias("start"), F.col(f"{side}_end").alias("end")]
        there = sites.where(F.col("strand") == strand).select(*place).distinct()
        hit = interval_pairs(loops.select(*at).distinct(), there, bucket).select(*place).distinct()
        out = out.join(
            hit.select("chrom", F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"),
                       F.lit(True).alias(name)),
            ["chrom", f"{side}_start", f"{side}_end"], "left",
        )
    return out.withColumn(
        "convergent", F.coalesce("_plus", no) & F.coalesce("_minus", no)
    ).drop("_plus", "_minus")


def loop_site_change(calls: DataFrame) -> DataFrame:
    """Per loop: convergent in the first and second type (a, b) gives kept, lost, gained or none."""
    a, b = F.col("in_a"), F.col("in_b")
    return calls.withColumn(
        "change",
        F.when(a & b, "kept").when(a, "lost").when(b, "gained").otherwise("none"),
    )


def change_share(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number and share of loops per class of change."""
    n = changes.groupBy(*keys, "change").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0)))
    return n.withColumn("share", F.col("n") / total)


def rank_capture(
    sites: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float
) -> DataFrame:
    """Signal to probability by rank: weakest ``lo``, strongest ``hi``, ties share their mean rank.

    Equal signals, or a single site, get the midpoint. Ranks come from counts per distinct
    value, summed in value order inside value buckets, so a type may hold any number of sites.
    """
    keys = list(keys)
    counts = sites.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ends = running_total(counts, keys, ["_v"], value_bucket(F.col("_v")), F.col("_c"), "_end")
    totals = counts.groupBy(*keys).agg(
        F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_distinct")
    )
    mean_rank = F.col("_end") - F.col("_c") + (F.col("_c") - 1) / 2.0
    p = F.when(F.col("_distinct") == 1, F.lit((lo + hi) / 2.0)).otherwise(
        F.lit(lo) + F.lit(hi - lo) * F.try_divide(mean_rank, (F.col("_n") - 1).cast("double"))
    )
    ranked = attach(ends, totals, keys).select(*keys, F.col("_v").alias(value), p.alias("p"))
    return sites.join(ranked, [*keys, value])


def stall_map(sites: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    """Highest probability per bin and side: forward sites stall the left leg, reverse the right."""
    side = F.when(F.col("ori") == 1, "left").otherwise("right")
    return sites.groupBy(*keys, "bin", side.alias("side")).agg(F.max(p).alias("p"))


def signal_max_per_bin(peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strongest signal per bin."""
    return peaks.groupBy(*keys, "bin").agg(F.max("signal").alias("signal"))


def factor_types(bound: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bins with their sorted factor list and type number; lists are numbered from 1 in order.

    Type 0 is left for bins without factor. Distinct lists are few: subsets of the factors.
    """
    keys = list(keys)
    sets = bound.select(*keys, "bin", "factor").distinct().groupBy(*keys, "bin").agg(
        F.array_sort(F.collect_list("factor")).alias("factors")
    )
    kinds = sets.select(*keys, "factors").distinct()
    order = W.partitionBy(*keys).orderBy("factors") if keys else W.partitionBy(F.lit(0)).orderBy("factors")
    numbered = kinds.withColumn("type_id", F.row_number().over(order)).withColumn(
        "label", F.concat_ws("+", "factors")
    )
    return sets.join(numbered, [*keys, "factors"]).select(*keys, "bin", "type_id", "label", "factors")


def interaction_matrix(types: DataFrame, energies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strongest energy between the factors of every two types: (keys, type_a, type_b, energy).

    ``energies`` rows (factor_a, factor_b, energy) hold own and cross pairs once; missing pairs
    give 0. Only factor pairs with an energy are joined, then the matrix is completed with
    zeros for the (few) types. Type 0 is included.
    """
    keys = list(keys)
    kinds = types.select(*keys, "type_id", "factors").distinct()
    member = kinds.select(*keys, "type_id", F.explode("factors").alias("f"))
    both = energies.select("factor_a", "factor_b", "energy").unionByName(
        energies.select(
            F.col("factor_b").alias("factor_a"), F.col("factor_a").alias("factor_b"), "energy"
        )
    ).groupBy("factor_a", "factor_b").agg(F.max("energy").alias("energy"))
    a = member.select(*keys, F.col("type_id").alias("type_a"), F.col("f").alias("factor_a"))
    b = member.select(*keys, F.col("type_id").alias("type_b"), F.col("f").alias("factor_b"))
    strongest = (
        a.join(both, "factor_a").join(b, [*keys, "factor_b"])
        .groupBy(*keys, "type_a", "type_b").agg(F.max("energy").alias("_e"))
    )
    top = kinds.groupBy(*keys).agg(F.max("type_id").alias("_k"))
    ids = F.sequence(F.lit(0), F.col("_k"))
    grid = top.withColumn("type_a", F.explode(ids)).withColumn("type_b", F.explode(ids)).drop("_k")
    return grid.join(strongest, [*keys, "type_a", "type_b"], "left").select(
        *keys, "type_a", "type_b",
        F.greatest(F.coalesce("_e", F.lit(0.0)), F.lit(0.0)).alias("energy"),
    )


def longest_transcript(genes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per symbol: the longest transcript, the lowest start on ties."""
    span = F.col("tx_end") - F.col("tx_start")
    best = F.max_by(F.struct("strand", "tx_start", "tx_end"), F.struct(span, -F.col("tx_start")))
    return genes.groupBy(*keys, "symbol").agg(best.alias("_g")).select(*keys, "symbol", "_g.*")


def rank_probe_pairs(
    sites: DataFrame, keys: Sequence[str], anchor: int, min_sep: int, max_sep: int,
    convergent: bool = True, prefer_flanking: bool = True,
) -> DataFrame:
    """Candidate pairs within [min_sep, max_sep] bins with their rank: pairs around the anchor
    first, then by distance of their middle from it, then by position."""
    keys = list(keys)
    pairs = pairs_within(sites, sites, keys, max(min_sep, 0), max_sep).where(
        F.struct("a_bin", "a_ori") != F.struct("b_bin", "b_ori")
    )
    if convergent:
        pairs = pairs.where((F.col("a_ori") == 1) & (F.col("b_ori") == -1))
    a, b = F.col("a_bin"), F.col("b_bin")
    flanks = (a < anchor) & (b > anchor)
    return pairs.select(
        *keys, a.alias("left"), b.alias("right"),
        F.when(flanks & F.lit(prefer_flanking), 0).otherwise(1).alias("tier"),
        F.abs((a + b) / 2.0 - anchor).alias("offset"),
    ).distinct()


def relaxed_candidates(
    conserved: DataFrame, every: DataFrame, keys: Sequence[str], anchor: int, min_sep: int, max_sep: int,
    prefer_flanking: bool = True, strict: bool = True,
) -> DataFrame:
    """Ranked candidates of each group under the tightest rule that gives any, with its ``step``.

    Step 1: convergent pairs of conserved sites; 2: convergent pairs of all sites; 3: pairs of all
    sites in any orientation. A group of ``every`` without a pair under all of them is an error
    where ``strict``, else it has no rows.
    """
    keys = list(keys)
    ranked = [
        rank_probe_pairs(sites, keys, anchor, min_sep, max_sep, convergent, prefer_flanking).withColumn("step", F.lit(k))
        for k, (sites, convergent) in enumerate(((conserved, True), (every, True), (every, False)), 1)
    ]
    found = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    first = found.groupBy(*keys).agg(F.min("step").alias("step"))
    kept = found.join(first, [*keys, "step"])
    if not strict:
        return kept
    named = F.concat(F.lit("no pair of sites fits the separation in "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    checked = every.select(*keys).distinct().join(first, keys, "left").select(
        *keys, F.when(F.col("step").isNull(), F.raise_error(named).cast("int")).otherwise(F.col("step")).alias("step")
    )
    return found.join(checked, [*keys, "step"])


def auto_probe_pairs(
    candidates: DataFrame, keys: Sequence[str], n_pairs: int = 2, disjoint: bool = True
) -> DataFrame:
    """Best ``n_pairs`` candidates per group without shared anchors, filled up with the next best.

    Only a short list of a group can matter. Choosing uses up at most 2 (n - 1) anchors, so of
    the candidates with one left anchor (or one right anchor) the best 2n - 1 are enough, and of
    those left the first that a used anchor can't have blocked; filling up needs the best 2n.
    The list is walked once per group.
    """
    keys = list(keys)
    n, rank = n_pairs, ["tier", "offset", "left", "right"]
    best = lambda *by: F.row_number().over(W.partitionBy(*keys, *by).orderBy(*rank))
    fill = candidates.withColumn("_k", best()).where(F.col("_k") <= 2 * n).drop("_k")
    if disjoint:
        by_left = candidates.withColumn("_k", best("left")).where(F.col("_k") < 2 * n).drop("_k")
        by_both = by_left.withColumn("_k", best("right")).where(F.col("_k") < 2 * n).drop("_k")
        enough = n + 2 * (n - 1) * 2 * (2 * n - 1)
        some = by_both.withColumn("_k", best()).where(F.col("_k") <= enough).drop("_k")
        fill = fill.unionByName(some).distinct()
    short = fill.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rank))).alias("_c"))
    nothing = F.array().cast(short.schema["_c"].dataType)

    def pick(chosen: Column, c: Column) -> Column:
        taken = F.exists(chosen, lambda x: x["left"].isin(c["left"], c["right"]) | x["right"].isin(c["left"], c["right"]))
        return F.when((F.size(chosen) < n) & ~taken, F.concat(chosen, F.array(c))).otherwise(chosen)

    def add(chosen: Column, c: Column) -> Column:
        return F.when((F.size(chosen) < n) & ~F.array_contains(chosen, c), F.concat(chosen, F.array(c))).otherwise(chosen)

    first = F.aggregate("_c", nothing, pick) if disjoint else F.slice("_c", 1, n)
    picked = short.withColumn("_first", first).withColumn("_all", F.aggregate("_c", F.col("_first"), add))
    return picked.select(*keys, F.posexplode("_all").alias("_p", "_r")).select(
        *keys, (F.col("_p") + 1).cast("int").alias("place"), "_r.left", "_r.right", "_r.tier", "_r.offset"
    )


def probe_pairs(explicit: DataFrame, auto: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Explicit pairs where a group has any, else the automatic ones, with labels."""
    keys = list(keys)
    label = F.concat_ws("-", "left", "right")
    given = explicit.select(
        *keys, "left", "right", F.coalesce(F.col("label"), label).alias("label")
    )
    other = auto.join(explicit.select(*keys).distinct(), keys, "left_anti").select(
        *keys, "left", "right", F.concat(F.lit("auto:"), label).alias("label")
    )
    return given.unionByName(other)


def near_anchor_counts(sites: DataFrame, keys: Sequence[str], anchor: int, halves: dict[str, int]) -> DataFrame:
    """Sites in [anchor - half, anchor + half) bins for several half-widths."""
    return sites.groupBy(*keys).agg(*[
        F.count(F.when((F.col("bin") >= anchor - h) & (F.col("bin") < anchor + h), 1)).alias(name)
        for name, h in halves.items()
    ])


def blocker_counts(sites: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bins that block the left leg, the right leg, and either."""
    return sites.groupBy(*keys).agg(
        F.countDistinct(F.when(F.col("ori") == 1, F.col("bin"))).alias("left_blockers"),
        F.countDistinct(F.when(F.col("ori") == -1, F.col("bin"))).alias("right_blockers"),
        F.countDistinct("bin").alias("occupied"),
    )


def same_sites(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows found in only one of two site tables, with multiplicity; empty when they agree."""
    one, two = a.select(*columns), b.select(*columns)
    return (
        one.exceptAll(two).withColumn("only_in", F.lit("a"))
        .unionByName(two.exceptAll(one).withColumn("only_in", F.lit("b")))
    )
