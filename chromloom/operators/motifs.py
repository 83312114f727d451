"""Orientation of peaks from motif hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GENOMIC_NAME = r"^([^:]+):(\d+)-(\d+)$"


def _placed(hits: DataFrame, *columns: str) -> DataFrame:
    """Hits on the genome: (chrom, _s, _e, columns), ``chrom:a-b`` names shifted by a."""
    offset = F.regexp_extract("sequence_name", GENOMIC_NAME, 2)
    relative = offset != ""
    shift = F.coalesce(offset.try_cast("int"), F.lit(0))
    # inline makes one materialised row per hit: otherwise the broadcast join would run the
    # regular expressions again for every candidate window
    row = F.struct(
        F.when(relative, F.regexp_extract("sequence_name", GENOMIC_NAME, 1))
        .otherwise(F.col("sequence_name")).alias("chrom"),
        (F.col("start") + shift).alias("_s"), (F.col("stop") + shift).alias("_e"), *columns,
    )
    return hits.select(F.inline(F.array(row)))


def _contained(placed: DataFrame, windows: DataFrame, bucket: int) -> DataFrame:
    """Placed hits beside the windows (chrom, _ws, _we) that hold them."""
    spread = windows.withColumn(
        "_bk", F.explode(F.sequence(F.floor(F.col("_ws") / bucket), F.floor(F.col("_we") / bucket)))
    )
    return placed.withColumn("_bk", F.floor(F.col("_s") / bucket)).join(spread, ["chrom", "_bk"]).where(
        (F.col("_ws") < F.col("_s")) & (F.col("_e") <= F.col("_we"))
    )


def match_hits(hits: DataFrame, windows: DataFrame, bucket: int = 256) -> DataFrame:
    """Hits with the window (key) they lie in.

    A hit names its window directly (any ``::`` tail dropped), or gives ``chrom:a-b`` with
    window-relative coordinates, or the chromosome with genome coordinates; the last two are
    matched by containment: window start < hit start and hit stop <= window end.
    """
    name = F.split("sequence_name", "::")[0]
    named = hits.withColumn("name", name)
    by_name = windows.select(F.col("name"), "key")
    direct = named.join(by_name, "name").select("key", "strand", "p", "line")
    other = named.join(by_name.select("name"), "name", "left_anti")
    placed = _placed(other, "strand", "p", "line")
    spans = windows.select("chrom", F.col("start0").alias("_ws"), F.col("end").alias("_we"), "key")
    return direct.unionByName(_contained(placed, spans, bucket).select("key", "strand", "p", "line"))


def hits_per_window(hits: DataFrame, windows: DataFrame, bucket: int = 256) -> DataFrame:
    """Hits of each window that has one, as ``match_hits`` pairs them: (key, n, p, plus) with the
    lowest p and the number on the plus strand.

    Equal places meet once: hits are summed by name and place and windows by their borders before
    they are compared, so the work follows the places there are, however many hits and windows
    share one, and the pairs are never made.
    """
    whole = [F.sum("n").alias("n"), F.min("p").alias("p"), F.sum("plus").alias("plus")]
    plus = (F.col("strand") == "+").cast("long")
    single = hits.select(
        "sequence_name", "start", "stop", F.lit(1).cast("long").alias("n"), "p", F.coalesce(plus, F.lit(0)).alias("plus")
    )
    spots = single.groupBy("sequence_name", "start", "stop").agg(*whole).withColumn("name", F.split("sequence_name", "::")[0])
    by_name = windows.select("name", "key")
    direct = spots.groupBy("name").agg(*whole).join(by_name, "name").select("key", "n", "p", "plus")
    other = spots.join(by_name.select("name"), "name", "left_anti")
    placed = _placed(other, "n", "p", "plus").groupBy("chrom", "_s", "_e").agg(*whole)
    spans = windows.select("chrom", F.col("start0").alias("_ws"), F.col("end").alias("_we"), "key")
    borders = ["chrom", "_ws", "_we"]
    held = _contained(placed, spans.select(*borders).distinct(), bucket).groupBy(*borders).agg(*whole)
    contained = spans.join(held, borders).select("key", "n", "p", "plus")
    return direct.unionByName(contained).groupBy("key").agg(*whole)


def best_hit(hits: DataFrame, keys: Sequence[str], line: Sequence[str] = ("line",)) -> DataFrame:
    """Strand and p of the lowest p per peak, the first line on ties; combined before the shuffle."""
    best = F.min(F.struct("p", *line, "strand"))
    return hits.groupBy(*keys).agg(best.alias("_h")).select(
        *keys, F.col("_h.strand").alias("strand"), F.col("_h.p").alias("p")
    )


def orient_peaks(
    peaks: DataFrame, best: DataFrame, keys: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Peaks with orientation. A file (``group``) whose peaks all carry a strand is used as it
    is; otherwise the best hit decides and peaks without one are dropped."""
    group = list(group)
    stranded = F.col("strand").isin("+", "-")
    gate = peaks.groupBy(*group).agg(F.min(stranded.cast("int")).alias("_all"))
    hit = best.select(*keys, F.col("strand").alias("_strand"), F.col("p").alias("motif_p"))
    if group:
        gated = peaks.join(gate, group)
    else:
        gated = peaks.withColumn("_all", gate.scalar())
    joined = gated.join(hit, list(keys), "left")
    strand = F.when(F.col("_all") == 1, F.col("strand")).otherwise(F.col("_strand"))
    return (
        joined.withColumn("strand", strand).where(F.col("strand").isNotNull())
        .withColumn("motif_p", F.when(F.col("_all") == 0, F.col("motif_p")))
        .withColumn("orientation", F.when(F.col("strand") == "+", 1).otherwise(-1))
        .drop("_all", "_strand")
    )
