"""Hi-C windows from tables of bins and pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.operators.curves import ps_curve
from chromloom.operators.maps import balance, balanced_value, divides

# fixed values: normalisation columns tried in this order
AUTO_BALANCE = ("KR", "weight")
#: Base pairs of a block of stored pixels.
PIXEL_BLOCK = 5_000_000


def balance_column(columns: Sequence[str], asked: bool | str) -> str | None:
    """The bins column to balance with: False none, True ``weight``, "auto" the first of KR and
    weight that exists, else the column of that name."""
    if asked is False:
        return None
    wanted = AUTO_BALANCE if asked == "auto" else ("weight" if asked is True else asked,)
    for name in wanted:
        if name in columns:
            return name
    known = [c for c in columns if c not in ("sample", "chrom", "start", "end", "bin")]
    raise ValueError(f"no normalisation column {' or '.join(wanted)}; available: {known}")


def resolution_check(bins: DataFrame, resolution: int) -> DataFrame:
    """Smallest and largest bin width and whether both are the wanted resolution.

    The last bin of a chromosome may be shorter: it only counts if it is wider, or the only one.
    """
    ends = ["sample", "chrom"] if "sample" in bins.columns else ["chrom"]
    of_chrom = bins.groupBy(*ends).agg(F.max("start").alias("_last"), F.count(F.lit(1)).alias("_n"))
    width = F.col("end") - F.col("start")
    inner = (F.col("start") < F.col("_last")) | (F.col("_n") == 1) | (width > resolution)
    return bins.join(of_chrom, ends).where(inner).agg(F.min(width).alias("bin_lo"), F.max(width).alias("bin_hi")).withColumn(
        "ok", (F.col("bin_lo") == resolution) & (F.col("bin_hi") == resolution)
    )


def longest_chromosome(bins: DataFrame) -> DataFrame:
    """The chromosome with the largest end, first by name on ties."""
    return (
        bins.groupBy("chrom").agg(F.max("end").alias("size"))
        .orderBy(F.desc("size"), "chrom").limit(1)
    )


def hic_region(
    pixels: DataFrame, bins: DataFrame, chrom: str, start: int, end: int, resolution: int,
    column: str | None = None, divisive: bool | None = None,
) -> DataFrame:
    """Pixels (i, j, v) of one window, bins counted from its start.

    The window filter reaches the bins scan, and the range of its bins the pixels scan. For many
    windows of one map store its pixels first (:func:`store_pixels`). The
    window has (end - start) // resolution bins; a part of a bin at its end is left out.
    Balanced values that are not finite are zero, and missing pixels mean zero.
    """
    weight = F.col(column).alias("_w") if column else F.lit(1.0).alias("_w")
    at = F.floor((F.col("start") - start) / resolution)
    inside = bins.where(
        (F.col("chrom") == chrom) & (F.col("start") >= start) & (at < (end - start) // resolution)
    ).select(
        F.col("bin").alias("_bin"),
        F.floor((F.col("start") - start) / resolution).cast("int").alias("_at"), weight,
    )
    a = inside.select(F.col("_bin").alias("bin1"), F.col("_at").alias("i"))
    b = inside.select(F.col("_bin").alias("bin2"), F.col("_at").alias("j"))
    ids = inside.agg(F.struct(F.min("_bin").alias("lo"), F.max("_bin").alias("hi")).alias("r"))
    near = F.lit(True)
    for end in ("bin1", "bin2"):
        near = near & (F.col(end) >= ids.select("r.lo").scalar()) & (F.col(end) <= ids.select("r.hi").scalar())
    window = pixels.where(near).join(a, "bin1").join(b, "bin2").select(
        "i", "j", F.col("n").cast("double").alias("v")
    )
    if column is None:
        return window
    weights = inside.select(F.col("_at").alias("bin"), F.col("_w").alias("w"))
    return balance(window, weights, [], "w", divides(column) if divisive is None else divisive)


def store_pixels(pixels: DataFrame, bins: DataFrame, path: str, block: int = PIXEL_BLOCK, mode: str = "error") -> None:
    """Store pixels by chromosome and block of ``block`` base pairs of their first bin, sorted, with
    the starts and normalisation values of both bins.

    A window then needs no join: its partitions are pruned by chromosome and block, its row groups
    by the two starts. Pixels between chromosomes are kept (``chrom2``); rows of unknown bins go.
    """
    norms = [c for c in bins.columns if c not in ("sample", "chrom", "start", "end", "bin")]

    def side(k: int) -> DataFrame:
        return bins.select(
            F.col("bin").alias(f"bin{k}"), F.col("chrom").alias("chrom" if k == 1 else "chrom2"), F.col("start").cast("long").alias(f"start{k}"),
            *[F.col(c).cast("double").alias(f"{c}{k}") for c in norms])

    placed = pixels.join(side(1), "bin1").join(side(2), "bin2").withColumn("block", F.floor(F.col("start1") / block))
    order = ["chrom", "block", "chrom2", "start1", "start2"]
    ends = [f"{c}{k}" for k in (1, 2) for c in ("start", *norms)]
    # ranges split a block that holds more than others
    placed.select("chrom", "block", "chrom2", *ends, "n").repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy(
        "chrom", "block").parquet(path)


def stored_region(
    spark: SparkSession, path: str, chrom: str, start: int, end: int, resolution: int, column: str | None = None,
    divisive: bool | None = None, block: int = PIXEL_BLOCK,
) -> DataFrame:
    """Pixels (i, j, v) of one window of stored pixels; the same rows as :func:`hic_region`."""
    stop = start + (end - start) // resolution * resolution
    inside = (F.col("chrom") == chrom) & F.col("block").between(start // block, max(start, stop - 1) // block) & (F.col("chrom2") == chrom)
    for k in (1, 2):
        inside = inside & (F.col(f"start{k}") >= start) & (F.col(f"start{k}") < stop)
    names = ["n", *[f"{c}{k}" for k in (1, 2) for c in ("start", *([column] if column else []))]]
    window = spark.read.parquet(path).where(inside).select(*names)
    n = F.col("n").cast("double")
    if column is not None:
        n = balanced_value(n, F.col(f"{column}1"), F.col(f"{column}2"), divides(column) if divisive is None else divisive)
    at = [F.floor((F.col(f"start{k}") - start) / resolution).cast("int").alias(c) for k, c in ((1, "i"), (2, "j"))]
    return window.select(*at, n.alias("v"))


def ps_of_window(window: DataFrame, chrom: str, start: int, end: int, resolution: int, min_diag: int = 2) -> DataFrame:
    """Distance curve (region, d, p) of a window's pixels."""
    n_bins = -(-(end - start) // resolution)
    return ps_curve(window.withColumn("region", F.lit(chrom)), ["region"], n_bins, min_diag=min_diag)


def ps_experimental(
    pixels: DataFrame, bins: DataFrame, resolution: int, region: tuple[str, int, int] | None = None,
    column: str | None = None, min_diag: int = 2, divisive: bool | None = None,
) -> DataFrame:
    """Distance curve of a balanced window, or of the longest chromosome: (region, d, p).

    Unusable bins count as zero; the first ``min_diag`` distances are NULL.
    """
    if region is None:
        top = longest_chromosome(bins).first()
        region = (top["chrom"], 0, top["size"])
    chrom, start, end = region
    return ps_of_window(hic_region(pixels, bins, chrom, start, end, resolution, column, divisive), chrom, start, end, resolution, min_diag)
