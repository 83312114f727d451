"""BED output: formatted lines as a column, and writers that store them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromloom.functions.coords import bin_of, bp_of, in_bins, midpoint
from chromloom.functions.skew import row_numbers


def _line(*cells: Column) -> Column:
    return F.concat_ws("\t", *[c.cast("string") for c in cells])


def _strand(ori: Column) -> Column:
    return F.when(ori == 1, "+").otherwise("-")


def oriented_bed_lines(peaks: DataFrame) -> DataFrame:
    """BED6 lines with a whole-number score and the strand of the orientation."""
    return peaks.select(_line(
        F.col("chrom"), F.col("start"), F.col("end"), F.col("name"),
        F.col("score").cast("int"), _strand(F.col("orientation")),
    ).alias("value"))


def relative_bed_lines(sites: DataFrame, region_start: int, resolution: int, n_bins: int) -> DataFrame:
    """BED6 lines of sites in the window with their bin and signed orientation."""
    bin_ = bin_of(midpoint(F.col("start"), F.col("end")), region_start, resolution)
    placed = sites.withColumn("_bin", bin_).where(in_bins(F.col("_bin"), n_bins))
    return placed.select(_line(
        F.col("chrom"), F.col("start"), F.col("end"), F.col("name"),
        F.format_string("%.2f", F.col("score")), F.col("strand"), F.col("_bin"),
        F.when(F.col("strand") == "+", "+1").otherwise("-1"),
    ).alias("value"))


def conserved_bed_lines(sites: DataFrame, chrom: str, region_start: int, resolution: int) -> DataFrame:
    """One-base records at bin centres, numbered in (bin, ori) order, with the fixed score 600."""
    numbered = row_numbers(
        sites.select("bin", "ori"), [], ["bin", "ori"], F.floor(F.col("bin") / 1024), "_k"
    )
    at = bp_of(F.col("bin"), region_start, resolution)
    return numbered.select("bin", "ori", _line(
        F.lit(chrom), at, at + 1, F.format_string("CTCF_cons_%04d", F.col("_k") - 1), F.lit(600),
        _strand(F.col("ori")),
    ).alias("value"))


def summit_bed_lines(peaks: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """One-base records at summits inside the closed region."""
    here = peaks.where((F.col("chrom") == chrom) & F.col("summit").between(start, end))
    return here.select(_line(
        F.col("chrom"), F.col("summit"), F.col("summit") + 1, F.col("name"),
        F.col("score").cast("int"), _strand(F.col("orientation")),
    ).alias("value"))


def write_lines(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Store formatted lines as text, one file per partition."""
    lines.select("value").write.mode(mode).text(path)


def write_bed(peaks: DataFrame, path: str, mode: str = "error") -> None:
    """Oriented peaks as BED6 in (chrom, start) order across the files."""
    ordered = peaks.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start")
    write_lines(oriented_bed_lines(ordered), path, mode)


__all__ = [
    "conserved_bed_lines", "oriented_bed_lines", "relative_bed_lines", "summit_bed_lines",
    "write_bed", "write_lines",
]
