"""Genome and locus coordinates as column expressions.

Bins use floor division: truncation would put positions just left of a window into bin 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def midpoint(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2)


def bin_of(position: Column, region_start, resolution) -> Column:
    """Bin of a position counted from the window start; may be negative outside."""
    return F.floor((position - as_col(region_start)) / as_col(resolution)).cast("int")


def bp_of(bin_: Column, region_start, resolution) -> Column:
    """Base pair at the centre of a bin."""
    res = as_col(resolution)
    return (as_col(region_start) + bin_ * res + F.floor(res / 2)).cast("long")


def in_bins(bin_: Column, n_bins) -> Column:
    return (bin_ >= 0) & (bin_ < as_col(n_bins))


def bins_spanned(start: Column, end: Column, region_start, resolution, n_bins) -> Column:
    """Array of every bin a half-open interval overlaps, clamped to the window."""
    res, n = as_col(resolution), as_col(n_bins)
    first = F.greatest(F.lit(0), F.floor((start - as_col(region_start)) / res))
    last = F.least(n - 1, F.floor((end - 1 - as_col(region_start)) / res))
    return F.when(first <= last, F.sequence(first, last)).otherwise(
        F.array().cast("array<bigint>")
    )


def overlaps(start: Column, end: Column, lo, hi, closed: bool) -> Column:
    """Whether an interval meets a window; ``closed`` also accepts touching ends."""
    lo, hi = as_col(lo), as_col(hi)
    return (end >= lo) & (start <= hi) if closed else (end > lo) & (start < hi)


def parse_region(text: Column) -> Column:
    """``chr:start-end``, commas allowed, as a struct."""
    plain = F.regexp_replace(text, ",", "")
    pattern = r"^([^:]+):(\d+)-(\d+)$"
    return F.struct(
        F.regexp_extract(plain, pattern, 1).alias("chrom"),
        F.regexp_extract(plain, pattern, 2).try_cast("long").alias("start"),
        F.regexp_extract(plain, pattern, 3).try_cast("long").alias("end"),
    )


def parse_run_name(name: Column) -> Column:
    """(condition, replicate) of a run name; replicate -1 when the name carries none."""
    plain = F.regexp_replace(name, r"^merged_", "")
    pattern = r"^(.+)_rep(\d+)$"
    hit = F.regexp_extract(plain, pattern, 2)
    return F.struct(
        F.when(hit == "", plain).otherwise(F.regexp_extract(plain, pattern, 1)).alias("condition"),
        F.when(hit == "", F.lit(-1)).otherwise(hit.try_cast("int")).alias("replicate"),
    )


def is_shard(name: Column) -> Column:
    return name.rlike(r"_shard\d+$")


def output_prefix(run: Column, n_blocks: Column) -> Column:
    """Prefix of a run's outputs: condition, frames and replicate, or the plain name and frames."""
    parts = parse_run_name(run)
    blocks = F.concat(n_blocks.cast("string"), F.lit("blk"))
    with_rep = F.concat_ws(
        "_", parts["condition"], blocks, F.concat(F.lit("rep"), parts["replicate"].cast("string"))
    )
    return F.when(parts["replicate"] < 0, F.concat_ws("_", run, blocks)).otherwise(with_rep)


def other_chrom_style(chrom: Column) -> Column:
    """The same chromosome in the other naming style: chr7 and 7."""
    return F.when(chrom.startswith("chr"), F.substring(chrom, 4, 1_000)).otherwise(
        F.concat(F.lit("chr"), chrom)
    )


def tiling(start: Column, end: Column, resolution: int, padding: int, chain_size: int) -> Column:
    """Tile size, number of copies and chain length of a locus; no copies means it is too long."""
    n = F.floor((end - start) / resolution)
    tile = n + 2 * padding
    copies = F.floor(F.lit(chain_size) / tile)
    return F.struct(
        n.cast("int").alias("n_bins"), tile.cast("int").alias("tile_size"),
        copies.cast("int").alias("n_tiles"), (copies * tile).cast("int").alias("chain_size"),
        (copies >= 1).alias("fits"),
    )


def tile_positions(bin_: Column, tile_size: int, padding: int, n_tiles: int) -> Column:
    """Array of the chain positions of a locus bin, one per copy."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_tiles - 1)), lambda k: k * tile_size + padding + bin_
    )


def fractional_bin(start: Column, end: Column, window_start, resolution) -> Column:
    """Unrounded bin of the (whole-number) midpoint of an interval."""
    return (midpoint(start, end) - as_col(window_start)) / as_col(resolution)


def window_for_loop(a: Column, b: Column, chrom_size: Column, resolution: int, min_flank: int = 250_000) -> Column:
    """Window around a loop: flank of at least ``min_flank`` or half the loop, rounded outward to
    the grid and clamped to the chromosome."""
    flank = F.greatest(F.lit(float(min_flank)), (b - a) / 2.0)
    lo = F.floor((a - flank) / resolution) * resolution
    hi = F.ceil((b + flank) / resolution) * resolution
    top = F.floor(chrom_size / resolution) * resolution
    return F.struct(
        F.greatest(F.lit(0), lo).cast("long").alias("start"),
        F.least(top, hi).cast("long").alias("end"),
    )


def extrusion_scales(lifetime: Column, separation: Column, chain_size: Column, speed: Column) -> Column:
    """Processivity, number of cohesins and coverage; the last two NULL without cohesin."""
    processivity = lifetime * speed
    return F.struct(
        processivity.cast("double").alias("processivity"),
        F.floor(F.try_divide(chain_size.cast("double"), separation.cast("double"))).cast("long").alias("cohesins"),
        F.try_divide(2.0 * processivity, separation.cast("double")).alias("coverage"),
    )
