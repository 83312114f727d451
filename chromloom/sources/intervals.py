"""Peaks, sites, elements, loops and motif hits from text files.

Every reader turns lines (one column ``value``, optional ``line`` order key) into rows, so the
same parser serves files and tables of lines. Malformed numbers become NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.functions.coords import bin_of, bins_spanned, in_bins, midpoint, overlaps
from chromloom.functions.text import strip

# fixed values: header names under which motif scanners give each column
MOTIF_COLUMNS = {
    "sequence_name": ("sequence_name", "sequence name"),
    "strand": ("strand",),
    "p-value": ("p-value", "p_value", "pvalue"),
    "start": ("start",),
    "stop": ("stop", "end"),
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with a key that follows their order inside a file."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line"),
    )


def _fields(lines: DataFrame, skip: Sequence[str], trim: bool) -> DataFrame:
    """Data lines split at tabs into ``f`` and counted in ``n_fields``."""
    v = F.col("value")
    keep = strip(v) != ""
    for prefix in skip:
        keep = keep & ~v.startswith(prefix)
    split = F.split(strip(v) if trim else v, "\t")
    return lines.where(keep).withColumn("f", split).withColumn("n_fields", F.size("f"))


def _at(k: int) -> Column:
    return F.get("f", F.lit(k))


def _int(k: int) -> Column:
    return strip(_at(k)).try_cast("int")


def _double(k: int) -> Column:
    return strip(_at(k)).try_cast("double")


def _carry(lines: DataFrame) -> list[str]:
    """Other columns of the lines table (file keys, order) that rows keep."""
    return [c for c in lines.columns if c not in ("value", "f", "n_fields")]


def parse_peaks(lines: DataFrame, region: tuple[str, int, int] | None = None) -> DataFrame:
    """narrowPeak or BED lines with defaults for missing columns and a summit.

    The summit is start + column 10 when that is a number, else the middle. A region keeps
    peaks touching it (closed).
    """
    rows = _fields(lines, ("#", "track"), True).where("n_fields >= 3").select(
        *_carry(lines), _at(0).alias("chrom"), _int(1).alias("start"), _int(2).alias("end"),
        F.when(F.col("n_fields") > 3, _at(3)).otherwise(".").alias("name"),
        F.when(F.col("n_fields") > 4, _double(4)).otherwise(F.lit(0.0)).alias("score"),
        F.when(F.col("n_fields") > 5, _at(5)).otherwise(".").alias("strand"),
        F.when(F.col("n_fields") >= 10, _int(9)).alias("_off"),
    ).where("start IS NOT NULL AND end IS NOT NULL")
    middle = midpoint(F.col("start"), F.col("end"))
    rows = rows.withColumn(
        "summit", F.coalesce(F.col("start") + F.col("_off"), middle).cast("int")
    ).drop("_off")
    return rows if region is None else in_region(rows, *region, closed=True)


def unreadable_lines(lines: DataFrame, least_fields: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """How many lines have too few fields or no whole-number ends, and so give no row: ``n_lines,
    n_bad`` for each of ``keys``. Comments and headers don't count as lines."""
    bad = (F.col("n_fields") < least_fields) | _int(1).isNull() | _int(2).isNull()
    return _fields(lines, ("#", "track"), True).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(bad).alias("n_bad")
    )


def in_region(df: DataFrame, chrom: str, start: int, end: int, closed: bool) -> DataFrame:
    return df.where(
        (F.col("chrom") == chrom) & overlaps(F.col("start"), F.col("end"), start, end, closed)
    )


def read_peaks(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    return parse_peaks(read_lines(spark, path), region)


def parse_signal_peaks(
    lines: DataFrame, chrom: str, start: int, end: int, resolution: int, span: str = "summit"
) -> DataFrame:
    """Bins of peaks overlapping a window (half-open) with their signal.

    Signal is column 7, else column 5, else 1, and 1 when not a number. ``span`` "summit" takes
    the bin of the summit (column 10 unless negative), "peak" every bin the peak overlaps.
    """
    n_bins = (end - start) // resolution
    rows = _fields(lines, ("#", "track", "browser"), False).where("n_fields >= 3").select(
        *_carry(lines), _at(0).alias("chrom"), _int(1).alias("start"), _int(2).alias("end"),
        F.when(F.col("n_fields") > 6, _double(6)).when(F.col("n_fields") > 4, _double(4)).alias("_s"),
        F.when(F.col("n_fields") > 9, _int(9)).alias("_off"),
    )
    rows = in_region(rows, chrom, start, end, closed=False).withColumn(
        "signal", F.coalesce("_s", F.lit(1.0))
    )
    if span == "peak":
        bins = bins_spanned(F.col("start"), F.col("end"), start, resolution, n_bins)
        placed = rows.withColumn("bin", F.explode(bins)).withColumn("bin", F.col("bin").cast("int"))
    else:
        middle = midpoint(F.col("start"), F.col("end"))
        summit = F.when(F.col("_off") >= 0, F.col("start") + F.col("_off")).otherwise(middle)
        placed = rows.withColumn("bin", bin_of(summit, start, resolution)).where(
            in_bins(F.col("bin"), n_bins)
        )
    return placed.drop("_s", "_off")


def parse_intervals(lines: DataFrame) -> DataFrame:
    """(chrom, start, end) of every line with whole-number ends; other lines are passed over."""
    return _fields(lines, ("#", "track", "browser"), False).select(
        *_carry(lines), _at(0).alias("chrom"), _int(1).alias("start"), _int(2).alias("end")
    ).where("start IS NOT NULL AND end IS NOT NULL")


def parse_oriented(lines: DataFrame, region: tuple[str, int, int] | None = None) -> DataFrame:
    """BED lines of at least six columns; score 0 when not a number."""
    rows = _fields(lines, ("#", "track"), True).where("n_fields >= 6").select(
        *_carry(lines), _at(0).alias("chrom"), _int(1).alias("start"), _int(2).alias("end"),
        _at(3).alias("name"), F.coalesce(_double(4), F.lit(0.0)).alias("score"), _at(5).alias("strand"),
    ).where("start IS NOT NULL AND end IS NOT NULL")
    return rows if region is None else in_region(rows, *region, closed=True)


def parse_checked(lines: DataFrame) -> DataFrame:
    """All data lines with the number of fields, unparsed numbers NULL, for quality checks."""
    return _fields(lines, ("#", "track"), True).select(
        *_carry(lines), "n_fields", _at(0).alias("chrom"), _int(1).alias("start"),
        _int(2).alias("end"), _at(5).alias("strand"),
    )


def load_sites(
    lines: DataFrame, chrom: str, region_start: int, n_bins: int, resolution: int
) -> DataFrame:
    """Sites of a locus from BED lines: bin of the middle and orientation (+ unless stated)."""
    rows = _fields(lines, ("#", "track"), True).where(
        (F.col("n_fields") >= 3) & (_at(0) == chrom)
    )
    bin_ = bin_of(midpoint(_int(1), _int(2)), region_start, resolution)
    strand = F.when(F.col("n_fields") > 5, _at(5)).otherwise("+")
    return rows.select(
        *_carry(lines), bin_.alias("bin"),
        F.when(strand == "+", 1).otherwise(-1).alias("ori"),
        F.when(F.col("n_fields") > 3, _at(3)).otherwise("").alias("name"),
    ).where(in_bins(F.col("bin"), n_bins))


def parse_elements(
    lines: DataFrame, chrom: str, start: int, end: int, resolution: int, n_bins: int
) -> DataFrame:
    """Bins of strandless elements touching the window, copies kept."""
    rows = _fields(lines, ("#", "track"), True).where("n_fields >= 3").select(
        *_carry(lines), _at(0).alias("chrom"), _int(1).alias("start"), _int(2).alias("end")
    )
    placed = in_region(rows, chrom, start, end, closed=True).withColumn(
        "bin", bin_of(midpoint(F.col("start"), F.col("end")), start, resolution)
    )
    return placed.where(in_bins(F.col("bin"), n_bins)).select(*_carry(lines), "bin")


def parse_loops(rows: DataFrame, chrom: str, region_start: int, n_bins: int, resolution: int) -> DataFrame:
    """Loops given in base pairs (chrom, anchor1, anchor2) as bins 0 <= a < b < n_bins."""
    a = bin_of(F.col("anchor1").try_cast("long"), region_start, resolution)
    b = bin_of(F.col("anchor2").try_cast("long"), region_start, resolution)
    return rows.where(F.col("chrom") == chrom).select(
        a.alias("anchor1"), b.alias("anchor2")
    ).where((F.col("anchor1") >= 0) & (F.col("anchor1") < F.col("anchor2")) & (F.col("anchor2") < n_bins))


def read_loops(spark: SparkSession, path: str, chrom: str, region_start: int, n_bins: int, resolution: int) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True)
    return parse_loops(rows, chrom, region_start, n_bins, resolution)


def parse_bedpe(lines: DataFrame) -> DataFrame:
    """The two anchors of every paired line."""
    names = ["chrom1", "start1", "end1", "chrom2", "start2", "end2"]
    casts = [_at(k) if k % 3 == 0 else _int(k) for k in range(6)]
    return _fields(lines, ("#",), True).where("n_fields >= 6").select(
        *_carry(lines), *[c.alias(n) for n, c in zip(names, casts)]
    ).where(F.coalesce("start1", "end1").isNotNull() & F.col("start2").isNotNull())


def motif_columns(header: Sequence[str]) -> dict[str, str] | None:
    """Which header field holds each needed column; None when one is missing."""
    plain = {h.strip().lstrip("#").lower().replace(" ", "_"): h for h in reversed(list(header))}
    found = {}
    for wanted, options in MOTIF_COLUMNS.items():
        hit = next((plain[o] for o in options if o in plain), None)
        if hit is None:
            return None
        found[wanted] = hit
    return found


def parse_motif_hits(rows: DataFrame) -> DataFrame:
    """Motif hits (sequence_name, strand, p, start, stop) from a table with any known header.

    Rows with unreadable numbers or another strand than + and - are passed over.
    """
    at = motif_columns(rows.columns)
    if at is None:
        raise ValueError(f"motif table lacks a needed column: {rows.columns}")
    carry = [c for c in rows.columns if c == "line"]
    return rows.select(
        *carry, F.col(f"`{at['sequence_name']}`").alias("sequence_name"),
        F.col(f"`{at['strand']}`").alias("strand"),
        F.col(f"`{at['p-value']}`").try_cast("double").alias("p"),
        F.col(f"`{at['start']}`").try_cast("int").alias("start"),
        F.col(f"`{at['stop']}`").try_cast("int").alias("stop"),
    ).where(
        F.col("strand").isin("+", "-") & F.col("p").isNotNull() & F.col("start").isNotNull()
        & F.col("stop").isNotNull()
    )
