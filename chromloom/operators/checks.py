"""Input quality checks: one aggregate pass per check family, results as status rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromloom.functions.joins import attach
from chromloom.functions.coords import other_chrom_style, overlaps
from chromloom.functions.skew import percentiles


def interval_pairs(
    left: DataFrame, right: DataFrame, bucket: int, closed: bool = False,
    keys: Sequence[str] = ("chrom",),
) -> DataFrame:
    """Overlapping intervals of two tables on the same ``keys``; right columns get prefix r_.

    Intervals are copied to the buckets they touch and meet in an equi-join; a pair that shares
    several buckets is kept only in the first one.
    """
    keys = list(keys)

    def first(c: str) -> Column:
        return F.floor(F.col(c) / bucket)

    a = left.withColumn("_bk", F.explode(F.sequence(first("start"), first("end"))))
    renamed = right.select(
        *keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys]
    )
    b = renamed.withColumn("_bk", F.explode(F.sequence(first("r_start"), first("r_end"))))
    return (
        a.join(b, [*keys, "_bk"])
        .where(overlaps(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"), closed))
        .where(F.col("_bk") == F.greatest(first("start"), first("r_start")))
        .drop("_bk")
    )


def peaks_per_locus(peaks: DataFrame, loci: DataFrame, bucket: int = 100_000) -> DataFrame:
    """Peaks overlapping each locus window and its status; zero is a warning.

    Peaks are counted per start/end before the join, so copies cost one row.
    """
    counted = peaks.groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("copies"))
    windows = loci.select(
        "name", "chrom", F.col("region_start").alias("start"), F.col("region_end").alias("end")
    )
    hits = interval_pairs(counted, windows, bucket).groupBy(F.col("r_name").alias("name")).agg(
        F.sum("copies").alias("n")
    )
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    return loci.join(hits, "name", "left").select(
        "name", n.alias("n"), F.when(n > 0, "PASS").otherwise("WARN").alias("status")
    )


def bed_quality_report(
    lines: DataFrame, chrom: str, region_start: int, region_end: int, resolution: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Counts behind the checks of an oriented BED: one row per file with every measure.

    ``lines`` hold chrom, start, end, strand as parsed (NULL where a line could not be parsed)
    and n_fields. The upper median of widths is exact.
    """
    keys = list(keys)
    bad = (F.col("n_fields") < 6) | F.col("start").isNull() | F.col("end").isNull()
    good = ~bad
    here = good & (F.col("chrom") == chrom)
    summit = F.floor((F.col("start") + F.col("end")) / 2)
    inside = here & (summit >= region_start) & (summit < region_end)
    width = F.col("end") - F.col("start")
    bin_ = F.floor((summit - region_start) / resolution)

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    # bins are bounded by the window; counting per bin first keeps the distinct count small
    measured = lines.withColumn("_here", here).withColumn("_bin", F.when(inside, bin_)).groupBy(
        *keys, "_bin"
    ).agg(
        n(good).alias("sites"), n(bad).alias("bad_lines"), n(here).alias("on_chrom"),
        n(good & (F.col("chrom") != chrom)).alias("off_chrom"),
        n(here & ~F.col("strand").isin("+", "-")).alias("bad_strand"),
        n(here & (F.col("strand") == "+")).alias("plus"),
        n(here & (F.col("strand") == "-")).alias("minus"),
        n(inside).alias("in_window"), n(here & ~inside).alias("out_of_window"),
        n(here & (F.col("start") >= F.col("end"))).alias("start_not_before_end"),
        n(here & ~((width > 10) & (width < 10_000))).alias("odd_width"),
        F.min(F.when(here, width)).alias("width_min"), F.max(F.when(here, width)).alias("width_max"),
    )
    sums = [
        "sites", "bad_lines", "on_chrom", "off_chrom", "bad_strand", "plus", "minus", "in_window",
        "out_of_window", "start_not_before_end", "odd_width",
    ]
    n_bins = (region_end - region_start) // resolution
    report = measured.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min("width_min").alias("width_min"), F.max("width_max").alias("width_max"),
        F.coalesce(
            F.sum(F.when(F.col("_bin").isNotNull(), F.col("in_window") - 1)), F.lit(0).cast("long")
        ).alias("duplicate_bins"),
        (F.sum("in_window") / F.lit(n_bins / 100.0)).alias("per_100_bins"),
    )
    return report


def upper_median_width(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Width in the middle of the sorted widths, the upper one of two."""
    keys = list(keys)
    width = lines.select(*keys, (F.col("end") - F.col("start")).alias("w"))
    one = percentiles(width, keys, "w", [0.5])
    # the upper of two middle values is the smallest width not below their mean
    return (
        attach(width, one, keys).where(F.col("w") >= F.col("value"))
        .groupBy(*keys).agg(F.min("w").alias("width_median"))
    )


def status_rows(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The BED report as (keys, check, n, status) rows."""
    keys = list(keys)
    zero_fails = ["bad_lines", "bad_strand", "start_not_before_end"]
    zero_warns = ["off_chrom", "odd_width", "duplicate_bins"]
    need_some = ["on_chrom", "in_window"]
    rows = [
        F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n"),
                 F.when(F.col(c) == 0, "PASS").otherwise(other).alias("status"))
        for names, other in ((zero_fails, "FAIL"), (zero_warns, "WARN")) for c in names
    ] + [
        F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n"),
                 F.when(F.col(c) > 0, "PASS").otherwise("FAIL").alias("status"))
        for c in need_some
    ]
    return report.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def locus_checks(loci: DataFrame, sizes: DataFrame, resolution: int) -> DataFrame:
    """One row per locus: the first rule it breaks (NULL when fine) and the aligned window.

    Windows must be named uniquely without "/", have whole-number ends with 0 <= start < end on
    the resolution grid, and lie inside a known chromosome.
    """
    start, end = F.col("region_start").try_cast("long"), F.col("region_end").try_cast("long")
    names = loci.groupBy("name").agg(F.count(F.lit(1)).alias("_same"))
    size = sizes.select("chrom", F.col("size").alias("_size"))
    checked = loci.join(names, "name").join(size, "chrom", "left").withColumn("_s", start).withColumn("_e", end)
    problem = (
        F.when((F.col("_same") > 1) | F.col("name").contains("/"), "name")
        .when(F.col("_s").isNull() | F.col("_e").isNull(), "not whole numbers")
        .when((F.col("_s") < 0) | (F.col("_e") <= F.col("_s")), "empty window")
        .when((F.col("_s") % resolution != 0) | (F.col("_e") % resolution != 0), "off grid")
        .when(F.col("_size").isNull(), "unknown chromosome")
        .when(F.col("_e") > F.col("_size"), "past chromosome end")
    )
    return checked.select(
        "name", problem.alias("problem"),
        (F.floor(F.col("_s") / resolution) * resolution).alias("aligned_start"),
        (F.ceil(F.col("_e") / resolution) * resolution).alias("aligned_end"),
    )


def condition_checks(conditions: DataFrame) -> DataFrame:
    """First broken rule per condition: capture probability and peak feature options.

    Columns: name, capture_min, capture_max (equal for a single value), feature, peaks, span,
    factor; feature NULL when unused.
    """
    lo, hi = F.col("capture_min"), F.col("capture_max")
    used = F.col("feature").isNotNull()
    problem = (
        F.when(~((lo >= 0) & (lo <= hi) & (hi <= 1)), "capture")
        .when(used & F.col("peaks").isNull(), "peaks column")
        .when(used & ~F.coalesce(F.col("span"), F.lit("summit")).isin("summit", "peak"), "span")
        .when(used & ~(F.col("factor") > 0), "factor")
    )
    return conditions.select("name", problem.alias("problem"))


def factor_checks(factors: DataFrame, cross: DataFrame) -> DataFrame:
    """Conditions with repeated factor names, or cross pairs naming an unknown factor."""
    twice = factors.groupBy("name", "factor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "name", F.lit("repeated factor").alias("problem"), F.col("factor").alias("detail")
    )
    named = cross.select("name", F.explode(F.array("factor_a", "factor_b")).alias("factor")).distinct()
    unknown = named.join(factors.select("name", "factor").distinct(), ["name", "factor"], "left_anti").select(
        "name", F.lit("unknown factor").alias("problem"), F.col("factor").alias("detail")
    )
    return twice.unionByName(unknown)


def missing_samples(conditions: DataFrame, samples: DataFrame, column: str, file: str) -> DataFrame:
    """Conditions whose sample is absent, or present without the needed file."""
    known = samples.select(F.col("name").alias(column), F.col(file).alias("_file"), F.lit(True).alias("_known"))
    return conditions.where(F.col(column).isNotNull()).join(known, column, "left").where(
        F.col("_file").isNull()
    ).select(
        "name", column, F.when(F.col("_known"), "no file").otherwise("no sample").alias("problem")
    )


def feature_files(conditions: DataFrame, samples: DataFrame, features: Sequence[str]) -> DataFrame:
    """Peak file of every feature of a condition, from its own sample or that of its type.

    ``conditions`` hold per feature columns <feature>_column and <feature>_sample; ``samples``
    one row per sample with file columns.
    """
    parts = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}_column").alias("column"),
                 F.coalesce(f"{f}_sample", "ctcf_type").alias("sample"))
        for f in features
    ])
    asked = conditions.select("name", F.explode(parts).alias("_p")).select("name", "_p.*").where(
        F.col("column").isNotNull()
    )
    files = [c for c in samples.columns if c != "name"]
    long = samples.unpivot(["name"], files, "column", "file").withColumnRenamed("name", "sample")
    return asked.join(long, ["sample", "column"], "left").select(
        "name", "feature", "sample", "column", "file"
    )


def chromosome_checks(named: DataFrame, sizes: DataFrame) -> DataFrame:
    """Whether each (name, chrom, end) lies in a known chromosome, with a naming-style hint."""
    known = sizes.select("chrom", F.col("size").alias("_size"))
    other = sizes.select(F.col("chrom").alias("_alt"), F.lit(True).alias("_hint"))
    checked = named.join(known, "chrom", "left").withColumn(
        "_alt", other_chrom_style(F.col("chrom"))
    ).join(other, "_alt", "left")
    return checked.select(
        "name", "chrom",
        F.when(F.col("_size").isNull(), "FAIL").when(F.col("end") > F.col("_size"), "FAIL")
        .otherwise("PASS").alias("status"),
        F.when(F.col("_size").isNull() & F.coalesce("_hint", F.lit(False)), F.col("_alt")).alias("hint"),
    )


def peaks_past_end(peaks: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chromosomes whose last peak ends after the chromosome: peaks of another assembly."""
    last = peaks.groupBy(*keys, "chrom").agg(F.max("end").alias("last"))
    return last.join(sizes, "chrom").where(F.col("last") > F.col("size")).select(
        *keys, "chrom", "last", "size"
    )


def size_agreement(hic: DataFrame, genome: DataFrame) -> DataFrame:
    """Chromosome lengths of the Hi-C against those of the genome."""
    both = hic.select("chrom", F.col("size").alias("hic_size")).join(
        genome.select("chrom", F.col("size").alias("genome_size")), "chrom", "left"
    )
    return both.withColumn(
        "status",
        F.when(F.col("genome_size").isNull(), "WARN")
        .when(F.col("hic_size") == F.col("genome_size"), "PASS").otherwise("FAIL"),
    )


def input_check_report(
    loci: DataFrame, genome: DataFrame, peaks: DataFrame, hic: DataFrame, sample: str = "sample",
    bucket: int = 100_000,
) -> DataFrame:
    """All input checks as (check, subject, detail, status) rows.

    Loci must fit their chromosome; every sample needs peaks on a locus' chromosome (FAIL) and in
    its window (WARN); no peak may end past its chromosome; Hi-C and genome lengths must agree.
    """
    fit = chromosome_checks(
        loci.select("name", "chrom", F.col("region_end").alias("end")), genome
    ).select(F.lit("window").alias("check"), F.col("name").alias("subject"), F.col("chrom").alias("detail"), "status")
    counted = peaks.groupBy(sample, "chrom", "start", "end").agg(F.count(F.lit(1)).alias("copies"))
    windows = loci.select(
        "name", "chrom", F.col("region_start").alias("start"), F.col("region_end").alias("end")
    )
    inside = interval_pairs(counted, windows, bucket).groupBy(sample, F.col("r_name").alias("name")).agg(
        F.sum("copies").alias("_n")
    )
    listed = peaks.groupBy(sample, "chrom").agg(F.max("end").alias("_last"))
    names = listed.agg(F.sort_array(F.collect_set(sample)).alias("s"))
    grid = windows.select("name", "chrom").withColumn(sample, F.explode(names.scalar()))
    placed = (
        grid.join(listed, [sample, "chrom"], "left").join(inside, [sample, "name"], "left")
        .select(
            F.lit("peaks in window").alias("check"), F.col(sample).alias("subject"),
            F.col("name").alias("detail"),
            F.when(F.col("_last").isNull(), "FAIL").when(F.col("_n") > 0, "PASS").otherwise("WARN").alias("status"),
        )
    )
    past = listed.join(genome, "chrom", "left").groupBy(sample).agg(
        F.max(F.coalesce(F.col("_last") > F.col("size"), F.lit(False))).alias("_bad")
    ).select(
        F.lit("peaks inside chromosomes").alias("check"), F.col(sample).alias("subject"),
        F.lit("").alias("detail"), F.when(F.col("_bad"), "FAIL").otherwise("PASS").alias("status"),
    )
    lengths = size_agreement(hic, genome).select(
        F.lit("chromosome length").alias("check"), F.col("chrom").alias("subject"), F.lit("").alias("detail"), "status"
    )
    return fit.unionByName(placed).unionByName(past).unionByName(lengths)


def check_summary(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Numbers of passed, warned and failed checks."""
    return rows.groupBy(*keys).agg(*[
        F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in ("PASS", "WARN", "FAIL")
    ])


def chrom_counts(sites: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sites per chromosome, in total and by strand."""
    return sites.groupBy(*keys, "chrom").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("strand") == "+", 1)).alias("plus"),
        F.count(F.when(F.col("strand") == "-", 1)).alias("minus"),
    )
