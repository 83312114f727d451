"""Text helpers: labels, formatted cells, names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the published analysis
MISSING_TOKENS = ("", "na", "none", ".")
PLACEHOLDER_GENE_PREFIXES = ("Gm", "LOC", "Mir", "Snor", "Rik", "Rik-")
GENOME_TAGS = ("mm10", "mm39", "mm9", "hg38", "hg19", "GRCh38", "GRCh37", "GRCm38", "GRCm39")
LOG10_METRICS = (
    "K_alpha", "looped_fraction", "apa_strength_mean", "apa_strength_median", "apa_n_pairs",
)


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def missing_to_null(c: Column) -> Column:
    """Trimmed text, NULL for tokens that mean "no value"."""
    plain = strip(c)
    return F.when(~F.lower(plain).isin(*MISSING_TOKENS), plain)


def _formatter(spec: str):
    """Vectorised number format. The exact binary value decides ties, as in C; the JVM formatter
    works on the shortest decimal form and keeps trailing zeros, so it cannot express this."""

    @F.pandas_udf("string")
    def fmt(v: pd.Series) -> pd.Series:
        return pd.Series([format(x, spec) for x in v.to_numpy(dtype=float)], dtype=object)

    return fmt


def fixed(c: Column, places: int) -> Column:
    """Fixed number of decimals, NULL for NULL."""
    return F.when(c.isNotNull(), _formatter(f".{places}f")(c.cast("double")))


def general(c: Column, digits: int) -> Column:
    """Shortest form with ``digits`` significant digits: trailing zeros dropped, exponent when
    the number is below 1e-4 or has more whole digits than ``digits``. For small result tables."""
    return F.when(c.isNotNull(), _formatter(f".{digits}g")(c.cast("double")))


def table_cell(c: Column) -> Column:
    """Number as a table cell: four significant digits when large or tiny, else four decimals;
    empty when NULL."""
    size = F.abs(c)
    return (
        F.when(c.isNull(), "")
        .when((size >= 1e4) | ((size > 0) & (size < 1e-3)), general(c, 4))
        .otherwise(fixed(c, 4))
    )


def stats_cell(row: dict[str, Column]) -> Column:
    """Comparison of two conditions in one cell, empty when either side has no value.

    ``row`` names: n_x, n_y, diff, lo, hi, d, p_welch, p_mw, p_perm, log10 (boolean).
    """

    def short(name: str) -> Column:
        return F.coalesce(general(row[name], 3), F.lit("nan"))

    text = F.concat(
        short("diff"), F.when(row["log10"], F.lit(" [log10]")).otherwise(F.lit("")),
        F.lit(" ["), short("lo"), F.lit(", "), short("hi"), F.lit("], d="), short("d"),
        F.lit(", p_w="), short("p_welch"), F.lit("/p_mw="), short("p_mw"),
        F.lit("/p_perm="), short("p_perm"),
        F.lit(", n="), row["n_x"].cast("string"), F.lit(" vs "), row["n_y"].cast("string"),
    )
    return F.when((row["n_x"] == 0) | (row["n_y"] == 0), "").otherwise(text)


def human_bp(bp: Column) -> Column:
    """Distance label such as 10kb, 1.5Mb or 300bp."""

    def unit(size: float, name: str) -> Column:
        v = bp / size
        whole = F.abs(v - F.round(v)) < 1e-6
        return F.concat(
            F.when(whole, F.format_string("%.0f", v)).otherwise(general(v, 6)), F.lit(name)
        )

    return (
        F.when(bp >= 1_000_000, unit(1e6, "Mb"))
        .when(bp >= 1_000, unit(1e3, "kb"))
        .otherwise(F.concat(F.format_string("%.0f", bp.cast("double")), F.lit("bp")))
    )


def hms(seconds: Column) -> Column:
    """h:mm:ss of a duration, fractions of a second dropped."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def safe_label(c: Column) -> Column:
    """Label usable in a file name."""
    return F.translate(c, "/:", "__")


def gene_label(symbol: Column, accession: Column) -> Column:
    """Symbol, else accession, else a question mark."""

    def filled(c: Column) -> Column:
        return F.when(strip(c) != "", strip(c))

    return F.coalesce(filled(symbol), filled(accession), F.lit("?"))


def is_placeholder_gene(label: Column) -> Column:
    return label.rlike("^(" + "|".join(PLACEHOLDER_GENE_PREFIXES) + ")")


def genome_tag(path: Column) -> Column:
    """First known genome name in a file name, NULL if none."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return F.coalesce(*[F.when(name.contains(t.lower()), F.lit(t)) for t in GENOME_TAGS])


def uses_log10(metric: Column) -> Column:
    """Whether a metric is compared on a log scale."""
    return metric.rlike("|".join(LOG10_METRICS))


def range_label(values: Column) -> Column:
    """Two-number list as ``lo-hi``, NULL for other lists."""
    return F.when(
        F.size(values) == 2,
        F.concat_ws("-", general(F.get(values, F.lit(0)), 6), general(F.get(values, F.lit(1)), 6)),
    )


def metric_key(name: Column, label: Column) -> Column:
    """``name[label]``, or the plain name without a label."""
    return F.when(label.isNull(), name).otherwise(F.concat(name, F.lit("["), label, F.lit("]")))


def seed_of(base: Column, replicate: Column, shard: Column) -> Column:
    """Reproducible whole-number seed of a shard."""
    return base.cast("long") + replicate.cast("long") * 10_000 + shard.cast("long") * 1_000
