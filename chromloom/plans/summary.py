"""Summary of all metrics: harvest of result files, pivots, significance table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromloom.functions.numeric import ratio
from chromloom.functions.text import metric_key, range_label, stats_cell, table_cell
from chromloom.operators import stats

# fixed values of the published analysis: group order and harvested names
GROUP_ORDER = (
    "provenance", "calibration", "P(s)", "P(s)_derivative", "AbLE", "MSD", "dynamics", "sim_vs_exp",
)
FIT_NAMES = ("exponent", "log_intercept", "lower_bound_bp", "upper_bound_bp")
CALIBRATION_NAMES = ("nm_per_monomer", "sec_per_frame", "bp_per_monomer", "persistence_nm")
MSD_NAMES = {
    "alpha_fit": {"alpha": "alpha", "K_alpha": "K_alpha", "alpha_stderr": "alpha_stderr",
                  "log_K_alpha_stderr": "log_K_alpha_stderr"},
    "saturation_fit": {"J": "sat_J", "tau_c": "sat_tau_c", "alpha_sat": "sat_alpha"},
    "pair": {"sep_monomers": "sep_monomers"},
}
FILE_NAME = r"^(.+)_(\d+)blk_(pooled|rep(-?\d+))_(.+)\.json$"
STRING_MAP = T.MapType(T.StringType(), T.StringType())
LEAVES = "array<struct<group:string,metric:string,value:double>>"


def read_metric_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as (name, value)."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_name").alias("name"), "value"
    )


def parse_names(files: DataFrame) -> DataFrame:
    """Condition, blocks, replicate (NULL when pooled), artefact and pair label of result files.

    Files of other names, and unreadable ones, are left out.
    """
    suffix = F.regexp_extract("name", FILE_NAME, 5)
    label = F.regexp_extract(suffix, r"^msd_(.+)$", 1)
    return files.where(F.col("name").rlike(FILE_NAME)).select(
        "name", "value", F.regexp_extract("name", FILE_NAME, 1).alias("condition"),
        F.regexp_extract("name", FILE_NAME, 2).try_cast("long").alias("n_blocks"),
        F.regexp_extract("name", FILE_NAME, 4).try_cast("int").alias("replicate"),
        F.when(suffix.startswith("msd_"), "msd").otherwise(suffix).alias("artefact"),
        F.nullif(label, F.lit("")).alias("label"),
    )


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _leaf(value: Column) -> Column:
    """A JSON number, or a boolean as 1 or 0; quoted numbers are text and give NULL."""
    return F.when(F.schema_of_variant(value) != "STRING", F.try_variant_get(value, "$", "double"))


def _entries(json: Column, group: Column | str, key: Column | None = None) -> Column:
    """Numeric leaves of a flat JSON object as (group, metric, value) structs."""
    group = F.lit(group) if isinstance(group, str) else group
    found = F.map_entries(F.from_json(json, "map<string,variant>"))
    leaves = F.transform(found, lambda e: F.struct(
        group.alias("group"), (e["key"] if key is None else F.concat(key, e["key"])).alias("metric"),
        _leaf(e["value"]).alias("value"),
    ))
    return F.coalesce(leaves, F.array().cast(LEAVES))


def _named(json: Column, names: dict[str, Column], group: str) -> Column:
    parsed = F.try_parse_json(json)
    return F.array(*[
        F.struct(F.lit(group).alias("group"), metric.alias("metric"),
                 _leaf(F.try_variant_get(parsed, f"$.{name}", "variant")).alias("value"))
        for name, metric in names.items()
    ])


def harvest(files: DataFrame) -> DataFrame:
    """Numbers of all per-run result files as (condition, n_blocks, replicate, group, metric, value).

    One pass: each file yields the metrics of its kind; replicate NULL stands for pooled files.
    """
    v, label, kind = F.col("value"), F.col("label"), F.col("artefact")
    obj = lambda path: F.get_json_object(v, path)
    derivative = F.transform(
        _entries(obj("$.metrics"), "P(s)"),
        lambda e: F.struct(
            F.when(e["metric"].startswith("dlogP_dlogs_at_"), "P(s)_derivative").otherwise("P(s)").alias("group"),
            e["metric"].alias("metric"), e["value"].alias("value"),
        ),
    )
    curve = F.concat(
        derivative, _named(obj("$.fit"), {n: F.lit(f"fit_{n}") for n in FIT_NAMES}, "P(s)")
    )
    units = F.array(*[
        F.struct(F.lit("calibration").alias("group"), F.lit(n).alias("metric"),
                 _number(F.coalesce(obj(f"$.{n}"), obj(f"$.metadata.{n}"))).alias("value"))
        for n in CALIBRATION_NAMES
    ])
    pairs = F.from_json(v, "array<struct<label string, looped_fraction double>>")
    looped = F.transform(F.coalesce(pairs, F.array()), lambda e: F.struct(
        F.lit("dynamics").alias("group"), metric_key(F.lit("looped_fraction"), e["label"]).alias("metric"),
        e["looped_fraction"].alias("value"),
    ))
    msd = F.concat(*[
        _named(obj(f"$.{part}"), {n: metric_key(F.lit(out), label) for n, out in names.items()}, "MSD")
        for part, names in MSD_NAMES.items()
    ])
    # strengths of one file: a bounded list of loops
    strengths = F.filter(
        F.transform(
            F.coalesce(F.from_json(obj("$.loops"), "array<struct<strength double>>"), F.array()),
            lambda e: e["strength"],
        ),
        lambda s: s.isNotNull() & ~F.isnan(s),
    )
    ordered, n = F.sort_array(strengths), F.size(strengths)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    total = F.aggregate(strengths, F.lit(0.0), lambda s, x: s + x)
    apa = F.array(*[
        F.struct(F.lit("AbLE").alias("group"), F.lit(m).alias("metric"), c.alias("value"))
        for m, c in (
            ("apa_n_pairs", _number(obj("$.n_pairs"))), ("apa_strength_median", (low + high) / 2.0),
            ("apa_strength_mean", ratio(total, n)),
        )
    ])
    found = (
        F.when(kind == "ps_metrics", curve).when(kind == "calibration", units)
        .when(kind == "metrics", _entries(v, "sim_vs_exp")).when(kind == "loop_fractions", looped)
        .when(kind == "msd", msd).when(kind == "apa_loops_quant", apa)
    )
    blocks = F.array(F.struct(
        F.lit("provenance").alias("group"), F.lit("n_pooled_conformations").alias("metric"),
        F.col("n_blocks").cast("double").alias("value"),
    ))
    every = F.when((kind == "ps_metrics") & F.col("replicate").isNull(), F.concat(found, blocks)).otherwise(found)
    rows = parse_names(files).select("condition", "n_blocks", "replicate", F.explode(every).alias("m"))
    return rows.select("condition", "n_blocks", "replicate", "m.group", "m.metric", "m.value").where(
        F.col("value").isNotNull()
    )


def harvest_sources(files: DataFrame) -> DataFrame:
    """Text values: the calibration source of each pooled condition."""
    named = parse_names(files).where("artefact = 'calibration' AND replicate IS NULL")
    return named.select(
        "condition", F.lit("calibration").alias("group"), F.lit("source").alias("metric"),
        F.get_json_object("value", "$.source").alias("value_str"),
    ).where("value_str IS NOT NULL")


def harvest_derivative_table(tables: DataFrame) -> DataFrame:
    """Condition-level derivative table: numbers, and two-number windows as ``lo-hi`` text."""
    per = F.from_json(F.get_json_object("value", "$.table"), T.MapType(T.StringType(), T.StringType()))
    rows = tables.select(F.explode(per).alias("condition", "row")).select(
        "condition", F.explode(F.from_json("row", STRING_MAP)).alias("metric", "text")
    )
    pair = F.from_json("text", "array<double>")
    return rows.select(
        "condition", F.lit("P(s)_derivative").alias("group"), "metric",
        _number(F.col("text")).alias("value"), range_label(pair).alias("value_str"),
    ).where("value IS NOT NULL OR value_str IS NOT NULL")


def harvest_able_table(tables: DataFrame) -> DataFrame:
    """Condition-level loop scores: strength, centre and background per pair and condition."""
    kinds = {"strength": "able_strength", "center_mean": "able_center", "background_mean": "able_background"}
    nested = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
    schema = T.StructType([T.StructField(name, nested) for name in kinds])
    # one pass: every table is parsed once for all kinds
    parsed = tables.select(F.from_json("value", schema).alias("_t"))
    rows = parsed.select(
        F.inline(F.array(*[F.struct(F.lit(out).alias("kind"), F.col(f"_t.{name}").alias("pairs")) for name, out in kinds.items()]))
    ).select("kind", F.explode("pairs").alias("pair", "by")).select(
        metric_key(F.col("kind"), F.col("pair")).alias("metric"), F.explode("by").alias("condition", "value")
    )
    return rows.select("condition", F.lit("AbLE").alias("group"), "metric", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def harvest_msd_stats(tables: DataFrame) -> DataFrame:
    """Condition-level replicate summaries of fits: mean and standard error per pair."""
    summary = "struct<mean double, sem double, n double>"
    fields = {
        "alpha_summary": "alpha", "K_alpha_summary": "K_alpha", "log10_K_alpha_summary": "log10_K_alpha",
    }
    cell = "struct<" + ", ".join(f"{f}: {summary}" for f in fields) + ">"
    schema = f"map<string, struct<conditions: map<string, {cell}>>>"
    rows = tables.select(
        F.explode(F.from_json(F.get_json_object("value", "$.pairs"), schema)).alias("pair", "p")
    ).select("pair", F.explode("p.conditions").alias("condition", "c"))
    cells = []
    for field, name in fields.items():
        for stat in ("mean", "sem"):
            cells.append(F.struct(
                metric_key(F.lit(f"{name}_{stat}_perrep"), F.col("pair")).alias("metric"),
                F.col(f"c.{field}.{stat}").alias("value"),
            ))
    cells.append(F.struct(
        metric_key(F.lit("n_replicates_fit"), F.col("pair")).alias("metric"),
        F.col("c.alpha_summary.n").alias("value"),
    ))
    return rows.select("condition", F.explode(F.array(*cells)).alias("m")).select(
        "condition", F.lit("MSD").alias("group"), "m.metric", "m.value"
    ).where("value IS NOT NULL")


def group_place(group: Column) -> Column:
    """Place of a metric group in the fixed order; unknown groups come last."""
    at = F.array_position(F.array(*[F.lit(g) for g in GROUP_ORDER]), group)
    return F.when(at > 0, at).otherwise(len(GROUP_ORDER) + 1).cast("int")


def summary_pivot(metrics: DataFrame, conditions: Sequence[str], value: str = "value") -> DataFrame:
    """Metric by condition, one column per condition in the given order, with the group's place."""
    wide = metrics.groupBy("group", "metric").pivot("condition", list(conditions)).agg(F.first(value))
    return wide.withColumn("group_place", group_place(F.col("group")))


def per_replicate_pivot(metrics: DataFrame, columns: Sequence[tuple[str, int]]) -> DataFrame:
    """Metric by (condition, replicate); missing values stay empty in their own column."""
    names = [f"{c}_rep{r}" for c, r in columns]
    keyed = metrics.withColumn("_col", F.concat_ws("_rep", "condition", F.col("replicate").cast("string")))
    return keyed.groupBy("group", "metric").pivot("_col", names).agg(F.first("value"))


def pivot_columns(metrics: DataFrame) -> list[tuple[str, int]]:
    """Conditions and replicates that occur, in order: a short list that names output columns."""
    rows = metrics.where("replicate IS NOT NULL").select("condition", "replicate").distinct().orderBy(
        "condition", "replicate"
    ).collect()
    return [(r["condition"], r["replicate"]) for r in rows]


def formatted(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A pivot with its numbers as table cells."""
    return wide.select(*[
        table_cell(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in wide.columns
    ])


def significance(
    metrics: DataFrame, mode: str = "all_ordered", reference: str | None = None, n_boot: int = stats.N_RESAMPLES
) -> DataFrame:
    """Tests of every metric between conditions with at least two replicates on either side.

    An unknown reference falls back to the first condition by name.
    """
    vectors = metrics.where("replicate IS NOT NULL").select(
        "group", "metric", F.col("condition").alias("cond"), F.col("replicate").alias("rep"), "value"
    )
    if mode == "vs_reference":
        known = vectors.where(F.col("cond") == reference).limit(1).count() if reference else 0
        if not known:
            first = vectors.agg(F.min("cond").alias("c")).first()
            reference = first["c"] if first and first["c"] is not None else ""
    return stats.compare_conditions(vectors, ["group", "metric"], mode, reference, n_boot)


def significance_cells(tests: DataFrame) -> DataFrame:
    """(group, metric, pair, cell) rows of the significance table."""
    cell = stats_cell({
        "n_x": F.col("n_x"), "n_y": F.col("n_y"), "diff": F.col("diff_mean"), "lo": F.col("diff_lo"),
        "hi": F.col("diff_hi"), "d": F.col("cohens_d"), "p_welch": F.col("p_welch"),
        "p_mw": F.col("p_mw"), "p_perm": F.col("p_perm"), "log10": F.col("log10"),
    })
    return tests.select(
        "group", "metric", F.concat_ws(" vs ", "cond_x", "cond_y").alias("pair"), cell.alias("cell")
    )


def build_summary(files: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """All harvested metrics in one long table; pooled rows have no replicate."""
    rows = harvest(files).select("condition", "replicate", "group", "metric", "value").withColumn(
        "value_str", F.lit(None).cast("string")
    )
    none = F.lit(None)
    extra = [harvest_sources(files)]
    for name, reader in (
        ("derivative", harvest_derivative_table), ("able", harvest_able_table), ("msd_stats", harvest_msd_stats),
    ):
        if tables and name in tables:
            extra.append(reader(tables[name]))
    for e in extra:
        for c, kind in (("replicate", "int"), ("value", "double"), ("value_str", "string")):
            if c not in e.columns:
                e = e.withColumn(c, none.cast(kind))
        rows = rows.unionByName(e.select(rows.columns))
    return rows


def benchmark_summary(jobs: DataFrame, keys: Sequence[str] = ("rule", "job"), seconds: str = "s") -> DataFrame:
    """Largest value of every number per job, with the duration as h:mm:ss."""
    from chromloom.functions.text import hms

    numbers = [c for c, t in jobs.dtypes if c not in keys and t in ("int", "bigint", "double", "float")]
    top = jobs.groupBy(*keys).agg(*[F.max(c).alias(c) for c in numbers])
    return top.withColumn(seconds, hms(F.col(seconds)))
