"""Files on disk, stored stages, streaming restarts, summary files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromloom.catalog.registry import QUERIES
from chromloom.operators import contacts as K
from chromloom.operators import dynamics as D
from chromloom.plans import summary as P
from chromloom.session import shared_dir
from chromloom.sinks import bed, tables as out
from chromloom.sources import hic, intervals as I
from chromloom.sources import tables as S
from chromloom.sources.frames import read_frames
from chromloom.streaming import running_dwell, running_map


def test_narrowpeak_and_bed_round_trip(spark, tmp_path):
    src = tmp_path / "peaks.narrowPeak"
    src.write_text(
        "# note\ntrack x\n\nchr1\t100\t300\tp1\t7\t+\t9.5\t1\t1\t50\nchr1\t1000\t1200\tp2\t3\t-\t4\t1\t1\t-1\nchr1\t5\t9\n"
    )
    peaks = I.read_peaks(spark, str(src))
    assert [(r.name, r.summit, r.score, r.strand) for r in peaks.orderBy("start").collect()] == [
        (".", 7, 0.0, "."), ("p1", 150, 7.0, "+"), ("p2", 999, 3.0, "-")
    ]
    bins = I.parse_signal_peaks(I.read_lines(spark, str(src)), "chr1", 0, 2000, 100)
    assert {r.bin: r.signal for r in bins.collect()} == {1: 9.5, 11: 4.0, 0: 1.0}
    wide = I.parse_signal_peaks(I.read_lines(spark, str(src)), "chr1", 0, 2000, 100, span="peak")
    assert sorted(r.bin for r in wide.collect()) == [0, 1, 2, 10, 11]
    oriented = peaks.where("strand <> '.'").withColumn("orientation", F.when(F.col("strand") == "+", 1).otherwise(-1))
    bed.write_bed(oriented, str(tmp_path / "out"))
    back = I.parse_oriented(I.read_lines(spark, str(tmp_path / "out")))
    assert sorted((r.start, r.end, r.name, r.strand) for r in back.collect()) == [(100, 300, "p1", "+"), (1000, 1200, "p2", "-")]


def test_site_left_of_the_window_is_dropped(spark):
    lines = spark.createDataFrame([("chr1\t980\t1000\ta\t0\t+",), ("chr1\t1000\t1001\tb\t0\t-",), ("chr1\t1500\t1600",)], "value string")
    got = {(r.bin, r.ori, r.name) for r in I.load_sites(lines, "chr1", 1000, 3, 500).collect()}
    assert got == {(0, -1, "b"), (1, 1, "")}


def test_samplesheet(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text("Project\tCell \tPeaks\tHi-C\nP\t a \tx.bed\tNA\nP\tb\t.\ty.cool\n\t\t\t\n")
    got = {r.name: (r.Peaks, r["Hi-C"]) for r in S.read_samplesheet(spark, str(path), ["Project", "Cell"], ["Peaks", "Hi-C"]).collect()}
    assert got == {"P_a": ("x.bed", None), "P_b": (None, "y.cool")}
    with pytest.raises(ValueError, match="duplicate"):
        S.read_samplesheet(spark, str(path), ["Project"], ["Peaks"])
    with pytest.raises(ValueError, match="lacks"):
        S.read_samplesheet(spark, str(path), ["Cells"], ["Peaks"])


def test_windows_read_only_their_part_of_stored_pixels(spark, tmp_path):
    """Partitions are pruned by chromosome and block, row groups by both starts; no join is left."""
    bins = spark.range(600).selectExpr(
        "if(id < 400, 'c1', 'c2') AS chrom", "(id % 400) * 1000 AS start", "(id % 400) * 1000 + 1000 AS end", "id AS bin",
        "double(id % 5) AS weight", "if(id % 11 = 0, NULL, 1D + id % 3) AS KR")
    pixels = spark.range(60_000).selectExpr("id % 600 AS a", "pmod(xxhash64(id), 600) AS b").selectExpr("least(a, b) AS bin1", "greatest(a, b) AS bin2").groupBy(
        "bin1", "bin2").agg(F.count("*").alias("n"))
    path = str(tmp_path / "pixels")
    hic.store_pixels(pixels, bins, path, block=50_000)
    for chrom, start, end in (("c1", 60_000, 140_000), ("c1", 0, 400_000), ("c2", 50_500, 99_000), ("c2", 190_000, 260_000), ("none", 0, 10_000)):
        for column in (None, "weight", "KR"):
            args = (chrom, start, end, 1000, column)
            want = sorted(map(tuple, hic.hic_region(pixels, bins, *args).collect()))
            assert sorted(map(tuple, hic.stored_region(spark, path, *args, block=50_000).collect())) == want
    window = hic.stored_region(spark, path, "c1", 60_000, 140_000, 1000, "KR", block=50_000)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = window._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "Join" not in plan and "Exchange" not in plan and "weight1" not in plan
    pushed = plan[plan.index("PushedFilters"):]
    assert all(x in pushed for x in ("GreaterThanOrEqual(start1,60000)", "LessThan(start1,140000)", "GreaterThanOrEqual(start2,60000)", "LessThan(start2,140000)"))
    partition = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "chrom" in partition and "block" in partition
    read = window.select(F.input_file_name().alias("f")).distinct().collect()
    assert {tuple(r.f.split("/")[-3:-1]) for r in read} == {("chrom=c1", f"block={k}") for k in (1, 2)}


def test_sequences_cut_by_many_splits(spark, tmp_path):
    """Splits of a few hundred bytes: most begin inside a sequence, some hold several, some none."""
    rng = np.random.default_rng(6)
    want = {}
    for f in range(3):
        lines = ["loose line before any header"] if f == 0 else []
        for k in range(40):
            name, n = f"f{f}s{k}", int(rng.integers(0, 6)) if k % 7 else 400
            rows = ["A" * int(rng.integers(0, 70)) for _ in range(n)]
            want[name] = sum(map(len, rows))
            lines += [f">{name} of file {f}", *[f" {x}\t" for x in rows]]
        lines += [">", "ACGT"] if f == 2 else []
        (tmp_path / f"g{f}.fa").write_text("\n".join(lines) + ("\n" if f else ""))
    want[""] = 4
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    try:
        for split in (300, 4_000, 1 << 27):
            for k in keys:
                spark.conf.set(k, str(split))
            got = S.genome_sizes_from_fasta(spark, str(tmp_path))
            assert {r.chrom: r.size for r in got.collect()} == want and got.count() == len(want)
    finally:
        for k in keys:
            spark.conf.unset(k)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.fa").write_text("")
    assert S.genome_sizes_from_fasta(spark, str(tmp_path / "none")).collect() == []


def test_genome_sizes(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 first\nACGT\nAC\n>chr2\n\nACG\n")
    (tmp_path / "g.fa.fai").write_text("chr1\t6\t0\t4\t5\nchr2\t3\t9\t4\t5\n")
    want = {"chr1": 6, "chr2": 3}
    assert {r.chrom: r.size for r in S.genome_sizes_from_fasta(spark, str(tmp_path / "g.fa")).collect()} == want
    assert {r.chrom: r.size for r in S.read_genome_sizes(spark, str(tmp_path / "g.fa.fai")).collect()} == want


@pytest.mark.parametrize("sep", [",", "\t", ";"])
def test_experimental_curve(spark, tmp_path, sep):
    path = tmp_path / "m.csv"
    path.write_text(sep.join(['"DT_S"', '"msd_um2"']) + f"\n1{sep}0.5\nx{sep}2\n3{sep}0.9\n")
    got = [(r.dt_s, r.msd_um2) for r in S.read_experimental_msd(spark, str(path)).orderBy("dt_s").collect()]
    assert got == [(1.0, 0.5), (3.0, 0.9)]


def test_job_tables(spark, tmp_path):
    for name, s in (("rule_a_b", 3661.9), ("rule_c", 5.0)):
        (tmp_path / f"{name}.tsv").write_text(f"s\tmax_rss\n{s}\t10\n1\t20\n")
    jobs = S.read_job_benchmarks(spark, str(tmp_path)).select(
        "rule", "job", F.col("s").cast("double").alias("s"), F.col("max_rss").cast("double").alias("max_rss")
    )
    got = {(r.rule, r.job): (r.s, r.max_rss) for r in P.benchmark_summary(jobs).collect()}
    assert got == {("rule", "a_b"): ("1:01:01", 20.0), ("rule", "c"): ("0:00:05", 20.0)}


def test_balance_column_choice():
    assert hic.balance_column(["bin", "KR", "weight"], "auto") == "KR"
    assert hic.balance_column(["bin", "weight"], "auto") == "weight"
    assert hic.balance_column(["bin", "VC"], "VC") == "VC" and hic.balance_column(["bin"], False) is None
    with pytest.raises(ValueError, match="VC"):
        hic.balance_column(["bin", "VC"], "auto")


def test_stage_is_reused_and_partitions_replaced(spark, tmp_path):
    path, calls = str(tmp_path / "stage"), []

    def build(rows):
        calls.append(1)
        return spark.createDataFrame(rows, "locus string, condition string, replicate int, n long")

    first = [("l", "a", 0, 1), ("l", "b", 0, 2)]
    keys = ["locus", "condition", "replicate"]
    out.reuse_or_build(spark, path, lambda: build(first), keys)
    again = out.reuse_or_build(spark, path, lambda: build(first), keys)
    assert len(calls) == 1 and again.count() == 2
    out.store_stage(build([("l", "b", 0, 9)]), path, keys)
    assert {(r.condition, r.n) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 9)}


def test_frames_and_metric_tables_on_disk(spark, tmp_path):
    df = spark.createDataFrame(
        [("l", "c", 0, k, [(float(k), 0.0, 0.0)]) for k in range(3)],
        "locus string, condition string, replicate int, frame long, pos array<struct<x:float,y:float,z:float>>",
    )
    out.store_stage(df, str(tmp_path / "f"))
    got = read_frames(spark, str(tmp_path / "f")).where("condition = 'c'")
    assert got.schema["pos"].dataType.elementType["x"].dataType.simpleString() == "double" and got.count() == 3
    rows = spark.createDataFrame([("g", "m", 1.5)], "group string, metric string, value double")
    out.write_metric_table(rows, str(tmp_path / "csv"), ["group", "metric", "value"])
    out.write_metric_table(rows, str(tmp_path / "json"), ["metric", "value"], "json")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().value == "1.5"
    assert spark.read.json(str(tmp_path / "json")).first().metric == "m"


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_summary_from_files(spark, tmp_path):
    def put(name, payload):
        (tmp_path / name).write_text(payload if isinstance(payload, str) else json.dumps(payload))

    for rep in (0, 1):
        put(f"ctl_100blk_rep{rep}_loop_fractions.json", [{"label": "a/b", "looped_fraction": 0.1 + rep}])
        put(f"dep_100blk_rep{rep}_loop_fractions.json", [{"label": "a/b", "looped_fraction": 0.3 + rep}])
    put("ctl_100blk_pooled_ps_metrics.json", {"metrics": {"P(s=10kb)": 0.5, "dlogP_dlogs_at_5kb": -1, "bad": "x"}, "fit": {"exponent": 1.1}})
    put("ctl_100blk_pooled_calibration.json", {"nm_per_monomer": 50, "source": "hic"})
    put("ctl_100blk_pooled_apa_loops_quant.json", {"n_pairs": 2, "loops": [{"strength": 1}, {"strength": 3}]})
    put("ctl_100blk_pooled_metrics.json", "{not json")
    rows = P.build_summary(P.read_metric_json(spark, str(tmp_path)))
    pooled = {(r.group, r.metric): r.value for r in rows.where("replicate IS NULL AND value IS NOT NULL").collect()}
    assert pooled == {
        ("P(s)", "P(s=10kb)"): 0.5, ("P(s)_derivative", "dlogP_dlogs_at_5kb"): -1.0, ("P(s)", "fit_exponent"): 1.1,
        ("calibration", "nm_per_monomer"): 50.0, ("AbLE", "apa_n_pairs"): 2.0, ("AbLE", "apa_strength_median"): 2.0,
        ("AbLE", "apa_strength_mean"): 2.0, ("provenance", "n_pooled_conformations"): 100.0,
    }
    tests = P.significance(rows, n_boot=100)
    assert tests.count() == 2 and all(r.log10 for r in tests.collect())
    cell = {r.pair: r.cell for r in P.significance_cells(tests).collect()}["ctl vs dep"]
    assert " [log10] [" in cell and cell.endswith("n=2 vs 2")
    assert P.significance(rows, "vs_reference", "unknown", n_boot=100).select("cond_x").distinct().collect() == [("ctl",)]


def test_running_map_equals_batch_and_survives_a_repeat(spark, tmp_path):
    rows = [(f % 2, f, [(float((f * k) % 5), float(k % 3), 0.0) for k in range(8)]) for f in range(12)]
    df = spark.createDataFrame(rows, "rep int, frame int, pos array<struct<x:double,y:double,z:double>>")
    for k in range(3):
        df.where(f"frame % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "map")
    running_map.start_running_map(stream, path, str(tmp_path / "ck"), ["rep"], 8, 1.5).awaitTermination()
    want = sorted(map(tuple, K.contact_map(df, ["rep"], 8, 1.5).select("rep", "i", "j", "n", "n_sub").collect()))

    def got():
        return sorted(map(tuple, running_map.running_map(spark, path, ["rep"]).select("rep", "i", "j", "n", "n_sub").collect()))

    assert got() == want
    # a batch that runs again replaces its own counts
    again = spark.read.parquet(str(tmp_path / "in")).where("frame % 3 = 0")
    first = next(b for b in range(3) if spark.read.parquet(f"{path}/counts/batch={b}").agg(F.sum("n")).first()[0]
                 == K.count_contacts(again, ["rep"], 8, 1.5).agg(F.sum("n")).first()[0])
    running_map.write_batch(again, first, path, ["rep"], 8, 1.5)
    assert [r[:3] for r in got()] == [r[:3] for r in want]


def test_running_dwell_in_any_order(spark, tmp_path):
    hits = [bool((t * 7 // 3) % 4) for t in range(90)]
    df = spark.createDataFrame([("s", t, h) for t, h in enumerate(hits)], "series string, t long, hit boolean")
    for k in (2, 0, 1):  # later frames arrive first, and one batch holds two separate stretches
        part = df.where(f"int(t / 15) % 3 = {k}")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running_dwell.start_running_dwell(
        stream, str(tmp_path / "runs"), str(tmp_path / "ck"), ["series"], "t", F.col("hit")
    ).awaitTermination()
    runs = lambda **k: sorted((r.start, r.length) for r in running_dwell.running_runs(spark, str(tmp_path / "runs"), ["series"], **k).collect())
    got = runs()
    assert runs(chunk=3) == got == runs(chunk=1)
    want = sorted((r.start, r.length) for r in D.contact_runs(df, ["series"], "t", F.col("hit")).collect())
    assert got == want


@pytest.mark.parametrize("name", ["st1_running_contact_map", "st2_running_dwell"])
def test_streams_of_tables_stored_as_folders(spark, tmp_path, name):
    """A table may be one file or a folder of part files; the stream reads either."""
    for table in ("embeddings", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").repartition(7).write.parquet(str(tmp_path / f"{table}.parquet"))
    want, got = (QUERIES[name](spark, d).collect() for d in ("/root/testdata/sf0.001", str(tmp_path)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
