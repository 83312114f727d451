"""Inputs larger than the map, groups of any size, short last bins, typed timings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromloom.catalog.registry import ORACLES, QUERIES
from chromloom.operators import contacts, curves, maps, sites, stats
from chromloom.plans import summary
from chromloom.plans.condition_report import quick_report
from chromloom.sources import hic, intervals
from chromloom.sources.tables import read_job_benchmarks


def pixels(spark, n, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(
        [("m", i, j, float(scale * rng.uniform(0.1, 1) / (1 + j - i))) for i in range(n) for j in range(i, n)], "k string, i int, j int, v double")


def test_larger_experimental_map_is_cropped(spark):
    sim, exp = pixels(spark, 12, 1), pixels(spark, 18, 2)
    cut = exp.where("j < 12")
    a = maps.compare_maps(sim, exp, ["k"], 12, 1000, window=2).first().asDict()
    b = maps.compare_maps(sim, cut, ["k"], 12, 1000, window=2).first().asDict()
    assert a == pytest.approx(b, nan_ok=True) and -1 <= a["mean_diag_pearson"] <= 1 and -1 <= a["overall_pearson"] <= 1
    assert curves.ps_curve(exp, ["k"], 12).count() == 12
    assert sorted(map(tuple, maps.insulation(exp, ["k"], 12, 2).collect())) == sorted(map(tuple, maps.insulation(cut, ["k"], 12, 2).collect()))
    runs = sim.withColumn("target", F.lit("r"))
    q = lambda e: quick_report(runs, e.withColumn("reference", F.lit("r")).drop("k"), ["k"], 12, 1000, 2).first().asDict()
    assert q(exp) == pytest.approx(q(cut))


def test_longer_chains_book_no_contacts_elsewhere(spark):
    rows = []
    for m, n in (("a", 9), ("b", 5), ("c", 14)):
        for frame in range(4):
            rng = np.random.default_rng(frame * 7 + n)
            pos = [tuple(map(float, p)) for p in rng.uniform(0, 4, (n, 3))]
            if frame == 2:
                pos[1] = (float("nan"), 0.0, 0.0)
            rows.append((m, frame, pos))
    frames = spark.createDataFrame(rows, "m string, frame long, pos array<struct<x:double,y:double,z:double>>")
    want = {}
    for m, _, pos in rows:
        for j in range(min(7, len(pos))):
            for i in range(j):
                if np.linalg.norm(np.subtract(pos[i], pos[j])) <= 1.5:
                    want[m, i, j] = want.get((m, i, j), 0) + 1
    for strategy in ("kernel", "grid"):
        got = contacts.count_contacts(frames, ["m"], 7, 1.5, strategy=strategy).collect()
        assert {(r.m, r.i, r.j): r.n for r in got} == want


def test_far_coordinates_are_refused(spark):
    frames = spark.createDataFrame([("a", 0, [(0.0, 0.0, 0.0), (1e9, 1e9, 1e9)])], "m string, frame long, pos array<struct<x:double,y:double,z:double>>")
    with pytest.raises(Exception, match="too far apart"):
        contacts.count_contacts(frames, ["m"], 7, 0.5).collect()


def test_permutation_of_groups_of_any_size(spark):
    rng = np.random.default_rng(3)
    sizes = {"a": 9, "b": 9, "c": 3, "d": 2}
    rows = [("x", c, k, float(v)) for c, n in sizes.items() for k, v in enumerate(rng.normal(size=n))]
    pairs = stats.condition_pairs(spark.createDataFrame(rows, "metric string, cond string, rep int, value double"), ["metric"])
    got = {(r.cond_x, r.cond_y): r for r in stats.permutation_test(pairs, ["metric"]).collect()}
    assert len(got) == 12
    assert not got["a", "b"].exact and got["a", "b"].n_perm == stats.N_RESAMPLES
    assert got["a", "c"].exact and got["a", "c"].n_perm == 220 and got["c", "d"].n_perm == 10
    kernel = {(r.cond_x, r.cond_y): r for r in stats.resampling_tests(pairs).collect()}
    for k, r in got.items():
        assert (r.p_perm, r.n_perm, r.exact) == pytest.approx((kernel[k].p_perm, kernel[k].n_perm, kernel[k].exact))


def test_short_last_bin_and_window_end(spark):
    bins = spark.createDataFrame([("c1", k * 1000, min(3500, k * 1000 + 1000), k) for k in range(4)] + [("c2", 0, 1000, 4), ("c2", 1000, 1200, 5)],
                                 "chrom string, start long, end long, bin long")
    assert hic.resolution_check(bins, 1000).first().ok and not hic.resolution_check(bins, 500).first().ok
    wide = bins.union(spark.createDataFrame([("c3", 0, 1000, 6), ("c3", 1000, 3000, 7)], bins.schema))
    assert not hic.resolution_check(wide, 1000).first().ok
    pixels_ = spark.createDataFrame([(a, b, 1) for a in range(4) for b in range(a, 4)], "bin1 long, bin2 long, n long")
    got = hic.hic_region(pixels_, bins, "c1", 0, 3500, 1000).agg(F.max("j")).first()[0]
    assert got == 2  # 3500 // 1000 bins: the half bin at the end is left out


def test_job_timings_end_to_end(spark, tmp_path):
    (tmp_path / "merge_run_1.tsv").write_text("s\th:m:s\tmax_rss\tio_in\n3725.5\t1:02:05\t100.5\t-\n12.0\t0:00:12\t300.25\tNA\n")
    out = summary.benchmark_summary(read_job_benchmarks(spark, str(tmp_path))).first()
    assert (out.rule, out.job, out.s, out.max_rss, out.io_in) == ("merge", "run_1", "1:02:05", 300.25, None)


def test_unreadable_peak_lines_are_counted(spark):
    lines = spark.createDataFrame([("chr1\t1\t5",), ("chr1\tx\t5",), ("chr1\t1",), ("# note",), ("chr2\t1\t9\tn\t3",)], "value string")
    assert tuple(intervals.unreadable_lines(lines).first()) == (4, 2)
    assert intervals.parse_peaks(lines).count() == 2


def test_harvest_keeps_json_types(spark):
    body = '{"metrics": {"a": 1.5, "b": "2.5", "c": true, "dlogP_dlogs_at_10kb": -1, "n": null}, "fit": {"exponent": "3", "log_intercept": 4}}'
    files = spark.createDataFrame([("wt_5blk_pooled_ps_metrics.json", body), ("wt_6blk_pooled_ps_metrics.json", "no json")], "name string, value string")
    got = {(r.group, r.metric): r.value for r in summary.harvest(files).collect() if r.group != "provenance"}
    assert got == {("P(s)", "a"): 1.5, ("P(s)", "c"): 1.0, ("P(s)_derivative", "dlogP_dlogs_at_10kb"): -1.0, ("P(s)", "fit_log_intercept"): 4.0}


def greedy(cands, n):
    """The published choice, by walking all candidates."""
    chosen, used = [], set()
    for c in cands:
        if len(chosen) < n and not used & set(c[2:]):
            chosen.append(c)
            used |= set(c[2:])
    for c in cands:
        if len(chosen) < n and c not in chosen:
            chosen.append(c)
    return [c[2:] for c in chosen]


@pytest.mark.parametrize("n", [1, 2, 4])
def test_probe_pairs_equal_a_walk_over_all_candidates(spark, n):
    rng = np.random.default_rng(n)
    rows = {(k, int(rng.integers(0, 2)), float(rng.integers(0, 6)), int(a), int(b)) for k in range(30) for a, b in rng.integers(0, 9 if k % 2 else 30, (k * 4, 2)) if a < b}
    df = spark.createDataFrame(sorted(rows), "locus int, tier int, offset double, left int, right int")
    got = {}
    for r in sites.auto_probe_pairs(df, ["locus"], n).orderBy("locus", "place").collect():
        got.setdefault(r.locus, []).append((r.left, r.right))
    want = {}
    for k in {r[0] for r in rows}:
        want[k] = greedy(sorted(r[1:] for r in rows if r[0] == k), n)
    # a pair of anchors may be ranked twice here; the walk takes it as two candidates too
    assert got == want


def test_candidates_relax_step_by_step(spark):
    conserved = [("a", 5, 1), ("a", 20, -1), ("b", 5, 1)]
    every = [*conserved, ("b", 20, -1), ("c", 5, -1), ("c", 20, 1)]
    df = lambda rows: spark.createDataFrame(rows, "locus string, bin int, ori int")
    got = sites.relaxed_candidates(df(conserved), df(every), ["locus"], 12, 5, 40).collect()
    assert {(r.locus, r.step, r.left, r.right) for r in got} == {("a", 1, 5, 20), ("b", 2, 5, 20), ("c", 3, 5, 20)}
    lonely = df([*every, ("d", 5, 1)])
    assert sites.relaxed_candidates(df(conserved), lonely, ["locus"], 12, 5, 40, strict=False).count() == 3
    with pytest.raises(Exception, match="no pair of sites fits"):
        sites.relaxed_candidates(df(conserved), lonely, ["locus"], 12, 5, 40).collect()


def test_latest_pooled_of_keys_of_any_size(spark, tmp_path):
    """Most blocks first, whatever the keys; of several files the last path in text order."""
    import duckdb

    keys = [49, 9_000_048, 99, 899_949, 900_049, 8_829_099]  # 48 blocks for the second, 49 for the others
    spark.createDataFrame([(k, 7) for k in keys], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = [tuple(r) for r in QUERIES["win15_latest_pooled"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert con.execute(ORACLES["win15_latest_pooled"]).fetchall() == got == [(7, 49, "f999949")]


def test_able_tables_are_parsed_once(spark):
    """All kinds from one reading of the tables; numbers that Python writes as NaN cost no other."""
    body = '{"pair_labels": ["p"], "strength": {"p": {"a": 1, "b": NaN, "z": null}}, "center_mean": {"p": {"a": 2}}, "background_mean": 5}'
    files = spark.createDataFrame([(body,), ("{broken",), (None,)], "value string")
    out = summary.harvest_able_table(files)
    assert {tuple(r) for r in out.collect()} == {("a", "AbLE", "able_strength[p]", 1.0), ("a", "AbLE", "able_center[p]", 2.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("from_json") == 1
