"""Traces, runs, displacement and correlation against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chromloom.operators import dynamics as D


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(4)
    return {s: np.cumsum(rng.normal(size=(n, 3)), axis=0) for s, n in (("a", 157), ("b", 64), ("c", 9))}


def trace_of(spark, walk):
    rows = [
        (s, t, *[float(x) for x in p], float(np.linalg.norm(p))) for s, w in walk.items() for t, p in enumerate(w)
    ]
    return spark.createDataFrame(rows, "s string, t long, dx double, dy double, dz double, dist double")


@pytest.mark.parametrize("block", [8, 50, 1024])
def test_msd(spark, walk, block):
    got = {(r.s, r.lag): (r.msd, r.n) for r in D.msd(trace_of(spark, walk), ["s"], block=block).collect()}
    want = {}
    for s, w in walk.items():
        for lag in range(1, max(1, int(len(w) / 3)) + 1):
            gap = w[lag:] - w[:-lag]
            want[(s, lag)] = ((gap**2).sum(1).mean(), len(gap))
    assert got.keys() == want.keys()
    for k, (m, n) in want.items():
        assert got[k][0] == pytest.approx(m, rel=1e-12) and got[k][1] == n


@pytest.mark.parametrize("block", [16, 1024])
def test_autocorrelation(spark, walk, block):
    got = {(r.s, r.lag): r.c for r in D.autocorrelation(trace_of(spark, walk), ["s"], block=block).collect()}
    for s, w in walk.items():
        d = np.linalg.norm(w, axis=1)
        d = d - d.mean()
        for lag in range(0, max(1, int(len(w) / 3)) + 1):
            want = 1.0 if lag == 0 else (d[:-lag] * d[lag:]).mean() / d.var()
            assert got[(s, lag)] == pytest.approx(want, rel=1e-9)


def lag_sums(x, lag, product):
    """Sum and number of the pairs of known frames ``lag`` apart, one by one."""
    now, later = x[:-lag], x[lag:]
    part = (now * later).sum(1) if product else ((later - now) ** 2).sum(1)
    return np.nansum(part), int((~np.isnan(part)).sum())


@pytest.mark.parametrize("block, frames", [(1024, 50_000), (64, 5_000), (1024, 1025), (16, 17)])
def test_long_series_with_gaps(spark, block, frames):
    """Two stages of transforms against sums over pairs, at lags all over the range."""
    rng = np.random.default_rng(frames)
    walk = np.cumsum(rng.normal(size=(frames, 3)), axis=0) + 1e4
    walk[rng.random(frames) < 0.1] = np.nan
    walk[frames // 2:frames // 2 + frames // 20] = np.nan
    walk[[0, -1]] = walk[[0, -1]] * 0 + rng.normal(size=(2, 3)) + 1e4
    pdf = pd.DataFrame({"s": "long", "t": np.arange(frames), "dx": walk[:, 0], "dy": walk[:, 1], "dz": walk[:, 2]})
    df = spark.createDataFrame(pd.concat([pdf, pdf.head(5).assign(s="short")])).repartition(8)
    top = max(1, int(frames / 3))
    some = sorted({*range(1, min(40, top + 1)), *rng.integers(1, top + 1, 60).tolist(), top})
    got = {r.lag: (r.msd, r.n) for r in D.msd(df, ["s"], block=block).where("s = 'long'").collect()}
    assert max(got) <= top and all(lag in got or not lag_sums(walk, lag, False)[1] for lag in some)
    for lag in some:
        total, n = lag_sums(walk, lag, False)
        if n:
            assert got[lag][1] == n and got[lag][0] == pytest.approx(total / n, rel=1e-7)
    d = walk[:, :1]
    got = {r.lag: r.c for r in D.autocorrelation(df.withColumn("dist", F.nanvl("dx", F.lit(None))), ["s"], block=block).where("s = 'long'").collect()}
    centred = d - np.nanmean(d)
    for lag in some:
        total, n = lag_sums(centred, lag, True)
        if n:
            assert got[lag] == pytest.approx(total / n / np.nanvar(d), abs=1e-9)


def test_shuffle_grows_with_the_frames_only(spark):
    """The plan's exchanges carry blocks, residues and frequencies; none pairs blocks."""
    df = spark.range(4000).selectExpr("id AS t", "double(id % 7) AS dx", "double(id % 3) AS dy", "0D AS dz")
    plan = D.msd(df, [], block=64)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.replace("Join Inner, (_b", "") or plan.count("Join") <= 2
    assert D.msd(df, [], block=64).count() == 1333


def test_constant_series_has_zero_correlation(spark):
    df = spark.createDataFrame([("a", t, 2.0) for t in range(12)], "s string, t long, dist double")
    assert {r.c for r in D.autocorrelation(df, ["s"]).collect()} == {0.0}


@pytest.mark.parametrize("chunk", [1, 4, 7, 65536])
def test_runs_across_chunk_borders(spark, chunk):
    rng = np.random.default_rng(9)
    marks = {"a": rng.random(300) < 0.7, "b": np.ones(40, bool), "c": np.zeros(5, bool)}
    rows = [(s, t, bool(h)) for s, m in marks.items() for t, h in enumerate(m)]
    df = spark.createDataFrame(rows, "s string, t int, hit boolean")
    runs = D.contact_runs(df, ["s"], "t", F.col("hit"), chunk=chunk)
    got = sorted((r.s, r.start, r.length) for r in runs.collect())
    want = []
    for s, m in marks.items():
        edges = np.diff(np.concatenate([[0], m.astype(int), [0]]))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        want += [(s, int(a), int(b - a)) for a, b in zip(starts, ends)]
    assert got == sorted(want)
    stats = {r.s: r for r in D.dwell_stats(runs, ["s"], df.select("s").distinct()).collect()}
    lengths = [n for s, _, n in want if s == "a"]
    assert stats["a"].n_dwells == len(lengths) and stats["a"].median == np.median(lengths)
    assert stats["c"].n_dwells == 0 and stats["c"].mean is None


def test_gyration(spark):
    p = np.random.default_rng(6).normal(size=(20, 3))
    df = spark.createDataFrame(
        [(0, [tuple(float(x) for x in q) for q in p])], "f int, pos array<struct<x:double,y:double,z:double>>"
    )
    for lo, hi in ((0, None), (3, 11)):
        q = p[lo:hi]
        want = np.sqrt(((q - q.mean(0)) ** 2).sum(1).mean())
        assert D.radius_of_gyration(df, ["f"], lo, hi).first().rg == pytest.approx(want)


def test_histograms(spark):
    v = np.random.default_rng(7).integers(0, 40, 500) / 4.0
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("one", 5.0)] * 3, "g string, v double")
    rows = D.histogram(df, ["g"], "v", 60).collect()
    for key, values in (("a", v), ("one", np.full(3, 5.0))):
        n, edges = np.histogram(values, bins=60)
        dens, _ = np.histogram(values, bins=60, density=True)
        got = sorted([r for r in rows if r.g == key], key=lambda r: r.k)
        assert [r.n for r in got] == n.tolist()
        assert [r.density for r in got] == pytest.approx(dens.tolist())
        assert [r.center for r in got] == pytest.approx(((edges[1:] + edges[:-1]) / 2).tolist())


def test_looped_fraction_of_one_tile_has_no_error(spark):
    df = spark.createDataFrame([("p", 0, d) for d in (1.0, 3.0, 2.9)], "pair string, tile int, dist double")
    r = D.looped_fraction(df, ["pair"], "tile", 3.0).first()
    assert r.looped_fraction == pytest.approx(2 / 3) and r.sem == 0.0


def test_fit_matches_least_squares(spark):
    lags = np.arange(1, 101)
    y = 2.0 * lags**0.6 * np.exp(np.random.default_rng(3).normal(0, 0.05, 100))
    df = spark.createDataFrame([("a", int(t), float(m)) for t, m in zip(lags, y)], "s string, lag long, msd double")
    r = D.msd_powerlaw_fit(df, ["s"]).first()
    use = (lags >= 5) & (lags <= 25)
    (b, a), cov = np.polyfit(np.log10(lags[use]), np.log10(y[use]), 1, cov=True)
    assert (r.alpha, r.log_intercept, r.n_points) == (pytest.approx(b), pytest.approx(a), 21)
    assert r.alpha_stderr == pytest.approx(np.sqrt(cov[0, 0]))
    assert r.log_k_alpha_stderr == pytest.approx(np.sqrt(cov[1, 1]))


def test_saturation_recovers_parameters(spark):
    lags = np.arange(1, 400)
    rows = [("a", int(t), float(2 * 7.5 * (1 - np.exp(-((t / 30.0) ** 0.7))))) for t in lags]
    rows += [("b", int(t), 1.0) for t in range(1, 5)]
    df = spark.createDataFrame(rows, "s string, lag long, msd double")
    got = {r.s: r for r in D.msd_saturation_fit(df, ["s"]).collect()}
    assert got["a"].j == pytest.approx(7.5, rel=1e-3)
    assert got["a"].tau_c == pytest.approx(30, rel=1e-2) and got["a"].alpha_sat == pytest.approx(0.7, rel=1e-2)
    assert got["b"].j is None


def test_snapshot_score_and_coverage(spark):
    legs = spark.createDataFrame([(0, 2, 6), (0, 13, 15)], "snap int, l int, r int")
    loops = spark.createDataFrame([(2, 6)], "anchor1 int, anchor2 int")
    assert D.snapshot_scores(legs, loops, [], [0, 10], 0).first().looped == 0.5
    r = D.coverage_depth(legs, ["snap"], 20).first()
    assert r.mean_size == 3.0 and r.coverage == pytest.approx(0.3)
