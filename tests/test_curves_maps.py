"""Curves and maps against NumPy on dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromloom.operators import curves as C
from chromloom.operators import maps as M


def sparse(spark, m, cond="a"):
    n = len(m)
    rows = [(cond, i, j, float(m[i, j])) for i in range(n) for j in range(i, n) if m[i, j] != 0]
    return spark.createDataFrame(rows, "cond string, i int, j int, v double")


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(5)
    n = 70
    m = rng.poisson(40.0 / (1 + np.abs(np.subtract.outer(np.arange(n), np.arange(n)))) ** 0.8).astype(float)
    m = np.triu(m, 1)
    m[rng.random((n, n)) < 0.2] = 0
    return m + m.T


def test_ps_curve_counts_zero_cells(spark, dense):
    got = {r.d: r.p for r in C.ps_curve(sparse(spark, dense), ["cond"], 70).collect()}
    assert sorted(got) == list(range(70))
    for d in range(70):
        assert got[d] == pytest.approx(np.diagonal(dense, d).mean())


def test_derivative_equals_numpy(spark, dense):
    d = np.arange(1, 70)
    p = np.array([np.diagonal(dense, k).mean() for k in d])
    d, p = d[p > 0] * 1000.0, p[p > 0]
    lo, hi = max(5000.0, d.min()), min(2e6, d.max())
    grid = np.linspace(np.log10(lo), np.log10(hi), 80)
    y = np.interp(grid, np.log10(d), np.log10(p))
    x = np.arange(-4, 5)
    w = np.exp(-0.5 * (x / 0.8) ** 2)
    smooth = np.convolve(np.pad(y, 4, mode="reflect"), w / w.sum(), mode="valid")
    want = np.gradient(smooth, grid)
    curve = C.ps_curve(sparse(spark, dense), ["cond"], 70)
    got = [r.slope for r in C.ps_derivative(curve, ["cond"], 1000).orderBy("k").collect()]
    assert got == pytest.approx(want.tolist(), rel=1e-9)


def test_poly6_equals_least_squares(spark):
    rows = [("a", d, float(float(d) ** -1.2 + 0.01 * np.sin(d))) for d in range(1, 40)]
    curve = spark.createDataFrame(rows, "cond string, d int, p double")
    got = C.poly6_fit(curve, ["cond"], 100, hi_bp=2000).first()
    use = [r for r in rows if r[1] * 100 < 2000]
    want = np.polyfit(np.log10([r[1] * 100 for r in use]), np.log10([r[2] for r in use]), 6)
    assert got.n_points == 19 and got.coefficients == pytest.approx(want.tolist(), rel=1e-6)
    few = C.poly6_fit(curve, ["cond"], 100, hi_bp=700).first()
    assert few.coefficients is None


def test_powerlaw_recovers_exponent(spark):
    curve = spark.createDataFrame([("a", d, 3.0 * (d * 1000.0) ** -1.1) for d in range(1, 60)], "cond string, d int, p double")
    fit = C.powerlaw_fit(curve, ["cond"], 1000).first()
    assert fit.exponent == pytest.approx(1.1) and fit.log_intercept == pytest.approx(np.log10(3.0))
    assert C.powerlaw_fit(curve.where("d <= 3"), ["cond"], 1000).first().exponent is None


@pytest.mark.parametrize("w", [4, 9])
def test_insulation_equals_blocks(spark, dense, w):
    n = len(dense)
    got = {r.bin: r.score for r in M.insulation(sparse(spark, dense), ["cond"], n, w).collect()}
    assert sorted(got) == list(range(n))
    for b in range(n):
        if b < w or b >= n - w:
            assert got[b] is None
            continue
        cross = dense[b - w:b, b:b + w].mean()
        side = (dense[b - w:b, b - w:b].mean() + dense[b:b + w, b:b + w].mean()) / 2
        if cross > 0 and side > 0:
            assert got[b] == pytest.approx(np.log2(cross / side), abs=1e-9)
        else:
            assert got[b] is None


def test_insulation_of_empty_stretch_is_null(spark):
    df = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 38, 39, 1.0)], "cond string, i int, j int, v double")
    rows = M.insulation(df, ["cond"], 40, 5).collect()
    assert len(rows) == 40 and all(r.score is None for r in rows)


def test_comparison_equals_numpy(spark, dense):
    rng = np.random.default_rng(8)
    other = np.triu(np.maximum(dense + rng.integers(-3, 4, dense.shape), 0), 1)
    other = other + other.T
    n = len(dense)
    cells = M.join_maps(sparse(spark, dense), sparse(spark, other), ["cond"])
    iu = np.triu_indices(n, 1)
    a, b = dense[iu], other[iu]
    used = (a > 0) | (b > 0)
    r = M.overall_pearson(cells, ["cond"]).first().overall_pearson
    assert r == pytest.approx(np.corrcoef(a[used], b[used])[0, 1])
    kept = []
    for d in range(1, n):
        x, y = np.diagonal(dense, d), np.diagonal(other, d)
        if x.std() > 0 and y.std() > 0:
            kept.append(np.corrcoef(x, y)[0, 1])
    weights = n - np.arange(1, len(kept) + 1)
    s = M.scc(M.diag_pearson(cells, ["cond"], n), ["cond"], n).first()
    assert s.n_diagonals == len(kept)
    assert s.stratum_adjusted_corr == pytest.approx((weights * kept).sum() / weights.sum())


def test_balance_sets_unusable_bins_to_zero(spark):
    px = spark.createDataFrame([("a", 0, 1, 8.0), ("a", 1, 2, 8.0), ("a", 0, 2, 8.0)], "cond string, i int, j int, v double")
    bins = spark.createDataFrame([(0, 2.0), (1, None), (2, 0.0)], "bin int, KR double")
    got = {(r.i, r.j): r.v for r in M.balance(px, bins, ["cond"], "KR").collect()}
    assert got == {(0, 1): 0.0, (1, 2): 0.0, (0, 2): 0.0}
    times = {(r.i, r.j): r.v for r in M.balance(px, bins, ["cond"], "KR", divisive=False).collect()}
    assert times[(0, 2)] == 0.0


def test_colour_scale(spark, dense):
    got = M.colour_scale(sparse(spark, dense), ["cond"]).first()
    v = dense[np.triu_indices(len(dense))]
    assert [got.vmin, got.vmax] == pytest.approx(np.percentile(v[v > 0], [1, 98]).tolist())


def test_moving_average_matches_reflection(spark):
    y = [float(x) for x in np.random.default_rng(0).normal(size=30)]
    df = spark.createDataFrame([(y,)], "y array<double>")
    got = df.select(C.moving_average(F.col("y"), 5).alias("s")).first().s
    want = np.convolve(np.pad(y, 2, mode="reflect"), np.ones(5) / 5, mode="valid")
    assert got == pytest.approx(want.tolist())
    short = spark.createDataFrame([(y[:8],)], "y array<double>")
    assert short.select(C.moving_average(F.col("y"), 5).alias("s")).first().s == y[:8]
