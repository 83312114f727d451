"""Loop scores on synthetic maps with a known peak."""

import numpy as np
import pytest

from chromloom.functions.kernels import gaussian_blur, local_maxima
from chromloom.operators import loops as L

N = 200


def curve_rows():
    return [("m", d, 1.0 / max(d, 1)) for d in range(N)]


def peaked(amplitude, centre=(80, 120), sigma=3.0, background=1.0):
    i, j = np.mgrid[0:N, 0:N]
    ps = np.array([r[2] for r in curve_rows()])
    m = background * ps[np.abs(i - j)]
    g = amplitude * np.exp(-((i - centre[0]) ** 2 + (j - centre[1]) ** 2) / (2 * sigma**2))
    return m + g + g.T


def run(spark, m, loops, **kw):
    rows = [("m", i, j, float(m[i, j])) for i in range(N) for j in range(i, N)]
    px = spark.createDataFrame(rows, "map string, i int, j int, v double")
    lp = spark.createDataFrame([("m", a, b) for a, b in loops], "map string, anchor1 int, anchor2 int")
    curve = spark.createDataFrame(curve_rows(), "map string, d int, p double")
    return px, lp, curve, L.able_score(px, lp, curve, ["map"], N, **kw).orderBy("anchor1").collect()


def test_score_is_the_volume_of_the_peak(spark):
    _, _, _, rows = run(spark, peaked(5.0), [(80, 120)])
    assert rows[0].strength == pytest.approx(2 * np.pi * 5 * 9, rel=0.10)
    assert rows[0].c_best_fit == pytest.approx(1.0, rel=0.1)
    assert rows[0].n_pixels == 317


def test_score_is_zero_without_a_peak(spark):
    _, _, _, rows = run(spark, peaked(0.0), [(80, 120)])
    assert abs(rows[0].strength) < 1e-3


def test_score_is_linear_in_amplitude(spark):
    s = [run(spark, peaked(a), [(80, 120)])[3][0].strength for a in (1.0, 2.0, 4.0)]
    assert s[1] / s[0] == pytest.approx(2, rel=0.05) and s[2] / s[0] == pytest.approx(4, rel=0.05)


def test_neighbouring_loop_is_found(spark):
    m = peaked(5.0) + peaked(10.0, (95, 105), background=0.0)
    _, _, _, rows = run(spark, m, [(80, 120)], sigma=5.0, outlier_radius=8.0, diag_cutoff=3)
    assert rows[0].n_outliers >= 1


def test_one_result_per_loop_and_copies_counted(spark):
    _, _, _, rows = run(spark, peaked(5.0), [(60, 100), (90, 130), (90, 130)])
    assert [(r.anchor1, r.copies) for r in rows] == [(60, 1), (90, 2)]


def test_linear_form_equals_kernel(spark):
    px, lp, curve, rows = run(spark, peaked(5.0), [(60, 100), (80, 120), (90, 130)], outliers=False)
    lin = L.able_linear(px, lp, curve, ["map"], N).orderBy("anchor1").collect()
    for a, b in zip(rows, lin):
        assert b.strength == pytest.approx(a.strength, rel=1e-9)
        assert b.c_best_fit == pytest.approx(a.c_best_fit, rel=1e-12)


def test_window_off_the_edge(spark):
    _, _, _, rows = run(spark, peaked(0.0), [(3, 60), (30, 70)], outliers=False)
    assert rows[0].strength is None  # the edge is within five bins of the centre
    assert rows[1].strength == pytest.approx(0.0, abs=1e-6) and rows[1].fill == pytest.approx(1.0)


def test_blur_and_maxima():
    img = np.random.default_rng(1).normal(size=(41, 41))
    half = 8
    x = np.arange(-half, half + 1)
    k = np.exp(-0.5 * (x / 5.0) ** 2)
    k /= k.sum()
    pad = np.pad(img, half, mode="symmetric")
    want = np.zeros_like(img)
    for r in range(41):
        for c in range(41):
            want[r, c] = k @ pad[r:r + 17, c:c + 17] @ k
    assert np.allclose(gaussian_blur(img, 5.0, 1.5), want)
    got = local_maxima(img)
    for r in range(41):
        for c in range(41):
            near = [
                img[r + a, c + b] for a in range(-2, 3) for b in range(-2, 3)
                if abs(a) + abs(b) < 4 and 0 <= r + a < 41 and 0 <= c + b < 41
            ]
            assert got[r, c] == (img[r, c] == max(near))


def test_pileup_equals_mean_of_windows(spark):
    m = np.triu(np.random.default_rng(2).poisson(2.0, (N, N)), 1).astype(float)
    m = m + m.T
    loops = [(30, 60), (30, 60), (50, 58), (3, 40), (100, 197)]
    rows = [("m", i, j, float(m[i, j])) for i in range(N) for j in range(i + 1, N) if m[i, j]]
    px = spark.createDataFrame(rows, "map string, i int, j int, v double")
    lp = spark.createDataFrame([("m", a, b) for a, b in loops], "map string, anchor1 int, anchor2 int")
    got = {(r.di, r.dj): r for r in L.apa_pileup(px, lp, ["map"], N, pad=5).collect()}
    inside = [(a, b) for a, b in loops if a >= 5 and b + 6 <= N]
    want = np.mean([m[a - 5:a + 6, b - 5:b + 6] for a, b in inside], axis=0)
    assert len(got) == 121 and got[(0, 0)].n_used == len(inside) == 3
    for (di, dj), r in got.items():
        assert r.v == pytest.approx(want[di + 5, dj + 5])
