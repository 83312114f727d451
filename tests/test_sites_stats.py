"""Site rules with hand values; statistics against NumPy and published table values."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromloom.functions.coords import tile_positions
from chromloom.functions.kernels import betainc, mann_whitney_counts, mann_whitney_p, student_two_sided
from chromloom.operators import motifs
from chromloom.operators import sites as S
from chromloom.operators import stats
from chromloom.sources.intervals import motif_columns


def test_tiles(spark):
    df = spark.createDataFrame([(0,), (5,)], "bin int")
    got = df.select(F.explode(tile_positions(F.col("bin"), 100, 10, 3)).alias("p"))
    assert sorted(r.p for r in got.collect()) == [10, 15, 110, 115, 210, 215]


@pytest.mark.parametrize("signals, lo, hi, want", [
    ([30.0, 10.0, 20.0], 0.2, 0.8, [0.8, 0.2, 0.5]), ([5.0, 5.0, 9.0], 0.0, 1.0, [0.25, 0.25, 1.0]),
    ([4.0], 0.0, 1.0, [0.5]), ([2.0, 2.0], 0.2, 0.4, [0.3, 0.3]),
])
def test_capture_by_rank(spark, signals, lo, hi, want):
    df = spark.createDataFrame([("t", k, s) for k, s in enumerate(signals)], "t string, k int, signal double")
    got = S.rank_capture(df, ["t"], "signal", lo, hi).orderBy("k").collect()
    assert [r.p for r in got] == pytest.approx(want)


def test_stalls_keep_the_highest(spark):
    df = spark.createDataFrame([(4, 1, 0.3), (4, 1, 0.7), (9, -1, 0.5)], "bin int, ori int, p double")
    assert {(r.bin, r.side, r.p) for r in S.stall_map(df, []).collect()} == {(4, "left", 0.7), (9, "right", 0.5)}


def test_factor_types_and_energies(spark):
    bound = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B"), (4, "B")], "bin int, factor string")
    types = S.factor_types(bound, [])
    assert {r.bin: (r.type_id, r.label) for r in types.collect()} == {1: (1, "A"), 2: (2, "A+B"), 4: (3, "B")}
    energies = spark.createDataFrame([("A", "A", 2.0), ("B", "B", 3.0), ("A", "B", 1.0)], "factor_a string, factor_b string, energy double")
    m = {(r.type_a, r.type_b): r.energy for r in S.interaction_matrix(types, energies, []).collect()}
    assert len(m) == 16 and m[(0, 2)] == 0.0 and m[(1, 1)] == 2.0 and m[(1, 3)] == 1.0 and m[(2, 2)] == 3.0
    assert all(m[(a, b)] == m[(b, a)] for a, b in m)


def test_pairs_at_any_distance(spark):
    rng = np.random.default_rng(0)
    rows = [("k", int(b), int(o)) for b, o in zip(rng.integers(0, 300, 80), rng.choice([-1, 1], 80))]
    df = spark.createDataFrame(rows, "k string, bin int, ori int")
    got = sorted((r.anchor1, r.anchor2) for r in S.convergent_pairs(df, ["k"], 20, 100).collect())
    want = sorted((a, b) for (_, a, o), (_, b, p) in itertools.product(rows, rows) if o == 1 and p == -1 and 20 <= b - a < 100)
    assert got == want


def test_probe_pairs_fill_up(spark):
    rows = [("l", 10, 40, 0, 1.0), ("l", 10, 50, 0, 2.0), ("l", 5, 40, 1, 3.0), ("m", 1, 2, 0, 0.0)]
    df = spark.createDataFrame(rows, "k string, left int, right int, tier int, offset double")
    got = sorted((r.k, r.place, r.left, r.right) for r in S.auto_probe_pairs(df, ["k"], 2).collect())
    assert got == [("l", 1, 10, 40), ("l", 2, 10, 50), ("m", 1, 1, 2)]


def test_motif_windows(spark):
    win = spark.createDataFrame(
        [("chr1_200", "chr1", 100, 300, 1), ("chr1_900", "chr1", 800, 1000, 2)],
        "name string, chrom string, start0 int, end int, key int",
    )
    hits = spark.createDataFrame([
        ("chr1_200::chr1:100-300", 5, 20, "+", 1e-4, 0), ("chr1:800-1000", 5, 20, "-", 1e-5, 1),
        ("chr1", 801, 820, "+", 1e-6, 2), ("chr1", 800, 820, "+", 1e-9, 3), ("chr2", 850, 860, "+", 1e-9, 4),
    ], "sequence_name string, start int, stop int, strand string, p double, line int")
    best = motifs.best_hit(motifs.match_hits(hits, win), ["key"])
    assert {r.key: (r.strand, r.p) for r in best.collect()} == {1: ("+", 1e-4), 2: ("+", 1e-6)}


def test_motif_header():
    names = ["#motif_id", "Sequence Name", "start", "End", "strand", "score", "p-value"]
    assert motif_columns(names)["stop"] == "End" and motif_columns(["start"]) is None


def test_t_distribution_table():
    # two-sided 5 % and 1 % points of the t distribution
    assert student_two_sided([12.706, 2.228, 1.960, 9.925], [1, 10, 1e7, 2]) == pytest.approx([0.05, 0.05, 0.05, 0.01], abs=2e-5)
    assert np.isnan(student_two_sided([np.nan], [3.0]))[0]
    assert betainc(2.0, 3.0, [0.0, 0.5, 1.0]) == pytest.approx([0.0, 0.6875, 1.0])


def test_mann_whitney():
    counts = mann_whitney_counts(3, 4)
    want = np.zeros(13)
    for pick in itertools.combinations(range(7), 3):
        want[sum(p - k for k, p in enumerate(pick))] += 1
    assert counts.tolist() == want.tolist()
    assert mann_whitney_p(9.0, 3, 3, np.array([])) == pytest.approx(0.1)
    assert mann_whitney_p(4.5, 3, 3, np.array([])) == 1.0


def test_battery(spark):
    rng = np.random.default_rng(12)
    data = {"a": rng.normal(1, 0.2, 5), "b": rng.normal(1.4, 0.2, 4)}
    rows = [("m", c, k, float(v)) for c, vs in data.items() for k, v in enumerate(vs)]
    rows += [("m", "b", 9, float("nan")), ("m", "c", 0, 1.0)]
    df = spark.createDataFrame(rows, "metric string, cond string, rep int, value double")
    out = {(r.cond_x, r.cond_y): r for r in stats.compare_conditions(df, n_boot=2000).collect()}
    assert set(out) == {("a", "b"), ("b", "a")}
    r, x, y = out[("a", "b")], data["a"], data["b"]
    va, vb = x.var(ddof=1) / 5, y.var(ddof=1) / 4
    assert r.t == pytest.approx((x.mean() - y.mean()) / np.sqrt(va + vb))
    assert r.df == pytest.approx((va + vb) ** 2 / (va**2 / 4 + vb**2 / 3))
    g = np.random.default_rng(0)
    d = x[g.integers(0, 5, (2000, 5))].mean(1) - y[g.integers(0, 4, (2000, 4))].mean(1)
    assert (r.diff_lo, r.diff_hi) == tuple(pytest.approx(v) for v in np.percentile(d, [2.5, 97.5]))
    joined, seen = np.concatenate([x, y]), []
    for pick in itertools.combinations(range(9), 5):
        rest = [k for k in range(9) if k not in pick]
        seen.append(abs(joined[list(pick)].mean() - joined[rest].mean()) >= abs(x.mean() - y.mean()) - 1e-12)
    assert r.n_perm == 126 and r.exact and r.p_perm == pytest.approx(np.mean(seen))


def test_monte_carlo_permutation_is_reproducible(spark):
    rng = np.random.default_rng(2)
    rows = [("m", c, k, float(v)) for c in "ab" for k, v in enumerate(rng.normal(size=12))]
    df = spark.createDataFrame(rows, "metric string, cond string, rep int, value double")
    r = stats.compare_conditions(df, n_boot=300).where("cond_x = 'a'").first()
    x = np.array([v for _, c, _, v in rows if c == "a"])
    y = np.array([v for _, c, _, v in rows if c == "b"])
    g, joined, n = np.random.default_rng(0), np.concatenate([x, y]), 0
    for _ in range(300):
        p = joined[g.permutation(24)]
        n += abs(p[:12].mean() - p[12:].mean()) >= abs(x.mean() - y.mean()) - 1e-12
    assert not r.exact and r.p_perm == pytest.approx(n / 300)


def test_log_scale_for_ratio_like_metrics(spark):
    rows = [("K_alpha[p]", c, k, v) for c, vs in (("a", (1.0, 10.0)), ("b", (100.0, 1000.0, -1.0))) for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "metric string, cond string, rep int, value double")
    r = stats.compare_conditions(df, n_boot=50).where("cond_x = 'a'").first()
    assert r.log10 and r.n_y == 2 and r.diff_mean == pytest.approx(-2.0)


def test_hits_per_window_meet_each_place_once(spark, monkeypatch):
    """Many windows and hits at one place: the same counts as of pairs, without making them."""
    win = spark.range(3000).selectExpr(
        "concat('w', id) AS name", "if(id % 3 = 0, 'chr2', 'chr1') AS chrom", "int(id % 2) * 50 + 100 AS start0", "int(id % 2) * 50 + 300 AS end", "id % 2000 AS key")
    hits = spark.range(3000).selectExpr(
        "CASE WHEN id % 4 = 0 THEN concat('w', id % 7, '::chr1:5-9') WHEN id % 4 = 1 THEN 'chr1:100-300' WHEN id = 2 THEN NULL ELSE 'chr2' END AS sequence_name",
        "if(id % 4 = 1, 0, 100) + int(id % 60) AS start", "if(id % 4 = 1, 0, 100) + int(id % 60) + 19 AS stop",
        "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '-' ELSE '+' END AS strand", "if(id % 11 = 0, NULL, (id * 37 % 1000) / 1000D) AS p", "id AS line")
    pairs = motifs.match_hits(hits, win).groupBy("key").agg(
        F.count("*").alias("n"), F.min("p").alias("p"), F.count(F.when(F.col("strand") == "+", 1)).alias("plus"))
    met, contained = [], motifs._contained

    def counted(*args):
        met.append(contained(*args))
        return met[-1]

    monkeypatch.setattr(motifs, "_contained", counted)
    out = motifs.hits_per_window(hits, win)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, pairs.collect())) and pairs.agg(F.sum("n")).first()[0] > 1_000_000
    assert 0 < met[0].count() <= 3 * 60 * 4  # places and borders, whatever the number of hits and windows
