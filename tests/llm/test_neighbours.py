import numpy as np

from chromloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, k, every):
    """{query: [(id, score)]}, nearest first, ties to the smaller id."""
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(1)
            order = [j for j in np.lexsort((ids, -np.round(s, 11))) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def run(spark, rows, schema=SCHEMA, **how):
    out = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, schema), **how).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_scores_and_order(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[1500:] *= rng.uniform(0.5, 3, (1500, 1))  # inner products, not angles
    ids = rng.permutation(3000)
    got = run(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)])
    want = brute(ids, x.astype(float), 20, 20)
    assert set(got) == set(want)
    at = {int(i): v.astype(float) for i, v in zip(ids, x)}
    hit = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert all(abs(s - at[q] @ at[v]) < 1e-9 for _, v, s in found)
        assert [s for _, _, s in found] == sorted((s for _, _, s in found), reverse=True)
        hit += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hit >= 0.9 * 20 * len(want)


def test_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8)).astype(np.float32)
    x = base[rng.integers(0, 30, 400)]
    x[:200] = base[0]
    ids = np.arange(400)
    got = run(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)])
    want = brute(ids, x.astype(float), 20, 20)
    assert {q: [v for _, v, _ in f] for q, f in got.items()}[0] == [v for v, _ in want[0]]
    for q in want:
        assert [v for _, v, _ in got[q]] == [v for v, _ in want[q]]


def test_few_rows_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (40, [None, 1.0]),
            (None, [1.0, 1.0]), (60, [1.0, 0.0, 0.0]), (1, [1.0, 1.0]), (80, [])]
    got = run(spark, [(*r, 3) for r in rows], SCHEMA + ", score int")
    assert {q: [(v, s) for _, v, s in f] for q, f in got.items()} == {0: [(1, 1.0), (20, 0.0)], 20: [(1, 2.0), (0, 0.0)]}
    assert run(spark, []) == {}
    assert run(spark, [(20, [1.0, 0.0])]) == {}
    assert run(spark, [(20, [1.0, 0.0]), (40, [1.0, 0.0])]) == {20: [(1, 40, 1.0)], 40: [(1, 20, 1.0)]}


def test_probes_come_in_order_of_cost():
    rng = np.random.default_rng(2)
    hashes = neighbours.projections(5)
    x = neighbours.lifted(rng.normal(size=(4, 5)), 1.0, True)
    all_ = neighbours.probes(x, hashes, len(neighbours._STEPS))
    assert (all_[:, :, 0] == neighbours.buckets(x, hashes)).all()  # the own bucket first
    assert all(len(set(all_[t, i].tolist())) == len(neighbours._STEPS) for t in range(2) for i in range(4))


def test_small_tables_give_all_candidates(spark):
    """Every query of 2 to 25 vectors meets all others, whatever the number of components."""
    for dim, sizes in ((2, (2, 3, 25)), (8, (16, 21, 22)), (64, (5, 24))):
        for n in sizes:
            rng = np.random.default_rng(n * dim)
            x = (rng.normal(size=(n, dim)) * rng.uniform(0.1, 40, (n, 1))).astype(np.float32)
            ids = np.arange(0, 10 * n, 10)
            got = run(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)])
            want = brute(ids, x.astype(float), 20, 20)
            assert {q: [v for _, v, _ in f] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in want.items()}


def test_one_long_vector_does_not_crowd_the_others():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 32))
    x[0] *= 1000
    norm = np.sqrt((x * x).sum(1))
    norms = neighbours.norm_bands([(int(np.frexp(v)[1]), float(v)) for v in norm])
    assert len(norms.low) == 2 and (np.bincount(norms.band(x)) == [1, 4999]).all()
    hashes = neighbours.projections(32)
    held = neighbours.buckets(neighbours.lifted(x, norms.scale(x), False), hashes)
    assert all(np.unique(t, return_counts=True)[1].max() < 500 for t in held)
    assert (norms.scale(x)[:, 0] >= norm).all()


def test_norms_of_many_sizes(spark):
    """Ranks over several bands equal brute force for every query that met too few others."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(300, 16)) * 2.0 ** rng.integers(-40, 40, (300, 1)))
    got = run(spark, [(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(np.arange(300), x, 20, 20)
    hit = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert set(got) == set(want) and all(len(f) == 20 for f in got.values()) and hit >= 0.9 * 20 * len(want)
