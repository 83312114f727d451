import hashlib

import numpy as np
import pytest

from chromloom.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=8, rounds=10, dim=64, seed=3):
    """[(vec_id, cluster, distance, cluster inertia, inertia, hash)] with Python's integers only."""
    kept = [(i, [int(x) * 1024 if abs(x) > 2**60 else int(np.floor(x * 1024)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    fit = lambda x: x if x < 2**63 else None
    sums = [fit(sum(d for d, c in own if c == j)) for j in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, fit(d), sums[c], fit(sum(d for d, _ in own)), sha[c]) for (i, _), (d, c) in zip(kept, own)), key=str)


def run(spark, rows, schema=SCHEMA, **how):
    return sorted((tuple(r) for r in centroids.cluster(spark.createDataFrame(rows, schema), **how).collect()), key=str)


@pytest.mark.parametrize("n, k, dim", [(500, 8, 64), (7, 3, 64), (40, 5, 1), (60, 8, 4), (300, 8, 16)])
@pytest.mark.parametrize("kind", [np.int64, object])
def test_search_is_exact(n, k, dim, kind):
    rng = np.random.default_rng(n)
    v = rng.integers(-3, 4, (n, dim))
    c = v[rng.integers(0, n, k)] + rng.integers(-1, 2, (k, dim))
    full = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    number, distance = centroids.nearest(v.astype(kind), c.astype(kind))
    assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def test_transform_keeps_distances():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (2, 64))
    y = centroids.transform(x)
    assert ((y[0] - y[1]) ** 2).sum() == 64 * ((x[0] - x[1]) ** 2).sum()
    assert sorted(centroids.coarse_to_fine(64)) == list(range(64)) and centroids.coarse_to_fine(64)[0] == 0


@pytest.mark.parametrize("value", [0, 1, -1, 2**30, -(2**30), 5 * 2**70 + 3, -(3**50)])
def test_digits(value):
    assert sum(d * centroids.DIGIT**k for k, d in enumerate(centroids.digits(value))) == value


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(5, 64))
    rows = [(i, (middles[i % 5] + 0.4 * rng.normal(size=64)).tolist()) for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_ties_and_copies(spark):
    """Two thirds of the rows are one vector; centroids that share a place keep the smaller number."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-1, 2, 64) / 1024).tolist()) for i in range(60)] + [(i, [0.5] * 64) for i in range(60, 180)]
    rows += rows[:10]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 190


def test_bad_large_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0] * 64
    rows = [(0, one), (None, [2.0] * 64), (None, [3.0] * 64), (1, None), (2, []), (3, one[:63]), (4, one + [1.0]), (5, one[:63] + [nan]),
            (6, one[:63] + [inf]), (7, one[:63] + [None]), (8, [1e300] * 64), (9, [-3e5] * 64), (9, [-3e5] * 64), (10, [-0.0001] * 64)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == brute(rows[:1])
    assert run(spark, rows[3:8]) == [] and run(spark, []) == []


def test_kinds_of_columns_and_parameters(spark):
    rows = [(f"v{k}", [k, -k, 3, k % 4], 1, "x") for k in range(30)]
    df = spark.createDataFrame(rows, "id string, v array<int>, cluster int, vector string")
    got = sorted(tuple(r) for r in centroids.cluster(df, "id", "v", k=3, rounds=4, dim=4).collect())
    assert got == sorted(brute([(i, [float(x) for x in v]) for i, v, *_ in rows], 3, 4, 4))
    with pytest.raises(ValueError):
        centroids.cluster(df, "id", "v", dim=3)
