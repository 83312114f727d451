"""Contact counting: kernel, grid join and brute force agree; pooling keeps counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromloom.catalog.registry import QUERIES
from chromloom.operators import contacts as K
from chromloom.operators.contacts import _pair_codes
from chromloom.schemas import POSITION


def frames_of(spark, coords, reps=2):
    rows = [
        (f"r{f % reps}", f, [(float(x), float(y), float(z)) for x, y, z in c]) for f, c in enumerate(coords)
    ]
    df = spark.createDataFrame(rows, "rep string, frame int, pos array<struct<x:double,y:double,z:double>>")
    return df.withColumn("pos", F.col("pos").cast(POSITION))


def brute(coords, radius, tile=None, reps=2):
    out = {}
    for f, c in enumerate(coords):
        regions = [np.arange(len(c))]
        if tile:
            size, pad, n = tile
            regions = [np.arange(k * size + pad, k * size + pad + n) for k in range(len(c) // size)]
        for beads in regions:
            p = c[beads]
            d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
            for i, j in zip(*np.triu_indices(len(beads), 1)):
                if d2[i, j] <= radius * radius:
                    key = (f"r{f % reps}", int(i), int(j))
                    out[key] = out.get(key, 0) + 1
    return out


@pytest.fixture(scope="module")
def coords():
    rng = np.random.default_rng(3)
    return [np.cumsum(rng.normal(0, 0.8, (42, 3)), axis=0) for _ in range(9)]


def collected(df):
    return {(r.rep, r.i, r.j): r.n for r in df.collect()}


@pytest.mark.parametrize("strategy", ["kernel", "grid"])
@pytest.mark.parametrize("tile", [None, (14, 2, 10)])
def test_counts_equal_brute_force(spark, coords, strategy, tile):
    frames = frames_of(spark, coords)
    kw = {} if tile is None else dict(tile_size=tile[0], padding=tile[1], n_tiles=3)
    n_bins = 42 if tile is None else tile[2]
    got = K.count_contacts(frames, ["rep"], n_bins, 1.5, strategy=strategy, **kw)
    assert collected(got) == brute(coords, 1.5, tile)


def test_contact_at_exactly_the_radius_counts(spark):
    frames = frames_of(spark, [np.array([[0, 0, 0], [3, 0, 0], [0, 3.0001, 0]], float)], reps=1)
    for strategy in ("kernel", "grid"):
        assert collected(K.count_contacts(frames, ["rep"], 3, 3.0, strategy=strategy)) == {("r0", 0, 1): 1}


def test_small_bead_budget_gives_the_same_pairs(coords):
    c = np.concatenate(coords)
    bead, region = np.tile(np.arange(42), 9), np.repeat(np.arange(9), 42)
    whole = {tuple(sorted(p)) for a, b in _pair_codes(c, region, bead, 1.5) for p in zip(a.tolist(), b.tolist())}
    parts = set()
    for r in range(9):
        at = np.flatnonzero(region == r)
        for a, b in _pair_codes(c[at], region[at], bead[at], 1.5):
            parts |= {tuple(sorted((int(at[x]), int(at[y])))) for x, y in zip(a, b)}
    assert whole == parts


def test_pool_equals_sum_of_replicates(spark, coords):
    frames = frames_of(spark, coords)
    counts = K.count_contacts(frames, ["rep"], 42, 1.5)
    pooled = K.pool_replicates(counts, K.sub_regions(frames, ["rep"]), [])
    rows = pooled.collect()
    assert sum(r.n for r in rows) == sum(brute(coords, 1.5).values())
    assert {r.n_sub for r in rows} == {9}
    assert all(r.v == pytest.approx(r.n / 9) for r in rows)


def test_merge_shards_renumbers(spark):
    df = spark.createDataFrame([("a", s, f) for s in (0, 1, 2) for f in (0, 5, 9)], "run string, shard int, frame long")
    got = sorted((r.shard, r.frame, r.n_shards) for r in K.merge_shards(df, ["run"]).collect())
    assert got == [(s, s * 3 + k, 3) for s in (0, 1, 2) for k in range(3)]


def test_radius_join_query_returns_every_pair(spark):
    """One row for each pair of beads in contact of a frame, with its distance."""
    got = QUERIES["jn1_contacts_within_radius"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["chain", "frame", "i", "j", "d2"]
    rows = got.collect()
    assert len({tuple(r)[:4] for r in rows}) == len(rows) > 1000
    counted = QUERIES["ag1_contact_map_grid"](spark, "/root/testdata/sf0.001").agg(F.sum("n")).first()[0]
    assert counted == len(rows) and all(r.i < r.j and r.d2 <= 0.2 * 0.2 for r in rows)
