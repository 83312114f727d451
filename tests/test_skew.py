"""Ordered helpers against plain Python, with one group holding most rows."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chromloom.functions.skew import percentiles, row_numbers, running_total, value_bucket


def hot(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abc"), n))
    return [(str(k), int(t), float(v)) for k, t, v in zip(keys, rng.permutation(n), rng.normal(0, 50, n))]


def test_row_numbers_and_running_total(spark):
    rows = hot()
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {(r.k, r.t): (r.rn, r.s) for r in running_total(
        row_numbers(df, ["k"], ["t"], F.floor(F.col("t") / 64)), ["k"], ["t"], F.floor(F.col("t") / 64),
        F.col("t"), "s").collect()}
    for key in {k for k, _, _ in rows}:
        total = 0
        for place, t in enumerate(sorted(t for k, t, _ in rows if k == key), 1):
            total += t
            assert got[(key, t)] == (place, total)


@pytest.mark.parametrize("spread", [1e-9, 1.0, 1e9])
def test_percentiles(spark, spread):
    rows = [(k, t, v * spread) for k, t, v in hot(1500)] + [("one", 0, 3.0), ("same", 0, 2.0), ("same", 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r.k, r.prob): r.value for r in percentiles(df, ["k"], "v", probs).collect()}
    for key in {k for k, _, _ in rows}:
        values = [v for k, _, v in rows if k == key]
        for p in probs:
            assert got[(key, p)] == pytest.approx(np.quantile(values, p), rel=1e-12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=2, max_size=40))
def test_value_bucket_is_monotone(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = df.select("v", value_bucket(F.col("v")).alias("b")).collect()
    ordered = sorted(rows, key=lambda r: r.v)
    assert all(a.b <= b.b for a, b in zip(ordered, ordered[1:]))
