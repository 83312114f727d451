import random

import numpy as np
import pyarrow as pa

from chromloom.llm import quality


def texts(rng, good):
    w = ["thing", "other", "of", "and", "house", "river", "some", "green", "walk", "the"]
    if good:
        return " ".join(rng.choice(w) for _ in range(rng.randrange(20, 80))).capitalize() + "."
    return rng.choice([lambda: " ".join([rng.choice(w)] * 40), lambda: " ".join(x.upper() + "!!" for x in rng.choices(w, k=30)),
                       lambda: " ".join(x + "###" for x in rng.choices(w, k=30))])()


def tables(spark, n=600):
    rng = random.Random(1)
    rows = [(k, texts(rng, k % 4 != 0), k % 4 != 0) for k in range(n)]
    docs = spark.createDataFrame([(k, t, "clash") for k, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(q)) for k, _, q in rows], "doc_id long, quality int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    out = quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert 100 < len(held) < 300
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_held_out_rule(spark):
    import zlib

    got = spark.range(0, 50).select("id", quality.held_out(quality.F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = tables(spark)
    held = quality.held_out(quality.F.col("doc_id"))
    turned = labels.withColumn("quality", quality.F.when(held, 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs, turned).collect()}
    assert a == b


def test_edges(spark):
    docs, labels = tables(spark, 200)
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "x" * 300_000, None)], "doc_id long, text string, predicted string")
    out = quality.classify(odd, labels).collect()
    assert len(out) == 4 and len({r.score for r in out if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in out)
    none = labels.limit(0)
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}
    one_kind = labels.filter("quality = 1")
    assert min(r.score for r in quality.classify(docs, one_kind).collect()) > 0.9
    assert quality.classify(odd.limit(0), labels).count() == 0
    nulls = spark.createDataFrame([(None, 1), (5, None), (6, 1)], "doc_id long, quality int")
    assert quality.classify(docs, labels.union(nulls).union(labels)).count() == 200


def test_statistics_do_not_depend_on_neighbours():
    rng = random.Random(2)
    some = [texts(rng, k % 2 == 0) for k in range(30)] + [None, "", "é", "a b\nb a"]
    together = quality.statistics(pa.array(some))
    for k, t in enumerate(some):
        assert np.allclose(together[k], quality.statistics(pa.array([t], pa.string()))[0])
    f = dict(zip(quality.FEATURES, quality.statistics(pa.array(["a a a b."]))[0]))
    assert f["repeats"] == 0.5 and f["distinct_words"] == 0.5 and f["top_word"] == 0.75 and f["stop_ends"] == 0.25


def test_flat_walk_equals_walk_by_node():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.grow(x, y)
    got = quality.score(trees, x)
    for row, p in zip(x[:40], got):
        total = trees.base
        for f, limit, leaf in zip(trees.feature, trees.limit, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > limit[node] else 1)
            total += leaf[node - len(f)]
        assert abs(p - 1 / (1 + np.exp(-total))) < 1e-9
    assert np.mean((got > 0.5) == y) > 0.95
