import random
import re

import numpy as np

from chromloom.llm import decontam


def brute_tiles(item, text, least):
    """Greedy tiling by trying all runs."""
    mi, mt, total = [False] * len(item), [False] * len(text), 0
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not mi[i + n] and not mt[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if best < least:
            return total
        for i, j in found:
            if not any(mi[i:i + best]) and not any(mt[j:j + best]):
                mi[i:i + best] = mt[j:j + best] = [True] * best
                total += best


def test_tiles_equal_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        text = [rng.randrange(1, 7) for _ in range(rng.randrange(0, 40))]
        item = [rng.randrange(1, 7) for _ in range(rng.randrange(0, 25))]
        found = decontam.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        for i, j, n in found:
            assert n >= 3 and item[i:i + n] == text[j:j + n]
        cover = [k for i, _, n in found for k in range(i, i + n)]
        assert len(cover) == len(set(cover))
        assert sum(n for _, _, n in found) == brute_tiles(item, text, 3)


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_finds_whole_cut_and_reordered_passages(spark):
    rng = random.Random(8)
    items = {k: words(rng, 30) for k in range(6)}
    filler = lambda: " ".join(words(rng, 50))
    a = items[0]
    docs = {
        0: filler(), 1: f"{filler()} {' '.join(a)} {filler()}", 2: f"{filler()} {', '.join(w.upper() for w in a)}! {filler()}",
        3: f"{' '.join(a[15:])} {filler()} {' '.join(a[:15])}",  # reordered
        4: f"{filler()} {' '.join(a[:10])} {filler()}",  # a third is not enough
        5: f"{' '.join(items[1])} {' '.join(items[2])}", 6: " ".join(w for k in range(0, 30, 3) for w in (*a[k:k + 3], "x")),  # too short runs
        7: None, 8: "", 9: " ".join(a), 10: " ".join(a),
    }
    d = spark.createDataFrame([(k, v, "x") for k, v in docs.items()] + [(None, " ".join(a), "y")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(7, None), (8, ""), (9, "w1 w2")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contamination(d, b).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0), (5, 1), (5, 2), (9, 0), (10, 0), (None, 0)}
    assert got[3, 0].tiles == 2 and got[3, 0].coverage == 1.0 and got[1, 0].longest_tile == 30
    kept = decontam.decontaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {0, 4, 6, 7, 8}


def test_coverage_equals_brute_force(spark):
    """Small words in common everywhere: the seed filter and the join must lose nothing."""
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for k in range(40)]
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(4, 20)))) for k in range(8)]
    want = {}
    for i, t in docs:
        for j, s in items:
            item = re.findall(r"\w+", s)
            share = brute_tiles(item, re.findall(r"\w+", t), decontam.MIN_MATCH) / len(item)
            if share >= decontam.COVERAGE:
                want[i, j] = share
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.coverage for r in got.collect()} == want


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert decontam.contamination(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert decontam.contamination(some, items.limit(0)).count() == 0
    assert decontam.contamination(some, items.union(items)).count() == 4
    assert decontam.decontaminated(some, items.limit(0)).count() == 2
