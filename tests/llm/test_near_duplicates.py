import random
import re

import numpy as np
import pyarrow as pa
import pytest

from chromloom.llm import minhash
from chromloom.llm.words import byte_pieces, word_values

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


def brute(rows):
    """{doc_id: (n_shingles, component, kept)} by comparing all pairs."""
    ids = [i for i, _ in rows if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, **more).collect()]


def vary(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def test_against_all_pairs(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for group in range(25):
        words = [f"g{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 30, 200]))]
        for copy in range(rng.choice([1, 2, 5, 12])):
            rows.append((n, vary(rng, words, rng.choice([0, 0, 1, 2, 3]))))
            n += 1
    # a chain: each text is near the next one only, so components pass over several links
    words = [f"c{k}" for k in range(120)]
    for k in range(10):
        rows.append((n, " ".join(words)))
        words[k * 10:k * 10 + 5] = [f"d{k}{j}" for j in range(5)]
        n += 1
    rng.shuffle(rows)
    got = run(spark, rows)
    want = brute(rows)
    assert {i: (s, c, k) for i, s, c, k in got} == want
    assert len({c for _, _, c, _ in got}) < len(rows) - 20


def test_null_empty_long_and_repeated(spark):
    long = " ".join(f"l{k % 5000}" for k in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "Two one"), (8, long), (9, long + " tail"),
        (10, "same text here"), (10, "same text here"), (None, "same text here"), (11, "same\x0btext\x0chere"), (12, "É é"), (13, "é é"),
        (-3, "same text  here"),
    ]
    got = sorted(run(spark, rows), key=str)
    by_id = {i: (n, c, k) for i, n, c, k in got if i is not None}
    assert len(got) == len(rows)
    assert by_id[1] == (0, 1, True) and by_id[2] == (0, 2, True) and by_id[3] == (0, 3, True)
    assert by_id[4] == (1, 4, True) and by_id[5] == (1, 4, False)
    assert by_id[6][1] == 6 and by_id[7][1] == 7
    assert by_id[8] == (5000, 8, True) and by_id[9] == (5001, 8, False)
    assert by_id[10] == (2, -3, False) and by_id[11] == (2, -3, False) and by_id[-3] == (2, -3, True)
    assert by_id[12][1] == 12 and by_id[13][1] == 13  # only A-Z have another case
    assert [(n, c, k) for i, n, c, k in got if i is None] == [(2, None, None)]


def test_one_id_with_several_texts(spark):
    rows = [(5, "a b c d e"), (5, "v w x y z"), (7, "a b c d e"), (3, "v w x y z")]
    got = sorted(run(spark, rows))
    assert got == [(3, 4, 3, True), (5, 4, 3, False), (5, 4, 5, True), (7, 4, 5, False)]


def test_empty_table_and_extra_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b", 5, "x"), (2, "a b", 6, None)], "doc_id long, text string, n long, component_id string")
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()} == {(1, 1, True), (2, 1, False)}


def test_large_group_is_not_paired_with_itself(spark):
    """Pairs of one group of near copies grow with its members, not with their square."""
    rng = random.Random(1)
    words = [f"h{k}" for k in range(100)]
    rows = [(k, vary(rng, words, 1)) for k in range(400)]
    got = run(spark, rows)
    assert {c for _, _, c, _ in got} == {0}


@pytest.mark.parametrize("similarity", [0.2, 0.5, 0.8, 0.95])
def test_estimate_corrects_for_chance(similarity):
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        n = 1000
        common = int(2 * n * similarity / (1 + similarity))
        values = rng.integers(0, 2**63, 2 * n - common).astype(np.uint64)
        a, b = np.unique(values[:n]), np.unique(values[n - common:])
        packed = minhash.pack(np.stack([minhash.minima(a), minhash.minima(b)]))
        errors.append(minhash.estimate(packed[:1], packed[1:])[0] - similarity)
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2


def test_words_of_pieces_match_texts_alone():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB é\n\t#") for _ in range(rng.randrange(0, 60))) for _ in range(200)] + [None, ""]
    whole = {}
    for first, data, offsets in byte_pieces(pa.array(texts), 300):
        value, text, start, end = word_values(data, offsets)
        for v, t in zip(value, text):
            whole.setdefault(first + t, []).append(v)
    for k, t in enumerate(texts):
        one = list(byte_pieces(pa.array([t], pa.string())))
        value = word_values(one[0][1], one[0][2])[0]
        assert whole.get(k, []) == list(value)
        assert len(value) == len(WORD.findall(t or ""))
    assert len({int(v) for v in whole.get(0, [])}) == len(set(WORD.findall(lower(texts[0]))))


def test_star_of_copies_that_are_not_near_each_other(spark, monkeypatch):
    """Copies link to their middle, most not to each other, some not even to the middle: the second
    hub, the blocks against a large component and the last join must find just the true links."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 20)
    monkeypatch.setattr(minhash, "BLOCK_ASKED", 8)
    rng = random.Random(12)
    words = [f"s{k}" for k in range(120)]
    rows = [(500, " ".join(words))] + [(k, vary(rng, words, rng.randrange(1, 10))) for k in range(160)]
    other = words[:60] + [f"o{k}" for k in range(60)]
    rows += [(1000 + k, vary(rng, other, rng.randrange(1, 9))) for k in range(90)]
    got = {i: (s, c, k) for i, s, c, k in run(spark, rows)}
    want = brute(rows)
    assert got == want
    assert len({c for _, c, _ in want.values()}) > 10
