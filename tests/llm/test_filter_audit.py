import re
from itertools import permutations

import numpy as np
import pandas as pd
import pytest

from chromloom.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """The report by plain Python: every order applied left to right to the documents."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                stay = [d for d in left if f not in d[1]]
                gone = [d for d in left if f in d[1]]
                n_fail = sum(f in d[1] for d in own)
                out[part, "".join(order), step + 1] = [
                    len(stay), len(gone), n_fail - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                left = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def in_files(spark, path, files):
    """One Parquet file for each list of rows, in order of time."""
    for rows in files:
        full = [(i, t, "en", s, None) for i, t, s in rows]
        spark.createDataFrame(full, DOCS).coalesce(1).write.mode("append").parquet(path)
    return path


def some_rows(rng, n):
    base = [" ".join(f"w{k}" for k in range(250)), "a b " * 150, "X" * 30 + " y", "cost $5", "", None, "short", " ".join(f"v{k}" for k in range(199)), "É é\x0bÜ"]
    return [(None if rng.random() < 0.05 else int(rng.integers(0, n)), base[rng.integers(len(base))], [None, "", "s1", "s2"][rng.integers(4)]) for _ in range(n)]


def test_many_micro_batches_equal_brute_force(spark, tmp_path):
    """Ids fall from file to file, so earlier documents are taken back again and again."""
    rng = np.random.default_rng(0)
    rows = sorted(some_rows(rng, 300), key=lambda r: -(r[0] or 0))
    rows += rows[:20]
    path = in_files(spark, str(tmp_path / "docs"), [rows[k:k + 64] for k in range(0, len(rows), 64)])
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 300, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (6, None, None)]
    table = spark.createDataFrame(labels, LABELS)
    got = fa.audit(spark, path, table, batches=5)
    assert told(got) == brute(rows, labels)
    assert fa.FILTERS == "ABCDE" and got.count() == 600 * len({r[2] or "" for r in rows})


def test_a_folder_goes_on_with_more_files(spark, tmp_path):
    """The state of earlier runs is used: a smaller id in a later file takes back."""
    path, folder = str(tmp_path / "docs"), str(tmp_path / "audit")
    one = [(9, "same text", "late"), (9, "same text", "late"), (12, "same text", "other"), (10, "cost $5", "late")]
    two = [(3, "same text", "early"), (11, "cost $5", "early")]
    labels = fa.label_bits(spark.createDataFrame([(9, 1, 0), (3, 0, 1)], LABELS))
    schema = spark.createDataFrame([], DOCS).schema
    in_files(spark, path, [one])
    for files in ([], [two]):
        in_files(spark, path, files)
        fa.start(spark.readStream.schema(schema).parquet(path), labels, folder, 10).awaitTermination()
        seen = one + [r for f in files for r in f]
        assert told(fa.report(fa.counters(spark, folder))) == brute(seen, [(9, 1, 0), (3, 0, 1)])
    log = spark.read.schema(fa.DELTAS).parquet(f"{folder}/changes")
    assert log.filter("n < 0").count() == 1  # both documents of id 9 were taken back at once


def test_hot_text_is_folded_before_the_shuffle():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({
        "key": [b"h" * 32] * 1000, "doc_id": list(range(k, k + 1000)), "part": [f"s{i % 3}" for i in range(1000)], "mask": [3] * 1000}) for k in (5000, 7, 900)]
    [out] = list(fa._fold(iter(batches), 10))
    rows = out.to_pylist()
    assert sum(r["n"] for r in rows) == 3000 and len(rows) <= 4
    assert [(r["doc_id"], r["n"], r["mask"]) for r in rows if r["key"]] == [(7, 1, 3)]
    assert all(r["mask"] == 3 | fa.SAME_TEXT for r in rows if not r["key"]) and {r["cell"] < 10 for r in rows} == {True}


@pytest.mark.parametrize("seed", range(6))
def test_order_of_arrival_does_not_matter(seed):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"key": [bytes([k]) * 32 for k in rng.integers(0, 5, 80)], "doc_id": rng.integers(0, 12, 80),
                         "part": [f"s{k}" for k in rng.integers(0, 3, 80)], "mask": rng.integers(0, 8, 80).astype(np.int32), "n": 1})
    least = rows.groupby("key")["doc_id"].transform("min")
    want = rows.assign(mask=rows["mask"] | np.where(rows["doc_id"] > least, fa.SAME_TEXT, 0)).groupby(["part", "mask"])["n"].sum()
    held, changes = fa._STATE.empty_table().to_pandas(), []
    for chunk in np.array_split(rng.permutation(80), 7):
        held, more = fa.take_in(held, rows.iloc[chunk])
        changes.append(more)
    got = pd.concat(changes).groupby(["part", "mask"])["n"].sum()
    assert got[got != 0].to_dict() == want.to_dict()
    assert fa._pack(held) and held["n"].sum() == (rows["doc_id"] == least).sum()


def test_edges(spark, tmp_path):
    none = spark.createDataFrame([], LABELS)
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], DOCS).write.parquet(empty)
    assert fa.audit(spark, empty, none).collect() == []
    rows = [(1, None, None), (2, "", ""), (None, "", "x"), (2, "", ""), (5, "long " * 200_000, "x")]
    path = str(tmp_path / "odd")
    spark.createDataFrame([(i, t, s, 7, "z") for i, t, s in rows], "doc_id int, text string, source string, mask int, part string").coalesce(1).write.parquet(path)
    assert told(fa.audit(spark, path, none)) == brute(rows, [])


def test_settings_of_the_session_stay(spark, tmp_path):
    keys = ("spark.sql.shuffle.partitions", *fa.STATE_SETTINGS)
    before = [spark.conf.get(k, None) for k in keys]
    path = in_files(spark, str(tmp_path / "docs"), [[(1, "a", "s")]])
    fa.audit(spark, path, spark.createDataFrame([], LABELS))
    assert [spark.conf.get(k, None) for k in keys] == before
