import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from test_decontamination import brute_tiles
from test_mixing_sharding_urls import brute_mix

import check_oracle
from chromloom.llm import decontam, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert check_oracle.compare(spark, duck, SF, queries.QUERIES[name], queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_quality(rows, trees):
    """Ids that the trees accept, each text walked from node to node."""
    kept = set()
    for r in rows:
        [x] = quality.statistics(pa.array([r.text]))
        total = trees.base
        for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > limit[node] else 1)
            total += leaf[node - len(feature)]
        if 1 / (1 + math.exp(-total)) >= 0.5:
            kept.add(r.doc_id)
    return kept


def plain_copies(rows):
    """The smallest id of each group of five-word copies, by comparing all pairs."""
    sets, root = {}, {}
    for r in rows:
        words = split(re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        root[r.doc_id] = r.doc_id

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in sets}


def plain_leaks(rows, items):
    """Ids of documents of which half an item is covered by greedy tiles."""
    n, leaks = decontam.MIN_MATCH, set()
    pieces = lambda text: [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]
    runs = lambda words: {tuple(words[k:k + n]) for k in range(len(words) - n + 1)}
    for r in rows:
        text = pieces(r.text)
        seen = runs(text)
        for item in items:
            words = pieces(item)
            if runs(words) & seen and brute_tiles(words, text, n) >= decontam.COVERAGE * len(words):
                leaks.add(r.doc_id)
    return leaks


def plain_mix(rows):
    """Copies of each id, by plain loops over the tree of domains, languages and sources."""
    domain = lambda s: (m := re.search(r"[0-9]{1,9}$", s or "")) and queries.DOMAINS[int(m[0]) % len(queries.DOMAINS)] or "other"
    tree = [(r.doc_id, r.text, r.lang, r.source) for r in rows]
    found = brute_mix(tree, queries.MIX_PERCENT, queries.MIX_EPOCHS, queries.MIX_SEED, queries.MIX_WEIGHTS, domain)
    return Counter({i: n for (i, _, _), n in found.items() if n})


def test_each_stage_on_its_own_input(spark):
    """Every stage against plain Python on the rows that the stages before it kept."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [f for _, f in p.STAGES] == [p.keep_quality, p.drop_near_copies, p.drop_leaks, p.mix_sources, p.into_shards]
    trees = quality.train(docs, labels)
    items = [r.text for r in bench.collect()]
    for name, stage in p.STAGES:
        before = docs.collect()
        after = stage(spark, docs, SF)
        rows = after.collect()
        ids = Counter(r.doc_id for r in rows)
        all_ids = {r.doc_id for r in before}
        if stage is not p.into_shards:
            assert after.columns == docs.columns
        if stage is p.keep_quality:
            assert ids == Counter(plain_quality(before, trees)) and set(ids) < all_ids
        elif stage is p.drop_near_copies:
            assert ids == Counter(plain_copies(before)) and set(ids) < all_ids
        elif stage is p.drop_leaks:
            leaks = plain_leaks(before, items)
            assert leaks and ids == Counter(all_ids - leaks)
        elif stage is p.mix_sources:
            assert ids == plain_mix(before)
        else:
            assert ids == Counter(r.doc_id for r in before)
            slots, shard_of = defaultdict(list), defaultdict(set)
            for r in rows:
                slots[r.shard].append(r.slot)
                shard_of[r.text].add(r.shard)
                raw = (r.text or "").encode()
                assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
            assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(queries.N_SHARDS))
            assert all(len(s) == 1 for s in shard_of.values())
        text = {r.doc_id: r.text for r in before}
        assert all(r.text == text[r.doc_id] for r in rows)
        after.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name.replace(' ', '-')}")
        docs = spark.read.parquet(path)
    whole = p.run(spark, SF)
    assert Counter((r.doc_id, r.shard) for r in whole.collect()) == Counter((r.doc_id, r.shard) for r in docs.collect())


def test_repeated_ids_leave_one_row_a_group(spark):
    """Copies under one id or several leave one row; another text of the same id stays."""
    import corpus_pipeline as p

    t, u = " ".join(f"t{k}" for k in range(30)), " ".join(f"u{k}" for k in range(30))
    near = t.replace("t29", "x")
    rows = [(5, t), (5, t), (6, t), (7, t), (7, u), (8, u + " v"), (None, t), (None, t), (9, ""), (9, None), (9, near), (10, "a b c d e f"), (10, "a b c d e f g"), (3, "w")]
    docs = spark.createDataFrame([(i, x, "en", f"s{k}", 1) for k, (i, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in p.drop_near_copies(spark, docs, SF).collect()), key=str)
    assert [g for g in got if g[0] not in (9, 10)] == sorted([(5, t), (7, u), (None, t), (None, t), (3, "w")], key=str)
    assert len([g for g in got if g[0] == 9]) == 1 and not {g for g in got if g[0] == 9} & {(9, near)}
    assert len([g for g in got if g[0] == 10]) == 2  # one of two runs of five words is not 0.8


def test_odd_documents_pass_all_stages(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "plain text of a page", "en", "src1", 20), (None, None, None, None, None), (2, "", "en", "x", 0), (3, "one two three four five six", None, "src2", 1),
            (4, "w " * 200_000, "fr", "src3", 2), (1, "plain text of a page", "en", "src1", 20)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, shard int, component_id string")
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for _, stage in p.STAGES:
            at = stage(spark, at, str(tmp_path))
        found = at.collect()
        assert not empty or not found
        assert 3 not in {r.doc_id for r in found}
