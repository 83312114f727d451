import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chromloom.llm import mixing, sharding, url_filter

DOCS = "doc_id long, text string, lang string, source string"


def levels():
    return {"domain": F.substring("source", 1, 1), "lang": F.col("lang"), "source": F.col("source")}


def fill(budget, members):
    """{name: share}: raise the level until the budget is spent or all are full."""
    share = {k: 0.0 for k in members}
    open_ = dict(members)
    while open_ and budget > 1e-9:
        total = sum(w for _, w in open_.values())
        full = {k for k, (room, w) in open_.items() if room - share[k] <= budget * w / total + 1e-12}
        if not full:
            for k, (_, w) in open_.items():
                share[k] += budget * w / total
            break
        for k in full:
            budget -= open_[k][0] - share[k]
            share[k] = open_[k][0]
            del open_[k]
        # members that stay have had nothing yet in this model, as shares start at zero
    return share


def test_shortages_go_to_siblings_first(spark):
    tokens = {("a", "en", "a1"): 100, ("a", "en", "a2"): 10, ("a", "de", "a1"): 5, ("b", "en", "b1"): 1000, ("c", "fr", "c1"): 1}
    leaves = spark.createDataFrame([(*k, v, 1) for k, v in tokens.items()], "domain string, lang string, source string, tokens long, docs long")
    weights = {"domain": {"a": 2, "b": 1, "c": 1}, "lang": {"en": 1, "de": 1}}
    for budget in (0, 10, 50, 120, 300, 600, 5000):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, ["domain", "lang", "source"], weights, F.lit(float(budget)), 1).collect()}
        room = lambda *p: sum(v for k, v in tokens.items() if k[:len(p)] == p)
        want = {}
        domains = fill(budget, {d: (room(d), weights["domain"][d]) for d in "abc"})
        for d, given in domains.items():
            langs = fill(given, {x: (room(d, x), 1) for x in {k[1] for k in tokens if k[0] == d}})
            for x, part in langs.items():
                for s, share in fill(part, {k[2]: (room(*k), 1) for k in tokens if k[:2] == (d, x)}).items():
                    want[d, x, s] = share
        assert got == pytest.approx(want)
        assert sum(got.values()) == pytest.approx(min(budget, sum(tokens.values())))


def brute_mix(rows, percent, epochs, seed, weights, domain=lambda s: (s or "")[:1]):
    import hashlib

    rows = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), domain(s), x or "", s or "") for i, t, x, s in rows]
    total = sum(r[1] for r in rows)
    leaf = defaultdict(list)
    for r in rows:
        leaf[r[2:]].append(r)
    room = lambda *p: sum(sum(r[1] for r in v) for k, v in leaf.items() if k[:len(p)] == p) * epochs
    out = Counter()
    for d, given in fill(total * percent // 100, {d: (room(d), weights["domain"].get(d, 1)) for d in {k[0] for k in leaf}}).items():
        for x, part in fill(given, {x: (room(d, x), weights.get("lang", {}).get(x, 1)) for x in {k[1] for k in leaf if k[0] == d}}).items():
            for s, goal in fill(part, {k[2]: (room(*k), 1) for k in leaf if k[:2] == (d, x)}).items():
                mine, left, e = leaf[d, x, s], int(goal + 1e-9), 0
                size = sum(r[1] for r in mine)
                while size and left >= size:
                    left, e = left - size, e + 1
                key = lambda r: (hashlib.md5(f"{seed}:{e + 1}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:16], r[1])
                run = 0
                for r in sorted(mine, key=key):
                    run += r[1]
                    out[r[0], r[1], r[4]] += e + (1 if e < epochs and run <= left else 0)
    return out


def test_mix_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)  # several buckets a leaf
    rows = [(k, "w " * (k * 7 % 11), ["en", "de"][k % 3 == 0], ["a1", "a2", "b1", "c1"][k * k % 4]) for k in range(200)]
    rows += [(300, None, None, None), (301, "", "en", "a1"), (None, "w w", "en", "b1"), (5, "w w w", "en", "a2"), (5, "w w w", "en", "a2")]
    weights = {"domain": {"a": 3, "b": 2}}
    for percent, epochs in ((0, 1), (35, 1), (70, 2), (150, 2), (400, 3)):
        df = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", copies string")
        got = Counter()
        for r in mixing.mix(df, levels(), weights, percent, epochs, 9).collect():
            got[r.doc_id, r.tokens, r.source or ""] += r.copies
        assert +got == +brute_mix(rows, percent, epochs, 9, weights), (percent, epochs)
    assert mixing.mix(spark.createDataFrame([], DOCS), levels(), weights).count() == 0


def test_heap_schedule():
    assert sharding.schedule([(1, 5), (2, 5), (3, 4), (4, 3), (5, 3)], 2) == [(1, 0), (2, 1), (3, 0), (4, 1), (5, 1)]
    assert sharding.schedule([], 3) == []


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 16)
    rows = [(k, "t" * (k * 37 % 997), "x") for k in range(3000)] + [(k, "copy of a text", "y") for k in range(5000, 6500)]
    rows += [(7000, None, None), (7001, "", None), (None, "é", "z"), (None, "é", "z"), (7002, "L" * 500_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.assign_shards(df, 8).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t) for i, t, _ in rows)
    shard_of, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in out:
        body = (r.text or "").encode()
        assert r.size == len(body) + 16 and r.text_crc32 == zlib.crc32(body) and r.law == "bytes" and r.grown_shard is None
        shard_of[r.text or ""].add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) == set(range(8))
    rest = [v for k, v in load.items() if k not in shard_of["L" * 500_000]]
    assert max(rest) - min(rest) <= 0.02 * sum(rest) / len(rest)
    assert sharding.assign_shards(df.limit(0), 8).count() == 0


URLS = [
    (1, "http://www.Example.com/en/a.html?x=1#f"), (2, "https://example.com/en/a"), (3, "http://b.example.com/de/"), (4, "http://c.net/es/q"), (5, "http://c.net/en/q?ref=z"),
    (6, "https://www.c.net/en/q/#top"), (7, "http://c.net/en/q?utm_source=a&b=1"), (8, "http://x.org"), (9, None), (10, "no address"), (11, ""), (12, "http://x.org/?ref=1"),
    (13, "http://net/fr/"), (14, "http://xnet/fr/"), (15, "http://example.com"), (16, "a://b://c/d"), (5, "http://c.net/en/q?ref=z"), (17, "http://É.com/en/"),
]


def test_url_rules_list_and_edges(spark):
    from chromloom.llm.queries import RULES

    pages = spark.createDataFrame([(*u, "old") for u in URLS], "page_id long, url string, host string")
    listed = pages.filter(F.col("url").rlike("[?&]ref="))
    out = url_filter.filter_urls(pages, listed, RULES).collect()
    assert len(out) == len(URLS)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert got[1] == ("www.example.com", "/en/a.html", "www.example.com/en/", "allow")
    assert got[2] == ("example.com", "/en/a", "example.com/en/", "block")
    assert got[3] == ("b.example.com", "/de/", "com/", "allow")
    assert got[4][2:] == ("net/es/", "block") and got[13][2:] == ("net/fr/", "block") and got[14][2:] == (None, "allow")
    assert got[5][2:] == (None, "block") and got[6][2:] == (None, "block")  # another spelling of a listed URL
    assert got[7][2:] == (None, "allow")  # a parameter that counts
    assert got[8] == ("x.org", "", None, "block")  # listed as http://x.org/?ref=1
    for k in (9, 10, 11):
        assert got[k] == ("", "", None, "allow")
    assert got[15] == ("example.com", "", None, "allow")
    assert got[16][:2] == ("b:", "//c/d") and got[17] == ("É.com", "/en/", "com/", "allow")
    assert url_filter.filter_urls(pages.limit(0), listed, RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, listed.limit(0), []).collect()} == {"allow"}


def test_bloom_filter_loses_nothing_and_passes_little(spark):
    keys = spark.range(4000).select(F.concat(F.lit("host/"), "id").alias("key"))
    n = 4000 // url_filter.KEYS_PER_BLOCK
    held = url_filter.bloom_filter(keys, "key", n)
    assert held.count() <= n
    asked = spark.range(20_000).select("id", F.concat(F.lit("host/"), "id").alias("key"))
    out = url_filter.mark_possible(asked, "key", held, n).groupBy((F.col("id") < 4000).alias("listed"), "__possible").count().collect()
    count = {(r.listed, r["__possible"]): r["count"] for r in out}
    assert count[True, True] == 4000 and (True, False) not in count
    assert count[False, True] < 0.05 * 16_000
