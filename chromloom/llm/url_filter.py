"""URL filter: host and path rules first, then a list of canonical URLs.

The list is tested with a blocked Bloom filter (eight 64-bit lanes a block, one bit set in each
lane for a URL). URLs that the filter lets pass go to an exact join with the list, so nothing is
blocked by a false positive. All of it is DataFrame expressions: the filter is a small table with
one row a block, joined by block number; Spark broadcasts it where its size allows and shuffles
by block otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromloom.llm.common import ascii_lower, with_columns

LANES = 8
#: URLs a block holds on average: 512 bits for 40 URLs with 8 bits each, about 1 % false hits.
KEYS_PER_BLOCK = 40


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without a final ``/`` or ``.html``, query without tracking
    parameters (``ref``, ``utm_*``); scheme and fragment go. Empty without ``://``."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^(utm_[^=]*|ref)(=|$)") & (p != "")), "&")
    return F.concat(
        F.regexp_replace(host_of(url), r"^www\.", ""),
        F.regexp_replace(path_of(url), r"(/|\.html)$", ""),
        F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""),
    )


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Index of the longest rule that fits (host or subdomain, and path prefix), else null."""
    found = F.lit(None).cast("int")
    for k in sorted(range(len(rules)), key=lambda k: len(rules[k].text)):  # the longest comes out on top
        r = rules[k]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(k)).otherwise(found)
    return found


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _bits(key: Column) -> list[Column]:
    """The bit of each lane; six bits of a second hash pick its place."""
    h = F.xxhash64(key, F.lit("lane"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(LANES)]


def bloom_filter(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """``(block, lane0 .. lane7)``: one row for each block that holds a key."""
    bits = [b.alias(f"lane{k}") for k, b in enumerate(_bits(F.col(key)))]
    return (
        keys.select(_block(F.col(key), n_blocks).alias("block"), *bits)
        .groupBy("block").agg(*[F.bit_or(f"lane{k}").alias(f"lane{k}") for k in range(LANES)])
    )


def mark_possible(df: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows with ``__possible``: false only if the key is surely not in the filter."""
    asked = df.withColumn("__block", _block(F.col(key), n_blocks))
    held = asked.join(blocks.withColumnRenamed("block", "__block"), "__block", "left")
    fits = F.lit(True)
    for k, bit in enumerate(_bits(F.col(key))):
        fits = fits & (F.coalesce(F.col(f"lane{k}"), F.lit(0)).bitwiseAND(bit) != 0)
    return held.withColumn("__possible", fits)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Judge every row's URL; adds host, path, rule and verdict.

    ``listed``: a table with a column ``url``; each canonical form in it is blocked. A rule's
    verdict stands before the list's; what neither names is allowed. A null URL or one without
    ``://`` has an empty host and path, fits no rule and is allowed, also when such a URL is
    listed. Repeated rows are judged alike and all kept. An empty list blocks nothing. Columns
    named host, path, rule or verdict in the input give way.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    base = with_columns(pages, {"host": host, "path": path})
    base = base.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    keep = [c for c in base.columns if c.lower() not in ("rule", "verdict") and c != "__rule"]
    texts = F.array(*[F.lit(r.text) for r in rules]) if rules else F.array(F.lit(""))
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array(F.lit(""))

    def judged(df: DataFrame, rule: Column, verdict: Column) -> DataFrame:
        return df.select(*[F.col(f"`{c}`") for c in keep], rule.alias("rule"), verdict.alias("verdict"))

    ruled = judged(base.filter(F.col("__rule").isNotNull()), texts[F.col("__rule")], verdicts[F.col("__rule")])
    names = listed.select(canonical(F.col("url")).alias("__key")).filter(F.col("__key") != "").distinct()
    n_blocks = max(1, names.count() // KEYS_PER_BLOCK)
    free = base.filter(F.col("__rule").isNull()).withColumn("__key", canonical(F.col(url)))
    none = F.lit(None).cast("string")
    # a row that meets no block, or a block without its bits, is free at once; the others are
    # looked up in the list itself
    held = mark_possible(free, "__key", bloom_filter(names, "__key", n_blocks), n_blocks)
    clear = judged(held.filter(~F.col("__possible")), none, F.lit("allow"))
    exact = names.select(F.col("__key"), F.lit(True).alias("__listed"))
    hits = held.filter("__possible").join(exact, "__key", "left")
    blocked = judged(hits, none, F.when(F.col("__listed"), "block").otherwise("allow"))
    return ruled.unionByName(clear).unionByName(blocked)
