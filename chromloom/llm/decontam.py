"""Benchmark decontamination by greedy string tiling.

1. A benchmark item becomes its words (letters and digits, lower-case) and the seeds in them: all
   runs of ``MIN_MATCH`` words, hashed.
2. A filter of fixed size (``FILTER_BITS``) of the seeds goes to every task. Each distinct text is
   read once; of its words only stretches covered by possible seeds are kept, with a seed's first
   word on each position. Most texts keep nothing.
3. An exact join of those seeds with the items' seeds gives candidate pairs of text and item.
4. For each pair the longest common runs of unmarked words are marked, longest first, found with
   Karp-Rabin hashes of falling length, until none of ``MIN_MATCH`` words is left. The marked part
   of the item is its coverage; passages that were moved around count like those in order.

Any run of at least ``MIN_MATCH`` common words consists of seeds, so the kept stretches hold all
that tiling can mark, and the filter only lets through more than it must.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromloom.llm.common import bound_batches, stored
from chromloom.llm.words import by_text, byte_pieces, mix64, word_values

#: Words of the shortest match that is marked, and the part of an item that must be covered.
MIN_MATCH, COVERAGE = 4, 0.5
#: Bits of the seed filter: its size is this whatever the benchmark's.
FILTER_BITS = 1 << 22

_U = np.uint64
_STEP = _U(0x9FB21C651E98DF25)


def seeds(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    many = max(0, len(words) - n + 1)
    out = words[:many].copy()
    for k in range(1, n):
        out = mix64(out * _STEP + words[k:k + many])
    return out


def _run_values(words: list[int], n: int) -> Iterator[tuple[int, int]]:
    """``(start, value)`` of every run of ``n`` words: a Karp-Rabin hash rolled along."""
    base, mod = 0x5851F42D4C957F2D, (1 << 61) - 1
    out, top = 0, pow(base, n - 1, mod)
    for k, w in enumerate(words):
        if k >= n:
            out -= words[k - n] * top
        out = (out * base + w) % mod
        if k >= n - 1:
            yield k - n + 1, out


def _free_stretches(words: np.ndarray, marked: np.ndarray, least: int) -> list[tuple[int, list[int]]]:
    """Unmarked stretches of at least ``least`` words: ``(start, words)``."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], marked, [True])).astype(np.int8)))
    return [(int(a), words[a:b].tolist()) for a, b in zip(edge[::2], edge[1::2]) if b - a >= least]


def _longest(item: np.ndarray, marked_item: np.ndarray, text: np.ndarray, marked_text: np.ndarray, least: int, most: int) -> int:
    """Length of the longest common unmarked run, at most ``most``; 0 if below ``least``."""
    left = _free_stretches(item, marked_item, least)
    right = _free_stretches(text, marked_text, least)

    def common(n: int) -> bool:
        known = {v for _, s in left for _, v in _run_values(s, n)}
        return bool(known) and any(v in known for _, s in right for _, v in _run_values(s, n))

    lo, hi = least - 1, min(most, max((len(s) for _, s in left), default=0), max((len(s) for _, s in right), default=0))
    while lo < hi:  # a common run of n words holds common runs of all shorter lengths
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if common(mid) else (lo, mid - 1)
    return lo if lo >= least else 0


def tiles(item: np.ndarray, text: np.ndarray, least: int = MIN_MATCH, breaks: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiling: ``(start in item, start in text, words)`` of non-overlapping equal runs.

    The longest unmarked common run is marked first; of equal length the first in the item, then
    the first in the text. ``breaks``: positions of the text that no run may hold.
    """
    marked_item = np.zeros(len(item), bool)
    marked_text = np.zeros(len(text), bool) if breaks is None else breaks.copy()
    found, most = [], len(item)
    while n := _longest(item, marked_item, text, marked_text, least, most):
        places: dict[int, list[int]] = {}
        for at, s in _free_stretches(text, marked_text, n):
            for k, v in _run_values(s, n):
                places.setdefault(v, []).append(at + k)
        before = len(found)
        for at, s in _free_stretches(item, marked_item, n):
            for k, v in _run_values(s, n):
                i = at + k
                if marked_item[i:i + n].any():
                    continue
                for j in places.get(v, ()):
                    if not marked_text[j:j + n].any() and np.array_equal(item[i:i + n], text[j:j + n]):
                        marked_item[i:i + n] = marked_text[j:j + n] = True
                        found.append((i, j, n))
                        break
        most = n if len(found) > before else n - 1  # equal hashes of unequal runs mark nothing
    return found


def _item_rows(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in byte_pieces(batch.column(1)):
                value, text, _, _ = word_values(data, offsets, letters_only=True)
                n = len(offsets) - 1
                at = by_text(text, n)
                words = [value[at[k]:at[k + 1]] for k in range(n)]
                counted = [np.unique(seeds(w, least), return_counts=True) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), _list(words), _list([s for s, _ in counted]), _list([t.astype(np.uint64) for _, t in counted])],
                    ["item_id", "item", "seeds", "times"])

    return rows


def _list(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *[len(p) for p in parts]]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def seed_filter(spark: SparkSession, items: DataFrame) -> np.ndarray:
    """Bits set at every seed, as bytes: at most FILTER_BITS / 64 rows reach the driver."""
    slot = F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = (
        items.select(F.explode("seeds").alias("seed")).groupBy(F.shiftright(slot, 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).collect()
    )
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return words


def _stretches(bits, least: int):
    """Of each text the words that possible seeds cover, in order, with a break between
    stretches (position of a word of value 0) and the possible seeds."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value.view(np.uint64)
        for batch in batches:
            for first, data, offsets in byte_pieces(batch.column(2)):
                value, text, _, _ = word_values(data, offsets, letters_only=True)
                if len(value) < least:
                    continue
                every = seeds(value, least)
                slot = every & _U(FILTER_BITS - 1)
                hit = (held[slot >> _U(6)] >> (slot & _U(63))) & _U(1) != 0
                hit &= text[: len(every)] == text[least - 1:]
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                rows, starts = np.unique(text[at], return_index=True)
                words, found = [], []
                for mine in np.split(at, starts[1:]):
                    cover = np.unique((mine[:, None] + np.arange(least)).ravel())
                    gaps = np.flatnonzero(np.diff(cover) > 1) + 1
                    words.append(np.insert(value[cover], gaps, _U(0)))
                    found.append(np.unique(every[mine]))
                index = pa.array(rows + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(index), batch.column(1).take(index), _list(words), _list(found)], ["key", "check", "words", "seeds"])

    return kept


def _tiled(least: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            text, item = batch.column("words"), batch.column("item")
            for k in range(batch.num_rows):
                t = text[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                i = item[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                found = tiles(i, t, least, t == 0)
                out.append((sum(n for _, _, n in found), len(found), max((n for _, _, n in found), default=0)))
            marked, many, longest = (pa.array(np.array([o[c] for o in out], np.int64)) for c in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("check"), batch.column("item_id"), batch.column("item_words"), marked, many, longest],
                ["key", "check", "item_id", "item_words", "marked_words", "tiles", "longest_tile"])

    return pairs


def text_key(text: str):
    """Names a text: equal texts share it."""
    body = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(body).alias("key"), F.crc32(body).cast("long").alias("check")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``key, check, item_id, item_words, marked_words, tiles, longest_tile, coverage`` of each
    distinct text and item whose coverage reaches the threshold."""
    spark = docs.sparkSession
    bound_batches(spark)
    items = stored(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).mapInArrow(
            _item_rows(least), "item_id long, item array<long>, seeds array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id()), "op5-items")
    bits = spark.sparkContext.broadcast(seed_filter(spark, items))
    read = docs.select(*text_key(text), F.col(text).alias("text"))
    kept = stored(
        read.mapInArrow(_stretches(bits, least), "key long, check long, words array<long>, seeds array<long>").dropDuplicates(["key", "check"]),
        "op5-stretches")
    asked = kept.select("key", "check", F.explode("seeds").alias("seed"))
    held = items.select("row", F.explode(F.arrays_zip("seeds", "times")).alias("s")).select("row", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"))
    met = asked.join(held, "seed").groupBy("key", "check", "row").agg(F.sum("times").alias("hits"))
    whole = items.select("row", "item_id", "item", F.size("item").cast("long").alias("item_words"))
    # each place of the item where a seed of the text starts lets at most that seed's words be marked
    able = met.join(whole, "row").filter(F.col("hits") * least >= F.col("item_words") * coverage)
    near = able.join(kept.select("key", "check", "words"), ["key", "check"])
    tiled = near.select("key", "check", "item_id", "item_words", "words", "item").mapInArrow(
        _tiled(least), "key long, check long, item_id long, item_words long, marked_words long, tiles long, longest_tile long")
    part = F.col("marked_words") / F.col("item_words")
    return tiled.withColumn("coverage", part).filter(F.col("coverage") >= coverage)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each document and benchmark item that it covers to ``coverage`` or more.

    Null and empty texts hold nothing; an item of fewer than ``least`` words is never covered.
    Repeated documents and repeated items give a row each; a null id stays null. Empty tables give
    no rows. Other columns of the inputs are not used.
    """
    found = contaminated_texts(docs, benchmark, text, **how)
    named = docs.select(F.col(doc_id).alias("doc_id"), *text_key(text))
    return named.join(found, ["key", "check"]).select(
        "doc_id", "item_id", "item_words", "marked_words", "coverage", "tiles", "longest_tile")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows whose text covers no benchmark item, with the input's columns."""
    found = stored(contaminated_texts(docs, benchmark, text, **how).select("key", "check").distinct(), "op5-found")
    key, check = text_key(text)
    keyed = docs.withColumns({"__key": key, "__check": check})
    gone = found.select(F.col("key").alias("__key"), F.col("check").alias("__check"))
    return keyed.join(gone, ["__key", "__check"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
