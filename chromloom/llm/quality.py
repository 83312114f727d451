"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes and words of whole texts, many texts at a time. Trees are grown on
a bounded sample of labelled rows (``SAMPLE_ROWS``), on statistics cut into at most ``BINS``
bins: a split is found from sums of gradients by bin. Grown trees are flattened into arrays of
one length, and a batch of rows walks all of them with array steps, one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromloom.llm.common import bound_batches, stored, with_columns
from chromloom.llm.words import by_text, byte_pieces, word_values

#: Labelled rows that the trees are grown on, at most; the first by a hash of doc_id.
SAMPLE_ROWS = 50_000
BINS, TREES, DEPTH, RATE, LEAST_ROWS, RIDGE = 64, 80, 4, 0.15, 10, 1.0

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "word_bytes_spread", "upper", "lower", "digits", "wide", "blanks", "lines_per_word",
    "stops_per_word", "commas_per_word", "marks", "hashes", "money", "percents", "ands", "stars", "pipes", "shouts", "dashes",
    "quotes", "distinct_words", "repeats", "repeats_2", "top_word", "distinct_pairs", "capital_words", "mark_words", "long_words",
    "short_words", "stop_ends", "longest_run",
]

_SETS = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "wide": range(128, 192), "blanks": [32],
    "hashes": b"#", "money": b"$", "percents": b"%", "ands": b"&", "stars": b"*", "pipes": b"|", "shouts": b"!", "dashes": b"-_=~",
    "quotes": b"\"'`",
}
_CLASS = {k: np.isin(np.arange(256), list(v)) for k, v in _SETS.items()}
_LETTER = _CLASS["upper"] | _CLASS["lower"] | _CLASS["digits"] | (np.arange(256) >= 128)
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_MARK = ~_LETTER & ~_BLANK


def _piece(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of the texts of one piece: one row a text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offsets)
    if not len(data):
        return out
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256)
    value, text, start, end = word_values(data, offsets)
    words = np.bincount(text, minlength=n)
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)
    f = {name: counts[:, mask].sum(1) / per_byte for name, mask in _CLASS.items()}
    f["log_bytes"], f["log_words"] = np.log1p(size), np.log1p(words)
    length = end - start
    f["word_bytes"] = np.bincount(text, length, n) / per_word
    f["word_bytes_spread"] = np.sqrt(np.maximum(0, np.bincount(text, length.astype(float) ** 2, n) / per_word - f["word_bytes"] ** 2))
    f["lines_per_word"], f["stops_per_word"], f["commas_per_word"] = (counts[:, b] / per_word for b in (10, 46, 44))
    f["marks"] = counts[:, _MARK].sum(1) / per_byte
    first, last = data[start], data[end - 1]
    share = lambda flags: np.bincount(text, flags, n) / per_word
    f["capital_words"], f["mark_words"], f["stop_ends"] = share(_CLASS["upper"][first]), share(_MARK[last] & (last != 46) & (last != 44)), share(last == 46)
    f["long_words"], f["short_words"] = share(length > 12), share(length < 3)
    same = np.zeros(len(value), bool)
    same[1:] = (value[1:] == value[:-1]) & (text[1:] == text[:-1])
    f["repeats"] = share(same)
    two = np.zeros(len(value), bool)
    two[2:] = (value[2:] == value[:-2]) & (text[2:] == text[:-2])
    f["repeats_2"] = share(two)
    # runs of one word
    head = np.flatnonzero(~same)
    run = np.diff(np.append(head, len(value)))
    longest = np.zeros(n)
    np.maximum.at(longest, text[head], run)
    f["longest_run"] = np.log1p(longest)
    pair = value * np.uint64(0x9E3779B97F4A7C15)
    pair[1:] += value[:-1]
    at = by_text(text, n)
    distinct, top, pairs = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(n):
        lo, hi = at[k], at[k + 1]
        if hi > lo:
            s = np.sort(value[lo:hi])
            edge = np.flatnonzero(s[1:] != s[:-1]) + 1
            distinct[k] = len(edge) + 1
            top[k] = np.diff(np.concatenate(([0], edge, [hi - lo]))).max()
            p = np.sort(pair[lo + 1:hi])
            pairs[k] = 1 + np.count_nonzero(p[1:] != p[:-1]) if len(p) else 0
    f["distinct_words"], f["top_word"], f["distinct_pairs"] = distinct / per_word, top / per_word, pairs / per_word
    for k, name in enumerate(FEATURES):
        out[:, k] = f[name]
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics a text; zeros for an empty or null one."""
    rows = [_piece(data, offsets) for _, data, offsets in byte_pieces(texts)]
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


class Trees(NamedTuple):
    """Flattened trees: node ``k`` of tree ``t`` sends a row to ``2k+1`` if its statistic is at
    most the limit, else to ``2k+2``; nodes without a split send all rows left."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float


def score(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row."""
    total = np.full(len(x), trees.base)
    row = np.arange(len(x))
    inner = trees.feature.shape[1]
    for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[row, feature[node]] > limit[node])
        total += leaf[node - inner]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _limits(x: np.ndarray) -> list[np.ndarray]:
    """Borders between bins of each statistic: middles between its quantiles."""
    out = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))
        every = np.unique(column)
        above = every[np.minimum(np.searchsorted(every, values, "right"), len(every) - 1)]
        out.append(np.unique((values + above) / 2)[: BINS - 1])
    return out


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for log loss. Without rows of both labels all rows score the labels' mean
    (0.5 without any row)."""
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    mean = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    if len(np.unique(y)) < 2:
        mean = y.mean() if len(y) else 0.5
        base = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    limits = _limits(x)
    binned = np.stack([np.searchsorted(limit, column, "left") for limit, column in zip(limits, x.T)], 1)
    n, d = binned.shape
    flat = binned + np.arange(d) * BINS
    total = np.full(n, base)
    feature, limit = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf)
    leaf = np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, many = 2 ** depth - 1, 2 ** depth
            place = ((node - first)[:, None] * (d * BINS) + flat).ravel()
            size = many * d * BINS
            sums = [np.bincount(place, np.repeat(v, d), size).reshape(many, d, BINS).cumsum(2) for v in (g, h, np.ones(n))]
            left, all_ = [s[:, :, :-1] for s in sums], [s[:, :, -1:] for s in sums]
            right = [a - b for a, b in zip(all_, left)]
            gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - all_[0] ** 2 / (all_[1] + RIDGE)
            gain[(left[2] < LEAST_ROWS) | (right[2] < LEAST_ROWS)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                j, b = divmod(int(best[k]), BINS - 1)
                if gain[k, j, b] > 1e-6 and b < len(limits[j]):
                    feature[t, first + k], limit[t, first + k] = j, limits[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > limit[t, node])
        g_sum, h_sum = (np.bincount(node - inner, v, leaves) for v in (g, h))
        leaf[t] = RATE * g_sum / (h_sum + RIDGE)
        total += leaf[t, node - inner]
    return Trees(feature, limit, leaf, base)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning: crc32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(1))
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), values], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> Trees:
    """Trees grown on up to ``sample_rows`` labelled rows that are not held out.

    Labels without id or quality are passed over; of several labels of one id the smallest counts.
    The sample's ids are broadcast: their number is bounded by ``sample_rows``.
    """
    bound_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("label"))
    usable = known.filter(F.col("__id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("__id"))).groupBy("__id").agg(F.min("label").alias("label"))
    sample = stored(usable.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows), "op2-sample")
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(sample), "__id").select("label", "text")
    rows = texts.mapInArrow(_measured, "label int, x array<double>").orderBy("x", "label").limit(sample_rows).toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return grow(x, rows.column("label").to_numpy().astype(float))


def scorer(trees: Trees):
    """A column function: score of a text."""

    @F.arrow_udf(T.DoubleType())
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(score(trees, statistics(text)))

    return scored


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Add held_out, score and predicted to every row, judged by the whole text alone.

    Empty and null texts are scored like a text without words. Repeated rows get equal scores.
    A null id is never held out. Without labels of both kinds every row gets the same score.
    An empty table gives no rows. Input columns with one of the added names give way.
    """
    trees = train(docs, labels, doc_id=doc_id, text=text, **how)
    made = with_columns(docs, {"held_out": held_out(F.col(doc_id)), "score": scorer(trees)(F.col(text))})
    return with_columns(made, {"predicted": F.when(F.col("score") >= 0.5, 1).otherwise(0)})
