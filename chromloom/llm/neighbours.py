"""Nearest neighbours by inner product: p-stable hashing with several probes a table.

Vectors are lifted so that the largest inner product is the smallest Euclidean distance: members
are scaled by the largest norm and get one more component that fills their norm up to 1, queries
are scaled to norm 1. Members whose norms differ by more than a factor of ``2 ** BAND`` are scaled
apart, as bands with tables of their own, so one long vector doesn't crowd all others into a bucket. A table cuts ``FUNCTIONS`` Gaussian projections into cells of ``WIDTH``; a
vector's cells name its bucket. A query visits its own bucket and those a step away in some
projections, in the order of their estimated success (the squared distances to the crossed
borders), and candidates of all tables are merged and ranked by exact products.

The number of probes is fitted on a bounded sample of vectors (``SAMPLE``) to a recall of ``GOAL``
there. Every vector is indexed. Equal vectors are one class, so a vector that fills a third of the
table is hashed and compared once. Buckets are dealt into groups of bounded size, larger groups
into chunks; a query goes to each chunk of the groups it probes, and a task returns one short list
for each query and chunk. A query that has met fewer than ``k + SPARE`` others so far, as in a small table
or far from all else, then visits all remaining buckets of one table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromloom.llm.common import bound_batches, stored
from chromloom.llm.words import mix64

TABLES, FUNCTIONS, WIDTH = 6, 7, 2.0
#: Vectors and queries of the sample that the number of probes is fitted on, and the recall there.
SAMPLE, SAMPLE_QUERIES, GOAL = 20_000, 200, 0.95
#: Members of a chunk, on average; queries compared with it at a time.
GROUP_ROWS, QUERY_BLOCK = 4096, 512
#: Candidates kept beyond those asked for, so that rounding can't lose a tie.
SPARE = 8
#: Powers of two that the norms of a band span, and bands at most; the last one takes all lower norms.
BAND, BANDS = 4, 16

_STEPS = np.array(list(itertools.product((-1, 0, 1), repeat=FUNCTIONS)))


def projections(dim: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Directions (tables, dim + 1, functions) and shifts (tables, functions)."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(TABLES, dim + 1, FUNCTIONS)), rng.uniform(0, WIDTH, (TABLES, FUNCTIONS))


class Norms(NamedTuple):
    """Lower ends of the bands, as exponents of norms, falling, and the largest norm in each."""

    low: np.ndarray
    largest: np.ndarray

    def band(self, x: np.ndarray) -> np.ndarray:
        exponent = np.frexp(np.sqrt((x * x).sum(1)))[1]
        return np.minimum((exponent[:, None] < self.low[None, :]).sum(1), len(self.low) - 1)

    def scale(self, x: np.ndarray) -> np.ndarray:
        return self.largest[self.band(x)][:, None]


def norm_bands(exponents: list[tuple[int, float]]) -> Norms:
    """Bands from ``(exponent, largest norm)`` of the norms that occur."""
    low, largest = [], []
    for exponent, norm in sorted(exponents, reverse=True):
        if not low or exponent < low[-1] and len(low) < BANDS:
            low.append(exponent - BAND + 1)
            largest.append(norm)
    return Norms(np.array(low or [0]), np.array(largest or [1.0]))


def lifted(x: np.ndarray, largest: float | np.ndarray, query: bool) -> np.ndarray:
    """Vectors with the component that turns inner products into distances."""
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    if query:
        return np.hstack([x / norm, np.zeros_like(norm)])
    return np.hstack([x / largest, np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2))])


def _keys(cells: np.ndarray, table: int) -> np.ndarray:
    """64-bit bucket names of cells (last axis)."""
    key = np.full(cells.shape[:-1], table + 1, np.uint64)
    for k in range(cells.shape[-1]):
        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + cells[..., k].astype(np.int64).view(np.uint64))
    return key


def buckets(x: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bucket of each lifted vector in each table: (tables, rows)."""
    return np.stack([_keys(np.floor((x @ a + b) / WIDTH), t) for t, (a, b) in enumerate(zip(*hashes))])


def probes(q: np.ndarray, hashes: tuple[np.ndarray, np.ndarray], many: int) -> np.ndarray:
    """The first ``many`` buckets of each lifted query in each table: (tables, rows, many)."""
    out = []
    for t, (a, b) in enumerate(zip(*hashes)):
        at = (q @ a + b) / WIDTH
        cell = np.floor(at)
        part = at - cell
        cost = np.stack([part, np.zeros_like(part), 1 - part], 2) ** 2  # to the border below, none, above
        total = sum(cost[:, k][:, _STEPS[:, k] + 1] for k in range(FUNCTIONS))
        best = np.argsort(total, axis=1, kind="stable")[:, :many]
        out.append(_keys(cell[:, None, :] + _STEPS[best], t))
    return np.stack(out)


def fitted_probes(sample: np.ndarray, hashes, norms: Norms, k: int, goal: float = GOAL) -> int:
    """The fewest probes a table that find ``goal`` of the sample's own neighbours."""
    q = sample[:SAMPLE_QUERIES]
    if len(sample) <= k + 1:
        return len(_STEPS)
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    held = buckets(lifted(sample, norms.scale(sample), False), hashes)
    asked = probes(lifted(q, 1.0, True), hashes, len(_STEPS))  # the same in every band
    first = np.full((len(q), k), len(_STEPS) + 1)
    for t in range(TABLES):
        for i in range(len(q)):
            order = np.argsort(asked[t, i], kind="stable")
            at = np.searchsorted(asked[t, i][order], held[t][near[i]])
            at = order[np.minimum(at, len(order) - 1)]
            first[i] = np.minimum(first[i], np.where(asked[t, i][at] == held[t][near[i]], at + 1, len(_STEPS) + 1))
    need = np.sort(first.ravel())[int(np.ceil(goal * first.size)) - 1]
    return int(min(need, len(_STEPS)))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    return (mix64(keys) % np.uint64(groups)).astype(np.int32)


def _salted(keys: np.ndarray, band: np.ndarray | int) -> np.ndarray:
    """Bucket names of a band; the first band's stay."""
    return keys ^ (np.asarray(band, np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _indexed(dim: int, norms: Norms, groups: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = projections(dim)
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            if not len(x):
                continue
            keys = _salted(buckets(lifted(x, norms.scale(x), False), hashes), norms.band(x)[None, :])
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(_group_of(keys[t], groups)), pa.array(keys[t].view(np.int64)), batch.column(0), batch.column(1)],
                    ["tab", "part", "bucket", "rep", "vec"])

    return rows


def _asking(dim: int, norms: Norms, groups: int, many: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = projections(dim)
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            for lo in range(0, len(x), 128):
                some, ids = x[lo:lo + 128], _ids(batch.column(0))[lo:lo + 128]
                asked = probes(lifted(some, 1.0, True), hashes, many)
                asked = np.concatenate([_salted(asked, b) for b in range(len(norms.low))], axis=2)
                for t in range(TABLES):
                    row = np.repeat(np.arange(len(some)), asked.shape[2])
                    keys = asked[t].ravel()
                    part = _group_of(keys, groups)
                    order = np.lexsort((part, row))
                    row, keys, part = row[order], keys[order], part[order]
                    head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (part[1:] != part[:-1]))))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)).astype(np.int32)), pa.array(keys.view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(head), t, np.int32)), pa.array(part[head]), pa.array(ids[row[head]]), batch.column(1).take(pa.array(lo + row[head])), lists],
                        ["tab", "part", "query", "qvec", "asked"])

    return rows


_FOUND = pa.schema([("query", pa.int64()), ("reps", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def _cut(query: np.ndarray, rep: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query by rounded score and rep, each rep once."""
    order = np.lexsort((rep, query))
    query, rep, score = query[order], rep[order], score[order]
    once = np.concatenate(([True], (query[1:] != query[:-1]) | (rep[1:] != rep[:-1]))) if len(query) else np.zeros(0, bool)
    query, rep, score = query[once], rep[once], score[once]
    order = np.lexsort((rep, -_rounded(score), query))
    query, rep, score = query[order], rep[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    keep = place < k
    return query[keep], rep[keep], score[keep]


def _rounded(score: np.ndarray) -> np.ndarray:
    """Scores to 12 significant digits: products in another order of summing stay equal."""
    with np.errstate(divide="ignore"):
        unit = 10.0 ** (np.floor(np.log10(np.maximum(np.abs(score), 1e-300))) - 11)
    return np.where(score == 0, 0.0, np.round(score / unit) * unit)


def _as_lists(query: np.ndarray, rep: np.ndarray, score: np.ndarray) -> pa.Table:
    heads = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    ends = pa.array(np.append(heads, len(query)).astype(np.int32))
    return pa.Table.from_arrays(
        [pa.array(query[heads]), pa.ListArray.from_arrays(ends, pa.array(rep)), pa.ListArray.from_arrays(ends, pa.array(score))], schema=_FOUND)


def _compared(dim: int, k: int):
    def chunk(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        key = _ids(members.column("bucket"))
        order = np.argsort(key, kind="stable")
        key, rep, x = key[order], _ids(members.column("rep"))[order], _matrix(members.column("vec"), dim)[order]
        q, qid = _matrix(queries.column("qvec"), dim), _ids(queries.column("query"))
        asked = queries.column("asked").combine_chunks()
        want = asked.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(q)), np.diff(asked.offsets.to_numpy()))
        here = np.isin(want, key)
        want, row = want[here], row[here]
        by_row = np.argsort(row, kind="stable")
        want, row = want[by_row], row[by_row]
        kept = []
        for lo in range(0, len(q), QUERY_BLOCK):
            a, b = np.searchsorted(row, [lo, lo + QUERY_BLOCK])
            wanted, rows = want[a:b], row[a:b] - lo
            order = np.argsort(wanted, kind="stable")
            wanted, rows = wanted[order], rows[order]
            names, first = np.unique(wanted, return_index=True)
            score = np.full((min(QUERY_BLOCK, len(q) - lo), len(x)), -np.inf)
            for name, mine in zip(names, np.split(rows, first[1:])):
                s, e = np.searchsorted(key, [name, name + 1]) if name < np.iinfo(np.int64).max else (np.searchsorted(key, name), len(key))
                score[mine, s:e] = q[lo + mine] @ x[s:e].T
            if len(x) > k:
                limit = -np.partition(-score, k - 1, axis=1)[:, k - 1:k]
                near = (score >= limit - 1e-11 * np.abs(np.where(np.isfinite(limit), limit, 0))) & (score > -np.inf)
            else:
                near = score > -np.inf
            i, j = np.nonzero(near)
            kept.append(_cut(qid[lo + i], rep[j], score[i, j], k))
        return _as_lists(*(np.concatenate([p[c] for p in kept]) for c in range(3)))

    return chunk


def _merged(k: int):
    def merge(found: pa.Table) -> pa.Table:
        lists = found.column("reps").combine_chunks()
        query = np.repeat(_ids(found.column("query")), np.diff(lists.offsets.to_numpy()))
        rep = lists.flatten().to_numpy(zero_copy_only=False)
        score = found.column("scores").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        q, r, _ = _cut(query, rep, score, k)
        return pa.table({"query": pa.array(q, pa.int64()), "rep": pa.array(r, pa.int64())})

    return merge


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", dim: int | None = None) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score.

    Queries are rows whose id is divisible by ``every``; candidates are all rows but the query's
    own. Nearest is the largest inner product in double precision, ties go to the smaller id.
    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without an id or of another length than ``dim`` (the most frequent one where not given, the
    shorter of two as frequent). Rows that repeat an id count once; of different vectors of one id
    the one with the smallest hash counts. An empty table gives no rows. Other columns are not
    used.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    # floats travel as they are: all products are of doubles
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("v")
    sound = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(kind).alias("v")).filter(
        F.col("id").isNotNull() & v.isNotNull() & sound)
    if dim is None:
        common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = common["d"] if common else 1
    keyed = rows.filter(F.size("v") == dim).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit("again"), "v")})
    keyed = stored(keyed.groupBy("id").agg(F.min(F.struct("k1", "k2", "v")).alias("s")).select("id", "s.k1", "s.k2", "s.v"), "op7-rows")
    asked = (F.col("id") % every == 0).cast("int")
    classes = stored(
        keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.max(asked).alias("asked"), F.first("v").alias("v")), "op7-classes")
    sizes = classes.select("v").mapInArrow(_norms(dim), "exponent int, norm double").groupBy("exponent").agg(F.max("norm").alias("norm"), F.count("*").alias("n"))
    sizes = sizes.collect()  # exponents of doubles: some 2,000 at most
    n, norms = sum(r.n for r in sizes), norm_bands([(r.exponent, r.norm) for r in sizes])
    base = classes.select("rep", "v", "asked")
    sample = _matrix(classes.orderBy("k1", "k2").select("v").limit(SAMPLE).toArrow().column("v"), dim)
    many = fitted_probes(sample, projections(dim), norms, k)
    groups = -(-n // GROUP_ROWS) or 1
    members = base.select("rep", "v").mapInArrow(_indexed(dim, norms, groups), f"tab int, part int, bucket long, rep long, vec {kind}")
    members = stored(members, "op7-index")
    chunks = members.groupBy("tab", "part").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("chunks"))
    dealt = members.join(chunks, ["tab", "part"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).drop("chunks")
    asking = base.filter("asked = 1").select("rep", "v").mapInArrow(
        _asking(dim, norms, groups, many), f"tab int, part int, query long, qvec {kind}, asked array<long>")
    asking = asking.join(chunks, ["tab", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    place, wide = ["tab", "part", "chunk"], k + 1 + SPARE

    def ranked(members: DataFrame, queries: DataFrame, label: str) -> DataFrame:
        found = members.groupBy(*place).cogroup(queries.groupBy(*place)).applyInArrow(
            _compared(dim, wide), "query long, reps array<long>, scores array<double>")
        slots = F.pmod(F.xxhash64("query"), F.lit(max(1, n // every // 256)))
        return stored(found.withColumn("slot", slots).groupBy("slot").applyInArrow(_merged(wide), "query long, rep long"), label)

    best = ranked(dealt, asking, "op7-best")
    # queries with too few candidates visit every bucket of the first table, each a part of one chunk
    enough = best.groupBy("query").agg(F.count("*").alias("met")).filter(F.col("met") >= min(wide, n)).select(F.col("query").alias("rep"))
    short = stored(base.filter("asked = 1").select("rep", "v").join(enough, "rep", "left_anti"), "op7-short")
    if not short.isEmpty():
        one = {"tab": F.lit(0), "part": F.lit(0), "bucket": F.lit(0).cast("long")}
        rest = members.filter("tab = 0").withColumns({**one, "chunk": F.pmod(F.xxhash64("rep"), F.lit(groups)).cast("int")})
        all_ = short.select(F.lit(0).alias("tab"), F.lit(0).alias("part"), F.col("rep").alias("query"), F.col("v").alias("qvec"),
                            F.array(F.lit(0).cast("long")).alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("chunk"))
        whole = ranked(rest, all_, "op7-rest")
        best = best.join(short.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(whole)
    return _expanded(best, classes, keyed, k, every)


def _norms(dim: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = np.sqrt((_matrix(batch.column(0), dim) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.frexp(norm)[1].astype(np.int32)), pa.array(norm)], ["exponent", "norm"])

    return rows


def _expanded(best: DataFrame, classes: DataFrame, keyed: DataFrame, k: int, every: int) -> DataFrame:
    """Exact scores of the merged candidates, and ids in place of classes."""
    vec = classes.select("rep", "v")
    exact = (
        best.join(vec, "rep").join(vec.select(F.col("rep").alias("query"), F.col("v").alias("qv")), "query")
        .select("query", "rep", F.aggregate(
            F.zip_with("v", "qv", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, e: s + e).alias("score"))
    )
    # the k + 1 smallest ids of each vector that several rows share
    several = classes.filter("rep <> last").select("k1", "k2", "rep")
    shared = keyed.select("id", "k1", "k2").join(several, ["k1", "k2"]).select("rep", "id").distinct()
    first = Window.partitionBy("rep").orderBy("id")
    ids = shared.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    listed = exact.join(ids, "rep", "left").withColumn("id", F.explode(F.coalesce("ids", F.array("rep"))))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = (
        listed.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
        .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("at", "id", "score"))).alias("near"))
    )
    asked = keyed.filter(F.col("id") % every == 0).select("id", "k1", "k2").distinct().join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
    others = F.filter("near", lambda c: c["id"] != F.col("query_id"))
    lists = asked.select(F.col("id").alias("query_id"), F.col("rep").alias("query")).join(top, "query").select("query_id", F.slice(others, 1, k).alias("near"))
    return lists.select("query_id", F.posexplode("near").alias("at", "c")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("c.id").alias("vec_id"), F.col("c.score").alias("score"))
