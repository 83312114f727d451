"""How filters interact: what each removes in every order, counted by a stream that takes back.

Files arrive as micro-batches of an available-now stream. Four filters judge a text by itself, the
fifth by all texts: a document fails it when a smaller id has the same text. The smallest id of a
text seen so far is kept in keyed state with the failures of its documents. When a smaller one
arrives, the earlier documents' count is taken back from the part's counter of their failures and
given to the one with the fifth failure added. A counter is the sum of all such changes, so the
report follows from one small row a part and set of failures, whatever the number of orders.

Before the shuffle each task folds equal texts together: only the rows of its smallest id can still
change, all others fail for sure and are mere counts. So a text that holds a third of all rows
sends a few rows a task. State is kept for cells of texts (``TEXTS_PER_CELL`` on average), so one
call of the state function serves many texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chromloom.llm.common import stage_path, stored

FILTERS = "ABCDE"
#: Bits of a mask: a failure of each filter, then the labels.
SAME_TEXT, GOOD, TOXIC = 1 << 4, 1 << 5, 1 << 6
#: Micro-batches that the files there at the start are dealt into.
BATCHES = 4
#: Texts of a cell of state on average, and rows of the table for each partition of state.
TEXTS_PER_CELL, ROWS_PER_PARTITION = 512, 1_000_000
#: State on local disk, so that it need not fit in memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Partitions of state share bounded memory on an executor, and set no disk aside in advance, which
#: would be more than a small one ever holds.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}

DELTAS = "part string, mask int, n long"


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, key, mask`` of documents: the failures that a text shows by itself."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text.alias("text"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"))
    sizes = seen.select(
        "doc_id", "part", "text", F.size("words").cast("long").alias("words"), F.size(F.array_distinct("words")).cast("long").alias("distinct"))
    fails = (
        F.col("words") < 200, 100 * F.col("distinct") < 50 * F.col("words"),
        100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.length("text"), F.col("text").rlike(r"[#$%&*|]"),
    )
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return sizes.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), mask.cast("int").alias("mask"))


def label_bits(labels: DataFrame) -> DataFrame:
    """``label_id, bits`` of every labelled document; one of several rows with a label is enough."""
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        (F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0))).cast("int").alias("bits"))


def _fold(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task folded: ``key`` and ``doc_id`` only stay on documents of the task's smallest
    id of a text. Documents that can't change any more have no key; a null id is smaller than
    nothing and has nothing smaller, so it never fails the fifth filter."""
    held: pd.DataFrame | None = None

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        known = x["key"].notna()
        free, rest = x[known], x[~known]
        least = free.groupby("key")["doc_id"].transform("min")
        late = (free["doc_id"] > least).to_numpy()
        done = free[late].assign(key=None, doc_id=0)
        done["mask"] = done["mask"] | SAME_TEXT
        x = pd.concat([free[~late], rest, done])
        return x.groupby(["key", "doc_id", "part", "mask"], dropna=False, as_index=False, sort=False)["n"].sum()

    for batch in batches:
        x = batch.to_pandas().assign(n=1)
        no_id = x["doc_id"].isna()
        x.loc[no_id, "key"] = None
        x["doc_id"] = x["doc_id"].fillna(0).astype(np.int64) if no_id.any() else x["doc_id"].astype(np.int64)
        held = fold(x if held is None else pd.concat([held, x]))
    if held is None or held.empty:
        return
    key = pa.array([None if isinstance(k, float) else k for k in held["key"]], pa.binary())
    cell = np.array([int.from_bytes((k or p.encode())[:7], "big") % cells for k, p in zip(key.to_pylist(), held["part"])], np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(cell), key, pa.array(held["doc_id"]), pa.array(held["part"], pa.string()), pa.array(held["mask"], pa.int32()), pa.array(held["n"], pa.int64())],
        names=["cell", "key", "doc_id", "part", "mask", "n"])


_STATE = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])


def _pack(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _STATE) as out:
        out.write_table(pa.Table.from_pandas(rows, _STATE, preserve_index=False))
    return sink.getvalue().to_pybytes()


def take_in(held: pd.DataFrame, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """``(rows of the smallest ids, changes of the counters)`` after new rows of a cell."""
    settled = new["key"].isna()
    new = new[~settled].assign(old=False) if settled.any() else new.assign(old=False)
    every = pd.concat([held.assign(old=True), new], ignore_index=True)
    least = every["doc_id"] == every.groupby("key")["doc_id"].transform("min")
    first = every[least & ~every["old"]]
    late = every[~least].assign(mask=every["mask"] | SAME_TEXT)
    back = every[~least & every["old"]]
    changes = [first, late, back.assign(n=-back["n"])]
    held = every[least].groupby(["key", "doc_id", "part", "mask"], as_index=False, sort=False)["n"].sum()
    return held, pd.concat(changes)[["part", "mask", "n"]]


def _keep_least(_: tuple, chunks: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """State function of a cell: its texts' smallest ids so far; yields changes of the counters."""
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else _STATE.empty_table().to_pandas()
    changes = []
    for chunk in chunks:
        settled = chunk["key"].isna()
        changes.append(chunk.loc[settled, ["part", "mask", "n"]])
        held, more = take_in(held, chunk.loc[~settled, ["key", "doc_id", "part", "mask", "n"]])
        changes.append(more)
        changes = [pd.concat(changes).groupby(["part", "mask"], as_index=False)["n"].sum()]
    state.update((_pack(held),))
    moved = changes[0][changes[0]["n"] != 0]
    if len(moved):
        yield moved


def start(docs: DataFrame, labels: DataFrame, folder: str, rows: int) -> StreamingQuery:
    """Count a stream of documents into ``folder``; ``rows``, about the number of rows to come,
    sets how finely state is cut. The same folder with more files goes on where it stopped."""
    spark = docs.sparkSession
    cells = max(1, rows // TEXTS_PER_CELL)
    settings = {
        "spark.sql.shuffle.partitions": str(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_PARTITION))),
        **STATE_SETTINGS,
    }
    # a null id has no label: such rows are dealt by their text instead of going to one task
    deal = F.coalesce(F.col("doc_id"), F.xxhash64("key"))
    marked = judged(docs).join(labels, (deal == F.col("label_id")) & F.col("doc_id").isNotNull(), "left").select(
        "key", "doc_id", "part", F.col("mask").bitwiseOR(F.coalesce("bits", F.lit(0))).alias("mask"))
    folded = marked.mapInArrow(lambda batches: _fold(batches, cells), "cell long, key binary, doc_id long, part string, mask int, n long")
    changes = folded.groupBy("cell").applyInPandasWithState(_keep_least, DELTAS, "held binary", "append", "NoTimeout")
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return changes.writeStream.format("parquet").option("path", f"{folder}/changes").option(
            "checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """``part, mask, n`` after all changes so far."""
    return spark.read.schema(DELTAS).parquet(f"{folder}/changes").groupBy("part", "mask").agg(F.sum("n").alias("n")).filter("n <> 0")


def _orders() -> list[tuple[str, int, int, int]]:
    """``(order, step, bit of the filter, bits of the filters before it)`` of all orders."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            rows.append(("".join(FILTERS[k] for k in order), step + 1, 1 << f, before))
            before |= 1 << f
    return rows


def report(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step, from counters of masks."""
    orders = counts.sparkSession.createDataFrame(_orders(), "filter_order string, step int, bit int, before int")
    places = Counter((bit, before) for _, _, bit, before in _orders())  # 80 of them
    place = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("bit", "before", "orders"), (*k, v))]) for k, v in sorted(places.items())])
    fails, n = F.col("mask"), F.col("n")
    hit, gone = fails.bitwiseAND(F.col("bit")) != 0, fails.bitwiseAND(F.col("before")) != 0
    of = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0)).cast("long")
    per_place = counts.select("*", F.inline(place)).groupBy("part", "bit", "before", "orders").agg(
        of(~hit & ~gone).alias("kept"), of(hit & ~gone).alias("removed"), of(hit & gone).alias("redundant"),
        of(fails.bitwiseAND(F.lit(31)) == F.col("bit")).alias("unique_fails"),
        of(hit & ~gone & (fails.bitwiseAND(F.lit(GOOD)) != 0)).alias("good_lost"),
        of(hit & ~gone & (fails.bitwiseAND(F.lit(TOXIC)) != 0)).alias("toxic_lost"))
    shares = per_place.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return per_place.drop("orders").join(shares, ["part", "bit"]).join(F.broadcast(orders), ["bit", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Counts of documents for every part, order of the five filters and step.

    ``path`` holds Parquet files of documents (doc_id, text, source; other columns are left out),
    ``labels`` has doc_id, quality and toxic. Null text and source count as empty. A null doc_id is
    smaller than nothing and has nothing smaller: its document never fails the fifth filter nor
    makes others fail, and has no label. Repeated rows count as often as they are there, and don't
    fail the fifth filter by each other. A document with several label rows has a label if one row
    has. Without documents the result is empty. The files are dealt into about ``batches``
    micro-batches.
    """
    docs = spark.read.parquet(path)
    folder = stage_path(spark, "filter-audit")
    bits = stored(label_bits(labels), "filter-audit-labels")
    spark.createDataFrame([], DELTAS).write.parquet(f"{folder}/changes")  # so that it can be read without a batch
    per = max(1, -(-len(docs.inputFiles()) // batches))
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"  # a stream takes a single file only as a pattern
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", per).parquet(pattern)
    start(stream, bits, folder, docs.count()).awaitTermination()
    return report(counters(spark, folder))
