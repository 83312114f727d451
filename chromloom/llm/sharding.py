"""Sharding by longest processing time: groups of equal texts, largest first, each to the
least-loaded shard through a heap.

The heap must see its items in one place, so their number is bounded whatever the input: a group
larger than 1/``PIECES`` of all bytes is an item of its own (fewer than ``PIECES`` such groups can
exist), and all smaller groups are dealt by hash into ``PIECES`` bundles, one bundle in sixteen
cut again into sixteen, so that the last items placed are small. Bytes of groups and items are
sums by key with partial aggregation. A shard's slots are counted in cells of bounded size (a part
of an item) whose offsets are a running sum over cells, so no window holds a whole shard or group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromloom.llm.common import stored, with_columns

#: Groups above 1/PIECES of all bytes are placed alone, the others in that many bundles.
PIECES = 8192
#: Rows of a cell on average: what one window group sorts.
CELL_ROWS = 4096
#: Bytes counted for a row besides its text.
ROW_BYTES = 16


def schedule(items: Iterable[tuple[int, int]], n_shards: int) -> list[tuple[int, int]]:
    """``(item, shard)``: items ``(id, bytes)`` by falling size, each to the shard with the least
    bytes so far; ties to the smaller item id and the smaller shard."""
    heap = [(0, s) for s in range(n_shards)]
    placed = []
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed.append((item, shard))
        heapq.heappush(heap, (load + size, shard))
    return placed


def _bundle(group: Column) -> Column:
    """A negative item id for a small group, so that it meets no group's own id."""
    b = F.pmod(F.xxhash64(group, F.lit("bundle")), F.lit(PIECES))
    part = F.pmod(F.xxhash64(group, F.lit("part")), F.lit(16))
    return -1 - (b * 16 + F.when(F.pmod(b, F.lit(16)) == 0, part).otherwise(0))


def assign_shards(docs: DataFrame, n_shards: int, text: str = "text", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add size, text_crc32, law (``bytes``), shard, slot and grown_shard (null) to every row.

    Size is the UTF-8 length of the text plus 16; a null text counts as an empty one and shares
    its group. Rows of equal text share a shard; slots run gapless from 0 in each shard. Repeated
    rows each get a slot of their own. Null order columns come first. An empty table gives no
    rows. Input columns with one of the added names give way.
    """
    named = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in named])
    body = F.coalesce(F.col(text), F.lit(""))
    # two texts of one 64-bit hash would only stay together; the sign keeps bundles apart
    group = F.xxhash64(body).bitwiseAND(F.lit((1 << 62) - 1))
    base = with_columns(docs, {
        "size": F.octet_length(body).cast("long") + ROW_BYTES, "text_crc32": F.crc32(body).cast("long"),
    }).withColumn("__group", group)
    small = stored(base.select(*dict.fromkeys(["size", "text_crc32", "__group", *order])), "op9-rows")
    groups = small.groupBy("__group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    total = small.agg(F.sum("size")).first()[0] or 0
    # fewer than PIECES groups can pass this bound
    giants = groups.filter(F.col("bytes") * PIECES > total).select("__group", F.lit(True).alias("__alone"))
    giants = stored(giants, "op9-giants")

    def itemised(df: DataFrame) -> DataFrame:
        alone = df.join(F.broadcast(giants), "__group", "left")
        return alone.withColumn("__item", F.when(F.col("__alone"), F.col("__group")).otherwise(_bundle(F.col("__group")))).drop("__alone")

    # at most PIECES groups of their own and PIECES * 31 / 16 bundles
    items = itemised(groups).groupBy("__item").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    rows_of = {r["__item"]: r["rows"] for r in items}
    plan = docs.sparkSession.createDataFrame(
        [(item, shard, -(-rows_of[item] // CELL_ROWS)) for item, shard in schedule([(r["__item"], r["bytes"]) for r in items], n_shards)],
        "__item long, shard int, __parts long",
    )

    def celled(df: DataFrame) -> DataFrame:
        spread = F.pmod(F.xxhash64(*order, "text_crc32"), F.col("__parts"))
        return itemised(df).join(F.broadcast(plan), "__item").withColumn("__cell", spread)

    cell = ["shard", "__item", "__cell"]
    before = Window.partitionBy("shard").orderBy("__item", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        celled(small).groupBy(*cell).agg(F.count("*").alias("__n"))
        .select(*cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    within = Window.partitionBy(*cell).orderBy(*order, "text_crc32", "size")
    done = celled(base).withColumn("__row", F.row_number().over(within)).join(offsets, cell)
    return done.select(
        *[F.col(f"`{c}`") for c in docs.columns], "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__before") + F.col("__row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
