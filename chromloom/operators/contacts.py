"""Contacts between beads and the maps counted from them.

Three ways give the same pixels: a cell-grid equi-join over exploded beads (all in the JVM),
the same join with every neighbour cell spelled out per pair, and a NumPy cell list over Arrow
batches of whole frames, which counts locally and shuffles only (i, j, n). The last is the
default for bulk counting.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chromloom.functions.joins import attach
from chromloom.functions.numeric import is_finite
from chromloom.functions.skew import row_numbers

CONTACT_RADIUS = 3.0

#: the own cell and the thirteen neighbours that come after it in (x, y, z) order
HALF_SHELL = [o for o in product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]

#: columns of a radius' width, and the own one with the neighbours that come after it
COLUMNS = 2
HALF_COLUMNS = [o for o in product(range(-COLUMNS, COLUMNS + 1), repeat=2) if o >= (0, 0)]

#: cells of all maps that a task counts in place; larger maps are counted by sorting
DENSE_CELLS = 32_000_000


def untile(bead: Column, tile_size: int, padding: int, n_bins: int) -> tuple[Column, Column, Column]:
    """(tile, bin inside the locus, whether the bead is inside the padding-free part)."""
    r = F.pmod(bead, F.lit(tile_size)).cast("int") - padding
    return F.floor(bead / tile_size).cast("int"), r, (r >= 0) & (r < n_bins)


def explode_beads(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per bead from frames with a ``pos`` array of (x, y, z)."""
    return frames.select(*keys, F.posexplode("pos").alias("bead", "_p")).select(
        *keys, "bead", "_p.x", "_p.y", "_p.z"
    )


def untile_beads(
    beads: DataFrame, tile_size: int, padding: int, n_bins: int, n_tiles: int | None = None
) -> DataFrame:
    """Split chain beads into locus copies and drop padding; ``bead`` becomes the locus bin."""
    tile, local, inside = untile(F.col("bead"), tile_size, padding, n_bins)
    if n_tiles is not None:
        inside = inside & (tile < n_tiles)
    return beads.where(inside).withColumn("tile", tile).withColumn("bead", local)


def contacts_within_radius(
    beads: DataFrame, keys: Sequence[str], radius: float = CONTACT_RADIUS
) -> DataFrame:
    """Pairs i < j of one sub-region (``keys``) at distance <= radius: (keys, i, j, d2).

    Beads fall into cells as wide as the radius. One side is copied to its own and thirteen
    later neighbour cells, so each pair meets exactly once in an equi-join on (keys, cell).
    """
    keys = list(keys)
    cell = [F.floor(F.col(a) / radius).cast("int").alias(f"c{a}") for a in "xyz"]
    placed = beads.select(*keys, "bead", "x", "y", "z", *cell)
    shifts = F.array(*[
        F.struct(*[F.lit(o[k]).alias(f"o{a}") for k, a in enumerate("xyz")]) for o in HALF_SHELL
    ])
    left = placed.withColumn("_o", F.explode(shifts)).select(
        *keys, *[(F.col(f"c{a}") + F.col(f"_o.o{a}")).alias(f"c{a}") for a in "xyz"],
        ((F.col("_o.ox") == 0) & (F.col("_o.oy") == 0) & (F.col("_o.oz") == 0)).alias("_own"),
        F.col("bead").alias("_a"), *[F.col(a).alias(f"_{a}") for a in "xyz"],
    )
    d2 = sum(
        ((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in "xyz"), F.lit(0.0)
    )
    return (
        left.join(placed, [*keys, "cx", "cy", "cz"])
        .where(~F.col("_own") | (F.col("_a") < F.col("bead")))
        .withColumn("d2", d2)
        .where(F.col("d2") <= radius * radius)
        .select(
            *keys, F.least("_a", "bead").alias("i"), F.greatest("_a", "bead").alias("j"), "d2"
        )
    )


def _pair_codes(pos: np.ndarray, region: np.ndarray, bead: np.ndarray, radius: float):
    """Indices (a, b) of beads of the same region within ``radius``.

    Beads are sorted by column (cells of half the radius in x and y) and height, so what lies near
    a bead in a neighbour column is one run, found by two searches of its borders in height. Half
    of the neighbour columns are enough, and in the own column what lies above.
    """
    width = radius / COLUMNS
    cell = np.floor(pos[:, :2] / width).astype(np.int64)
    cell -= cell.min(axis=0) - COLUMNS
    span = cell.max(axis=0) + 1 + COLUMNS
    z = pos[:, 2] - pos[:, 2].min()
    height = float(z.max()) + 2 * radius + 1
    if (int(region.max()) + 1) * int(span[0]) * int(span[1]) * height >= 2.0**40 * radius:
        raise ValueError("coordinates lie too far apart for cells of this radius")
    column = (region * span[0] + cell[:, 0]) * span[1] + cell[:, 1]
    order = np.lexsort((z, column))
    place = column[order] * height + z[order]
    edge = 4 * np.spacing(place[-1])  # wider by what rounding can take; distances decide
    x, y, z = pos[order].T.copy()
    here = np.arange(len(place))
    for dx, dy in HALF_COLUMNS:
        if (dx, dy) == (0, 0):
            reach, first = radius + edge, here + 1
        else:
            gap = np.hypot(max(0, abs(dx) - 1), max(0, abs(dy) - 1)) * width
            reach = np.sqrt(radius * radius - gap * gap) + edge
            first = np.searchsorted(place, place + ((dx * int(span[1]) + dy) * height - reach), side="left")
        last = np.searchsorted(place, place + ((dx * int(span[1]) + dy) * height + reach), side="right")
        n = last - first
        total = int(n.sum())
        if total == 0:
            continue
        a = np.repeat(here, n)
        b = np.arange(total) - np.repeat(np.cumsum(n) - n - first, n)
        d2 = np.zeros(total)
        for axis in (x, y, z):
            gap = axis[a] - axis[b]
            gap *= gap
            d2 += gap
        near = np.flatnonzero(d2 <= radius * radius)
        yield order[a[near]], order[b[near]]


def _count_kernel(keys: list[str], radius: float, n_bins: int, tile: tuple[int, int, int] | None,
                  schema: pa.Schema, beads_at_once: int = 400_000, pairs_kept: int = 4_000_000):
    """mapInArrow function: frames in, partial pixel counts out.

    A task counts in place, in one array a map, and sends each pixel once; maps too large for that
    are counted by sorting the pairs, a bounded number at a time.
    """
    area = n_bins * n_bins

    def rows(groups: list[dict], code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        group, cell = np.divmod(code, area)
        heads = pa.Table.from_pylist(groups, schema=pa.schema([schema.field(k) for k in keys]))
        columns = [c.combine_chunks() for c in heads.take(pa.array(group)).columns]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array((cell // n_bins).astype(np.int32)),
             pa.array((cell % n_bins).astype(np.int32)), pa.array(n.astype(np.int64))],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        groups: list[dict] = []
        codes: list[np.ndarray] = []
        dense: dict[int, np.ndarray] = {}
        held = 0

        def count(last: bool) -> Iterator[pa.RecordBatch]:
            """Add held pairs to the maps in place, or make rows of them; rows of maps at the end."""
            if codes and area * 8 > DENSE_CELLS:
                yield rows(groups, *np.unique(np.concatenate(codes), return_counts=True))
            elif codes:
                code = np.concatenate(codes)
                owner = code // area
                for g in np.unique(owner):
                    if g not in dense and (len(dense) + 1) * area > DENSE_CELLS:
                        yield from maps()
                    mine = np.bincount(code[owner == g] - g * area, minlength=area).astype(np.int64, copy=False)
                    dense[g] = dense[g] + mine if g in dense else mine
            codes.clear()
            if last:
                yield from maps()

        def maps() -> Iterator[pa.RecordBatch]:
            for g, n in dense.items():
                cell = np.flatnonzero(n)
                for lo in range(0, len(cell), 1_000_000):
                    some = cell[lo:lo + 1_000_000]
                    yield rows(groups, g * area + some, n[some])
            dense.clear()

        for batch in batches:
            heads = batch.select(keys).to_pylist()
            ids = np.empty(len(heads), dtype=np.int64)
            for r, head in enumerate(heads):
                t = tuple(head.values())
                if t not in known:
                    known[t] = len(groups)
                    groups.append(head)
                ids[r] = known[t]
            pos = batch.column(batch.schema.get_field_index("pos"))
            offsets = pos.offsets.to_numpy()
            lengths = np.diff(offsets)
            start = 0
            while start < len(ids):
                # as many whole frames as fit the bead budget, at least one
                stop = max(
                    start + 1,
                    int(np.searchsorted(offsets, offsets[start] + beads_at_once, "right")) - 1,
                )
                points = pos.values.slice(offsets[start], offsets[stop] - offsets[start])
                xyz = np.column_stack([points.field(a).to_numpy(zero_copy_only=False) for a in "xyz"])
                row = np.repeat(np.arange(stop - start), lengths[start:stop])
                bead = np.arange(len(row)) - np.repeat(
                    offsets[start:stop] - offsets[start], lengths[start:stop]
                )
                region = row
                keep = np.isfinite(xyz).all(axis=1)
                if tile is None:
                    keep &= bead < n_bins
                    xyz, bead, row = xyz[keep], bead[keep], row[keep]
                    region = row
                else:
                    size, padding, n_tiles = tile
                    copy, local = np.divmod(bead, size)
                    local = local - padding
                    keep &= (local >= 0) & (local < n_bins) & (copy < n_tiles)
                    region = (row * n_tiles + copy)[keep]
                    xyz, bead, row = xyz[keep], local[keep], row[keep]
                owner = ids[start:stop][row]
                if len(bead):
                    for a, b in _pair_codes(xyz, region, bead, radius):
                        lo, hi = np.minimum(bead[a], bead[b]), np.maximum(bead[a], bead[b])
                        codes.append((owner[a] * n_bins + lo) * n_bins + hi)
                        held += len(a)
                start = stop
                if held > pairs_kept:
                    yield from count(False)
                    held = 0
        yield from count(True)

    return run


def count_contacts(
    frames: DataFrame, keys: Sequence[str], n_bins: int, radius: float = CONTACT_RADIUS,
    tile_size: int | None = None, padding: int = 0, n_tiles: int = 1, strategy: str = "kernel",
) -> DataFrame:
    """Contacts per pixel, (keys, i, j, n), from frames with ``pos`` arrays.

    ``keys`` name the map a frame belongs to. ``strategy``: ``kernel`` (NumPy per Arrow batch)
    or ``grid`` (JVM equi-join); both return the same rows. Beads from ``n_bins`` on and beads
    without finite coordinates take no part.
    """
    keys = list(keys)
    if strategy == "kernel":
        schema = T.StructType(
            [frames.schema[k] for k in keys]
            + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
               T.StructField("n", T.LongType())]
        )
        tile = None if tile_size is None else (tile_size, padding, n_tiles)
        partial = frames.select(*keys, "pos").mapInArrow(
            _count_kernel(keys, radius, n_bins, tile, to_arrow_schema(schema)), schema
        )
        return partial.groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"))
    if strategy != "grid":
        raise ValueError(f"unknown strategy {strategy!r}")
    if "frame" not in frames.columns:
        raise ValueError("the grid strategy tells sub-regions apart by a frame column")
    # rows without a tile column are told apart by their frame alone
    region = [*keys, *[c for c in frames.columns if c not in (*keys, "pos")]]
    beads = explode_beads(frames, region)
    beads = beads.where(is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z")))
    if tile_size is None:
        beads = beads.where(F.col("bead") < n_bins)
    else:
        beads = untile_beads(beads, tile_size, padding, n_bins, n_tiles)
        region.append("tile")
    pairs = contacts_within_radius(beads, region, radius)
    return pairs.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("n"))


def sub_regions(frames: DataFrame, keys: Sequence[str], n_tiles: int = 1) -> DataFrame:
    """Number of (frame, tile) sub-regions behind each map."""
    return frames.groupBy(*keys).agg((F.count(F.lit(1)) * n_tiles).alias("n_sub"))


def contact_map(
    frames: DataFrame, keys: Sequence[str], n_bins: int, radius: float = CONTACT_RADIUS, **kw
) -> DataFrame:
    """Contact frequency map (keys, i, j, n, n_sub, v) with v = n / n_sub."""
    counts = count_contacts(frames, keys, n_bins, radius, **kw)
    return normalise(counts, sub_regions(frames, keys, kw.get("n_tiles", 1)), keys)


def normalise(counts: DataFrame, subs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attach(counts, subs, keys).withColumn("v", F.col("n") / F.col("n_sub"))


def pool_replicates(counts: DataFrame, subs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frame-weighted pool: summed counts over summed sub-regions, per ``keys``."""
    return normalise(
        counts.groupBy(*keys, "i", "j").agg(F.sum("n").alias("n")),
        subs.groupBy(*keys).agg(F.sum("n_sub").alias("n_sub")),
        keys,
    )


def mean_of_maps(pixels: DataFrame, keys: Sequence[str], member: str, value: str = "v") -> DataFrame:
    """Unweighted mean over member maps; a pixel missing from a member counts as zero."""
    keys = list(keys)
    members = pixels.select(*keys, member).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_m")
    )
    total = pixels.groupBy(*keys, "i", "j").agg(F.sum(value).alias("_s"))
    return attach(total, members, keys).select(*keys, "i", "j", (F.col("_s") / F.col("_m")).alias(value))


def merge_maps(pixels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Sum of shard maps."""
    return pixels.groupBy(*keys, "i", "j").agg(F.sum(value).alias(value))


def merge_shards(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Consecutive frame numbers across the shards of a run, in (shard, frame) order.

    The number of a frame is its place inside its shard plus the length of earlier shards. A
    shard is cut into blocks of frames, so its size does not matter.
    """
    keys = list(keys)
    numbered = row_numbers(
        frames, [*keys, "shard"], ["frame"], F.floor(F.col("frame") / 4096), "_place"
    )
    sizes = frames.groupBy(*keys, "shard").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = sizes.select(
        *keys, "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.count(F.lit(1)).over(whole).alias("n_shards"),
    )
    return numbered.join(offsets, [*keys, "shard"]).withColumn(
        "frame", (F.col("_before") + F.col("_place") - 1).cast("long")
    ).drop("_before", "_place")
