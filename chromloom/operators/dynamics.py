"""Dynamics of bead pairs and single beads over frames.

A trace is a table (keys, t, values) with one row per frame of a series. Series may be of any
length: runs are found inside chunks of frames and stitched at chunk borders, and lagged sums
come from Fourier transforms in two stages, so no task holds a whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromloom.functions.joins import attach
from chromloom.functions.numeric import is_finite, is_positive, ols, ratio
from chromloom.functions.skew import percentiles

# fixed values of the published analysis
FIT_LAG_MIN, FIT_LAG_MAX_FRAC, FIT_MIN_POINTS = 5, 0.25, 6
SATURATION_MIN_LAGS = 8
CHUNK = 65_536
BLOCK = 1_024


def distance(*d: Column) -> Column:
    """Euclidean length of a vector given by its components."""
    total = d[0] * d[0]
    for c in d[1:]:
        total = total + c * c
    return F.sqrt(total)


def pair_trace(
    frames: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, int, int]],
    tile_size: int | None = None, padding: int = 0, n_tiles: int = 1,
) -> DataFrame:
    """Separation of probe pairs in every frame and tile: (keys, pair, tile, dx, dy, dz, dist).

    All pairs and tiles come from one pass over the frames by picking array elements.
    """
    picks = []
    for label, a, b in pairs:
        for tile in range(n_tiles if tile_size else 1):
            shift = tile * tile_size + padding if tile_size else 0
            d = [
                (F.get("pos", F.lit(b + shift))[axis] - F.get("pos", F.lit(a + shift))[axis]).alias(f"d{axis}")
                for axis in "xyz"
            ]
            picks.append(F.struct(F.lit(label).alias("pair"), F.lit(tile).alias("tile"), *d))
    rows = frames.select(*keys, F.explode(F.array(*picks)).alias("_p")).select(*keys, "_p.*")
    return rows.withColumn("dist", distance(F.col("dx"), F.col("dy"), F.col("dz")))


def radius_of_gyration(
    frames: DataFrame, keys: Sequence[str], first: int = 0, last: int | None = None
) -> DataFrame:
    """Radius of gyration of the beads first..last-1 of each row, (keys, rg), without a shuffle."""
    beads = F.col("pos")
    if first or last is not None:
        length = F.lit(last - first) if last is not None else F.size("pos")
        beads = F.slice("pos", first + 1, length)
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "z", "q")])
    sums = F.aggregate(
        beads, zero,
        lambda s, p: F.struct(
            *[(s[a] + p[a]).alias(a) for a in "xyz"],
            (s["q"] + p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"]).alias("q"),
        ),
    )
    n = F.size("_beads")
    centre = sum(((F.col(f"_s.{a}") / n) * (F.col(f"_s.{a}") / n) for a in "xyz"), F.lit(0.0))
    return (
        frames.select(*keys, beads.alias("_beads"), sums.alias("_s"))
        .where(n > 0)
        .select(*keys, F.sqrt(F.greatest(F.col("_s.q") / n - centre, F.lit(0.0))).alias("rg"))
    )


def rg_per_frame(rg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over the tiles of a frame; ``keys`` name the frame."""
    return rg.groupBy(*keys).agg(F.avg("rg").alias("rg"))


def rg_summary(rg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation over frames."""
    return rg.groupBy(*keys).agg(
        F.avg("rg").alias("rg_mean"), F.stddev_pop("rg").alias("rg_std"),
        F.count("rg").alias("n_frames"),
    )


def looped_fraction(
    trace: DataFrame, keys: Sequence[str], tile: str, radius: float, dist: str = "dist"
) -> DataFrame:
    """Share of frames closer than ``radius`` per tile; mean and standard error over tiles."""
    per_tile = trace.groupBy(*keys, tile).agg(
        F.avg((F.col(dist) < radius).cast("double")).alias("_f")
    )
    n = F.count("_f")
    return per_tile.groupBy(*keys).agg(
        F.avg("_f").alias("looped_fraction"),
        F.when(n > 1, F.stddev_samp("_f") / F.sqrt(n)).otherwise(F.lit(0.0)).alias("sem"),
        n.alias("n_tiles"),
    )


def contact_runs(
    trace: DataFrame, keys: Sequence[str], t: str, hit: Column, chunk: int = CHUNK
) -> DataFrame:
    """Runs of consecutive frames with ``hit`` true: (keys, start, end, length).

    Runs are found per chunk of frames; only runs that touch a chunk border, at most two per
    chunk, are put in order per series and joined where they meet.
    """
    keys = list(keys)
    hits = trace.where(hit).select(*keys, F.col(t).cast("long").alias("_t")).withColumn(
        "_c", F.floor(F.col("_t") / chunk)
    )
    place = F.row_number().over(W.partitionBy(*keys, "_c").orderBy("_t"))
    runs = (
        hits.withColumn("_g", F.col("_t") - place)
        .groupBy(*keys, "_c", "_g")
        .agg(F.min("_t").alias("start"), F.max("_t").alias("end"))
    )
    border = (F.col("start") == F.col("_c") * chunk) | (F.col("end") == (F.col("_c") + 1) * chunk - 1)
    # inner runs get a group of their own (their start); border runs are chained
    ordered = W.partitionBy(*keys).orderBy("start")
    marked = runs.where(border).select(*keys, "start", "end").withColumn(
        "_new", (F.lag("end").over(ordered) + 1 != F.col("start")).cast("int")
    )
    chained = (
        marked.withColumn("_id", F.sum(F.coalesce("_new", F.lit(1))).over(ordered))
        .groupBy(*keys, "_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_id")
    )
    return runs.where(~border).select(*keys, "start", "end").unionByName(chained).withColumn(
        "length", F.col("end") - F.col("start") + 1
    )


def dwell_stats(runs: DataFrame, keys: Sequence[str], every: DataFrame | None = None) -> DataFrame:
    """Number, mean, median and maximum of run lengths; NULLs and zero for groups without runs.

    Lengths are counted first: a series of T frames has fewer than sqrt(2T) distinct lengths, so
    the median works on a short list.
    """
    keys = list(keys)
    counted = runs.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("_c"))
    stats = counted.groupBy(*keys).agg(
        F.sum("_c").alias("n_dwells"),
        ratio(F.sum(F.col("length") * F.col("_c")), F.sum("_c")).alias("mean"),
        F.percentile("length", 0.5, F.col("_c")).alias("median"),
        F.max("length").alias("max"),
    )
    if every is None:
        return stats
    return every.join(stats, keys, "left").withColumn(
        "n_dwells", F.coalesce("n_dwells", F.lit(0).cast("long"))
    )


def distance_stats(trace: DataFrame, keys: Sequence[str], value: str = "dist") -> DataFrame:
    """Mean, median and population standard deviation pooled over tiles."""
    keys = list(keys)
    median = percentiles(trace, keys, value, [0.5]).select(
        *keys, F.col("value").alias("median_d")
    )
    return trace.groupBy(*keys).agg(
        F.avg(value).alias("mean_d"), F.stddev_pop(value).alias("std_d")
    ).transform(lambda d: attach(d, median, keys))


def histogram(
    df: DataFrame, keys: Sequence[str], value: str, bins: int = 60,
    range_: tuple[float, float] | None = None,
) -> DataFrame:
    """Density histogram of equal-width bins over [min, max] or ``range_``, empty bins included.

    The last bin contains its right edge; a single value widens the range by half a unit.
    """
    keys, v = list(keys), F.col(value)
    if range_ is None:
        ends = df.groupBy(*keys).agg(F.min(v).alias("_a"), F.max(v).alias("_b"))
        same = F.col("_a") == F.col("_b")
        ends = ends.select(
            *keys, F.when(same, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"),
            F.when(same, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"),
        )
    else:
        ends = df.select(*keys).distinct().withColumn("_lo", F.lit(float(range_[0]))).withColumn(
            "_hi", F.lit(float(range_[1]))
        )
    step = (F.col("_hi") - F.col("_lo")) / bins
    guess = F.least(F.floor((v - F.col("_lo")) / step), F.lit(bins - 1)).cast("int")
    # the quotient may land one bin off when a value sits on an edge
    k = (
        F.when(v < F.col("_lo") + guess * step, guess - 1)
        .when((guess < bins - 1) & (v >= F.col("_lo") + (guess + 1) * step), guess + 1)
        .otherwise(guess)
    )
    counts = (
        attach(df, ends, keys).where((v >= F.col("_lo")) & (v <= F.col("_hi")))
        .groupBy(*keys, k.alias("k")).agg(F.count(F.lit(1)).alias("_n"))
    )
    grid = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    total = F.sum("_n").over(W.partitionBy(*keys))
    n = F.coalesce(F.col("_n"), F.lit(0).cast("long"))
    return grid.join(counts, [*keys, "k"], "left").select(
        *keys, "k", (F.col("_lo") + (F.col("k") + 0.5) * step).alias("center"), n.alias("n"),
        ratio(n, total * step).alias("density"),
    )


def log_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 40) -> DataFrame:
    """Density histogram of log-spaced bins from max(min, 1) to the maximum."""
    keys, v = list(keys), F.col(value).cast("double")
    ends = df.groupBy(*keys).agg(
        F.log10(F.greatest(F.min(v), F.lit(1.0))).alias("_lo"), F.log10(F.max(v)).alias("_hi")
    ).where("_hi > _lo")
    step = (F.col("_hi") - F.col("_lo")) / bins

    def edge(k: Column) -> Column:
        return F.pow(F.lit(10.0), F.col("_lo") + k * step)

    k = F.least(F.floor((F.log10(v) - F.col("_lo")) / step), F.lit(bins - 1)).cast("int")
    counts = (
        attach(df, ends, keys).where((v >= 1) & (F.log10(v) >= F.col("_lo")))
        .groupBy(*keys, k.alias("k")).agg(F.count(F.lit(1)).alias("_n"))
    )
    grid = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    total = F.sum("_n").over(W.partitionBy(*keys))
    n = F.coalesce(F.col("_n"), F.lit(0).cast("long"))
    return grid.join(counts, [*keys, "k"], "left").select(
        *keys, "k", (0.5 * (edge(F.col("k")) + edge(F.col("k") + 1))).alias("center"), n.alias("n"),
        ratio(n, total * (edge(F.col("k") + 1) - edge(F.col("k")))).alias("density"),
    )


def lag_pairs(
    trace: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], lags: Sequence[int]
) -> DataFrame:
    """Frames t and t+lag side by side for a short list of lags (columns and columns_later)."""
    keys = list(keys)
    now = trace.select(*keys, t, *values).withColumn(
        "lag", F.explode(F.array(*[F.lit(int(x)) for x in lags]))
    ).withColumn("_at", F.col(t) + F.col("lag"))
    later = trace.select(*keys, F.col(t).alias("_at"), *[F.col(v).alias(f"{v}_later") for v in values])
    return now.join(later, [*keys, "_at"]).drop("_at")


def _rows_kernel(work: DataFrame, keys: Sequence[str], fields: str, fn: Callable[..., tuple]) -> DataFrame:
    """Rows that ``fn`` makes of each row of ``work`` (called with its columns but the keys), after
    the row's keys. It returns the columns of ``fields``."""
    keys = list(keys)
    rest = [c for c in work.columns if c not in keys]
    made = T.StructType.fromDDL(fields)
    schema = T.StructType([work.schema[k] for k in keys] + made.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                some = pdf.iloc[lo:lo + 64]
                pieces = [fn(*row) for row in some[rest].itertuples(index=False, name=None)]
                heads = some[keys].loc[some.index.repeat([len(x[0]) for x in pieces])].reset_index(drop=True)
                for c, name in enumerate(made.names):
                    heads[name] = list(chain.from_iterable(x[c] for x in pieces)) if isinstance(pieces[0][c], list) else np.concatenate([x[c] for x in pieces])
                yield heads

    return work.select(*keys, *rest).mapInPandas(run, schema)


def _spectrum(signals: np.ndarray, product: bool) -> np.ndarray:
    """Transform of the lag sums (real part) and pair counts (imaginary part), both even, from the
    transforms of values, known frames and, for displacements, squared lengths (first axis)."""
    if product:
        x, known = signals
        return np.abs(x) ** 2 + 1j * np.abs(known) ** 2
    known, squares = signals[-2:]
    cross = 2 * (squares.conj() * known).real - 2 * (np.abs(signals[:-2]) ** 2).sum(axis=0)
    return cross + 1j * np.abs(known) ** 2


def _signals(shape: tuple[int, ...], at: tuple[np.ndarray, ...], v: np.ndarray, product: bool) -> np.ndarray:
    """Centred values, a one for each known frame and, for displacements, squared lengths."""
    out = np.zeros((len(v) + (1 if product else 2), *shape))
    for k, x in enumerate(v):
        out[(k, *at)] = x
    out[(len(v), *at)] = 1.0
    if not product:
        out[(-1, *at)] = (v * v).sum(axis=0)
    return out


def _lag_rows(lag: np.ndarray, z: np.ndarray, lag_min: int, top: int, product: bool) -> tuple[np.ndarray, ...]:
    n = np.rint(z.imag).astype(np.int64)
    use = (lag >= lag_min) & (lag <= top) & (n > 0)
    s = z.real[use]
    return lag[use].astype(np.int64), s if product else np.maximum(s, 0), n[use]


def _two_stage_sums(
    packed: DataFrame, keys: Sequence[str], product: bool, lag_min: int, cells: int
) -> DataFrame:
    """Lag sums of series too long for one row, by a Fourier transform in two stages.

    With N = N1 N2 points, frame t = r + N2 q and frequency k = k1 + N1 k2 the transform is one of
    length N1 for each residue r, a turn, and one of length N2 for each k1; the inverse goes the
    other way round. Rows hold runs of residues (``_g``) or of frequencies (``_h``) of about
    ``cells`` points, so a series of any length is many tasks and each point is shuffled once a stage.
    """
    keys = list(keys)
    log = F.length(F.bin(F.col("_frames") + F.col("_L") - 1))
    two = lambda k: F.pow(F.lit(2.0), k).cast("long")
    sized = packed.withColumns({"_n1": two(F.ceil(log / 2)), "_n2": two(F.floor(log / 2))}).withColumns({
        "_c1": F.greatest(F.lit(1), F.least("_n1", F.floor(F.lit(cells) / F.col("_n2")))).cast("long"),
        "_c2": F.greatest(F.lit(1), F.least("_n2", F.floor(F.lit(cells) / F.col("_n1")))).cast("long"),
    })
    size = ["_n1", "_n2", "_c1", "_c2", "_L"]

    def split(t, v, n1, n2, c1, c2, top):
        t, v = np.asarray(t, np.int64), np.array([np.asarray(x) for x in v], float)
        run = t % n2 // c2
        out = [(g, t[run == g].tobytes(), np.ascontiguousarray(v[:, run == g]).tobytes()) for g in np.unique(run)]
        return [x[0] for x in out], [x[1] for x in out], [x[2] for x in out], *([s] * len(out) for s in (n1, n2, c1, c2, top))

    def first(parts_t, parts_v, n1, n2, c1, c2, top, g):
        t = np.concatenate([np.frombuffer(x, np.int64) for x in parts_t])
        v = np.concatenate([np.frombuffer(x).reshape(-1, len(y) // 8) for x, y in zip(parts_v, parts_t)], axis=1)
        width = min(c2, n2 - g * c2)
        x = np.fft.fft(_signals((n1, width), (t // n2, t % n2 - g * c2), v, product), axis=1)
        x *= np.exp(-2j * np.pi / (n1 * n2) * (np.arange(n1)[:, None] * (g * c2 + np.arange(width))[None, :]))
        many = -(-n1 // c1)
        return list(range(many)), [g] * many, [x[:, h * c1:(h + 1) * c1].tobytes() for h in range(many)], *([s] * many for s in (n1, n2, c1, c2, top))

    def second(gs, parts, n1, n2, c1, c2, top, h):
        height = min(c1, n1 - h * c1)
        signals = len(parts[0]) // (16 * height * min(c2, n2 - gs[0] * c2))
        x = np.zeros((signals, height, n2), complex)  # runs of residues without a frame stay zero
        for g, part in zip(gs, parts):
            x[:, :, g * c2:(g + 1) * c2] = np.frombuffer(part, complex).reshape(signals, height, -1)
        z = np.fft.ifft(_spectrum(np.fft.fft(x, axis=2), product), axis=1)
        z *= np.exp(2j * np.pi / (n1 * n2) * ((h * c1 + np.arange(height))[:, None] * np.arange(n2)[None, :]))
        many = -(-n2 // c2)
        return list(range(many)), [h] * many, [np.ascontiguousarray(z[:, g * c2:(g + 1) * c2]).tobytes() for g in range(many)], *([s] * many for s in (n1, n2, c1, c2, top))

    def third(hs, parts, n1, n2, c1, c2, top, g):
        width = min(c2, n2 - g * c2)
        z = np.zeros((n1, width), complex)
        for h, part in zip(hs, parts):
            z[h * c1:(h + 1) * c1] = np.frombuffer(part, complex).reshape(-1, width)
        z = np.fft.ifft(z, axis=0)
        lag = g * c2 + np.arange(width)[None, :] + n2 * np.arange(n1)[:, None]
        return _lag_rows(lag.ravel(), z.ravel(), lag_min, top, product)

    longs = ", ".join(f"{c} long" for c in size)
    runs = _rows_kernel(sized.select(*keys, "_t", "_v", *size), keys, f"_g long, _t binary, _v binary, {longs}", split)

    def regrouped(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
        pieces = df.groupBy(*keys, by).agg(F.collect_list(F.struct(a, b)).alias("_p"), *[F.max(c).alias(c) for c in size])
        return pieces.select(*keys, *[F.col("_p")[c].alias(c) for c in (a, b)], *size, by)

    ones = _rows_kernel(regrouped(runs, "_g", "_t", "_v"), keys, f"_h long, _g long, _x binary, {longs}", first)
    twos = _rows_kernel(regrouped(ones, "_h", "_g", "_x"), keys, f"_g long, _h long, _x binary, {longs}", second)
    return _rows_kernel(regrouped(twos, "_g", "_h", "_x"), keys, "lag long, _s double, n long", third)


def _lag_sums(
    trace: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], product: bool,
    lag_min: int, lag_max: int | None, lag_max_frac: float, block: int,
) -> DataFrame:
    """Per lag the sum over frames of squared differences, or of products of centred values, and
    the pair count.

    Both are correlations of the values, their squares and the known frames, so Fourier transforms
    give all lags at once: in one row for series of up to ``block`` frames, else in two stages of
    rows. What holds for a whole series (its length, its means) is joined per block through a small
    index, so frames are never shuffled by series. A frame with a value that is null or not finite
    is missing; it pairs with nothing.
    """
    keys, values = list(keys), list(values)
    blocked = trace.select(*keys, F.col(t).cast("long").alias("_t"), *[F.col(v).cast("double").alias(v) for v in values]).withColumn(
        "_b", F.floor(F.col("_t") / block).cast("long"))
    whole = F.lit(True)
    for v in values:
        whole = whole & is_finite(F.col(v))
    known = blocked.where(whole)
    index = blocked.groupBy(*keys, "_b").agg(
        F.max("_t").alias("_last"), F.count(F.when(whole, 1)).alias("_count"), *[F.sum(F.when(whole, F.col(v))).alias(f"_sum_{v}") for v in values])
    longest = (
        F.lit(int(lag_max)) if lag_max is not None
        else F.greatest(F.lit(1), F.floor((F.max("_last") + 1) * F.lit(lag_max_frac)))
    )
    series = index.groupBy(*keys).agg(
        (F.max("_last") + 1).alias("_frames"), longest.cast("long").alias("_L"),
        *[ratio(F.sum(f"_sum_{v}"), F.sum("_count")).alias(f"_m_{v}") for v in values])
    packed = known.groupBy(*keys, "_b").agg(F.collect_list(F.struct("_t", *values)).alias("_f"))

    def centred(v: str) -> Column:
        return F.transform(F.col("_f")[v], lambda x: x - F.col(f"_m_{v}"))

    packed = packed.join(attach(index.select(*keys, "_b"), series, keys), [*keys, "_b"]).select(
        *keys, F.col("_f._t").alias("_t"), F.array(*[centred(v) for v in values]).alias("_v"), "_frames", "_L")

    def at_once(t, v, length, top):
        t, v = np.asarray(t, np.int64), np.array([np.asarray(x) for x in v], float)
        n = 1 << int(length + top - 1).bit_length()
        x = np.fft.fft(_signals((n,), (t,), v, product), axis=1)
        return _lag_rows(np.arange(n), np.fft.ifft(_spectrum(x, product)), lag_min, top, product)

    short = _rows_kernel(packed.where(F.col("_frames") <= block), keys, "lag long, _s double, n long", at_once)
    long_ = _two_stage_sums(packed.where(F.col("_frames") > block), keys, product, lag_min, 16 * block)
    return short.unionByName(long_)


def msd(
    trace: DataFrame, keys: Sequence[str], t: str = "t", vector: Sequence[str] = ("dx", "dy", "dz"),
    lag_min: int = 1, lag_max: int | None = None, lag_max_frac: float = 1 / 3, block: int = BLOCK,
) -> DataFrame:
    """Time-averaged mean squared displacement per series and lag: (keys, lag, msd, n).

    Lags run to a third of the series unless given. Works for separation vectors of pairs and
    for positions of single beads.
    """
    sums = _lag_sums(trace, keys, t, vector, False, lag_min, lag_max, lag_max_frac, block)
    return sums.select(*keys, "lag", (F.col("_s") / F.col("n")).alias("msd"), "n")


def pooled_msd(per_tile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unweighted mean of the per-tile curves."""
    return per_tile.groupBy(*keys, "lag").agg(
        F.avg("msd").alias("msd"), F.count(F.lit(1)).alias("n_tiles")
    )


def autocorrelation(
    trace: DataFrame, keys: Sequence[str], t: str = "t", value: str = "dist",
    lag_max: int | None = None, lag_max_frac: float = 1 / 3, block: int = BLOCK,
) -> DataFrame:
    """Normalised autocorrelation per series and lag: 1 at lag 0, all zero without variance."""
    keys = list(keys)
    stats = trace.groupBy(*keys).agg(
        F.var_pop(value).alias("_var"), (F.max(t) + 1).alias("_T"),
    )
    sums = _lag_sums(trace, keys, t, [value], True, 1, lag_max, lag_max_frac, block)
    top = (
        F.lit(int(lag_max)) if lag_max is not None
        else F.greatest(F.lit(1), F.floor(F.col("_T") * F.lit(lag_max_frac)))
    ).cast("long")
    grid = stats.select(
        *keys, "_var", F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("lag")
    )
    c = (
        F.when(F.col("_var") <= 0, F.lit(0.0)).when(F.col("lag") == 0, F.lit(1.0))
        .otherwise(ratio(F.col("_s") / F.col("n"), F.col("_var")))
    )
    return grid.join(sums, [*keys, "lag"], "left").select(*keys, "lag", c.alias("c"))


def msd_powerlaw_fit(
    curve: DataFrame, keys: Sequence[str], lag_min: int = FIT_LAG_MIN,
    lag_max_frac: float = FIT_LAG_MAX_FRAC, min_points: int = FIT_MIN_POINTS,
) -> DataFrame:
    """log-log line through the curve between ``lag_min`` and a quarter of its longest lag.

    alpha is the slope, k_alpha the value at lag 1; NULL below ``min_points`` positive points.
    """
    longest = F.max("lag").over(W.partitionBy(*keys))
    top = F.greatest(F.lit(lag_min + 1), F.floor(longest * F.lit(lag_max_frac)))
    lag, value = F.col("lag"), F.col("msd")
    use = (lag >= lag_min) & (lag <= F.col("_top")) & is_positive(value)
    fit = ols(F.when(use, F.log10(lag)), F.when(use, F.log10(value)))
    enough = fit["n"] >= min_points
    return curve.withColumn("_top", top.cast("long")).groupBy(*keys).agg(
        F.when(enough, fit["slope"]).alias("alpha"),
        F.when(enough, F.pow(F.lit(10.0), fit["intercept"])).alias("k_alpha"),
        F.when(enough, fit["intercept"]).alias("log_intercept"),
        F.when(enough, fit["slope_se"]).alias("alpha_stderr"),
        F.when(enough, fit["intercept_se"]).alias("log_k_alpha_stderr"),
        F.max("_top").alias("fit_lag_max"), fit["n"].alias("n_points"),
    )


def msd_fit_per_tile(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, spread and standard error over tiles of fitted alpha and k_alpha."""
    ok = F.col("alpha").isNotNull() & F.col("k_alpha").isNotNull()
    n = F.count(F.when(ok, 1))
    out = []
    for c in ("alpha", "k_alpha"):
        v = F.when(ok, F.col(c))
        std = F.when(n > 1, F.stddev_samp(v)).when(n == 1, F.lit(0.0))
        out += [
            F.avg(v).alias(f"{c}_mean"), std.alias(f"{c}_std"),
            F.when(n > 1, F.stddev_samp(v) / F.sqrt(n)).when(n == 1, F.lit(0.0)).alias(f"{c}_sem"),
        ]
    return fits.groupBy(*keys).agg(*out, n.alias("n_tiles_fitted"))


def _saturation(lag: np.ndarray, y: np.ndarray, offset: float) -> tuple[float, float, float] | None:
    """Least squares of 2J(1-exp(-(lag/tau)^a)) + offset; J is linear, so only (tau, a) are sought."""
    target = y - offset
    if not np.all(np.isfinite(target)):
        return None

    def profile(tau, a):
        shape = 2.0 * -np.expm1(-((lag[None, :] / tau[:, None]) ** a[:, None]))
        j = np.maximum((shape @ target) / np.maximum((shape**2).sum(axis=1), 1e-300), 0.0)
        rest = target[None, :] - j[:, None] * shape
        return j, (rest**2).sum(axis=1)

    lo = np.array([np.log10(1e-3), 0.05])
    hi = np.array([np.log10(lag.max() * 1e4), 2.0])
    centre, width = (lo + hi) / 2, (hi - lo) / 2
    best = None
    for step in range(40):
        n = 21 if step == 0 else 7
        axis = [np.clip(np.linspace(c - w, c + w, n), a, b) for c, w, a, b in zip(centre, width, lo, hi)]
        tau, a = [m.ravel() for m in np.meshgrid(*axis)]
        j, err = profile(10.0**tau, a)
        i = int(np.argmin(err))
        if best is None or err[i] <= best[3]:
            best = (float(j[i]), float(10.0 ** tau[i]), float(a[i]), float(err[i]))
            centre = np.array([tau[i], a[i]])
        width = width * (0.2 if step == 0 else 0.6)
    return best[:3]


def msd_saturation_fit(curve: DataFrame, keys: Sequence[str], loc_error_sq: float = 0.0) -> DataFrame:
    """Plateau J, relaxation lag and exponent of a saturating curve; NULL below eight lags.

    A group is one averaged curve, at most a third of a series in lags.
    """
    keys = list(keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[:1][keys].reset_index(drop=True)
        found = None
        if len(pdf) >= SATURATION_MIN_LAGS:
            ordered = pdf.sort_values("lag")
            found = _saturation(
                ordered["lag"].to_numpy(float), ordered["msd"].to_numpy(float), 2.0 * loc_error_sq
            )
        j, tau, a = found or (None, None, None)
        return head.assign(j=j, tau_c=tau, alpha_sat=a, sigma2=loc_error_sq if found else None)

    schema = T.StructType(
        [curve.schema[k] for k in keys]
        + [T.StructField(c, T.DoubleType()) for c in ("j", "tau_c", "alpha_sat", "sigma2")]
    )
    return curve.select(*keys, "lag", "msd").groupBy(*keys).applyInPandas(fit, schema)


def snapshot_scores(
    legs: DataFrame, loops: DataFrame, keys: Sequence[str], offsets: Sequence[int], tol: int
) -> DataFrame:
    """Share of loop copies held by a cohesin, averaged over snapshots: (keys, anchors, looped).

    ``loops`` carry the ``keys`` of the group that they are asked in; groups without snapshots give
    no row. A copy is held when some cohesin has both legs within ``tol`` of its anchors. Legs and
    anchors meet by equi-join on coarse cells of the (left, right) plane.
    """
    keys, width = list(keys), 2 * tol + 1
    copies = loops.select(
        *keys, "anchor1", "anchor2", F.explode(F.array(*[F.lit(int(o)) for o in offsets])).alias("_o")
    )
    cells = copies.withColumn("_a", F.col("anchor1") + F.col("_o")).withColumn(
        "_b", F.col("anchor2") + F.col("_o")
    )
    for side, cell in (("_a", "_ca"), ("_b", "_cb")):
        lo, hi = F.floor((F.col(side) - tol) / width), F.floor((F.col(side) + tol) / width)
        cells = cells.withColumn(cell, F.explode(F.sequence(lo, hi)))
    # identical legs of a snapshot answer alike: keep one
    placed = legs.select(*keys, "snap", "l", "r").distinct().withColumn(
        "_ca", F.floor(F.col("l") / width)
    ).withColumn("_cb", F.floor(F.col("r") / width))
    held = (
        placed.join(cells, [*keys, "_ca", "_cb"])
        .where((F.abs(F.col("l") - F.col("_a")) <= tol) & (F.abs(F.col("r") - F.col("_b")) <= tol))
        .select(*keys, "snap", "anchor1", "anchor2", "_o").distinct()
        .groupBy(*keys, "anchor1", "anchor2").agg(F.count(F.lit(1)).alias("_held"))
    )
    snaps = legs.select(*keys, "snap").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_snaps")
    )
    # loops of a group, or of the only one: its snapshots meet its loops on the keys
    every = attach(loops.select(*keys, "anchor1", "anchor2"), snaps, keys)
    return every.join(held, [*keys, "anchor1", "anchor2"], "left").select(
        *keys, "anchor1", "anchor2",
        (F.coalesce("_held", F.lit(0)) / (F.col("_snaps") * len(offsets))).alias("looped"),
    )


def coverage_depth(legs: DataFrame, keys: Sequence[str], chain: int) -> DataFrame:
    """Mean loop size and share of the chain inside at least one loop, per snapshot (``keys``).

    Leg ends become +1/-1 steps, counted per position before they are put in order, so a
    snapshot never has more rows than chain positions.
    """
    keys = list(keys)
    steps = legs.select(*keys, F.explode(F.array(
        F.struct(F.col("l").alias("p"), F.lit(1).alias("s")),
        F.struct(F.col("r").alias("p"), F.lit(-1).alias("s")),
    )).alias("e")).groupBy(*keys, F.col("e.p").alias("_p")).agg(F.sum("e.s").alias("_s"))
    order = W.partitionBy(*keys).orderBy("_p")
    depth = F.sum("_s").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    until = F.lead("_p", 1, chain).over(order)
    covered = steps.select(
        *keys, depth.alias("_d"),
        F.greatest(F.least(until, F.lit(chain)) - F.col("_p"), F.lit(0)).alias("_w"),
    ).groupBy(*keys).agg(
        (F.sum(F.when(F.col("_d") > 0, F.col("_w")).otherwise(0)) / chain).alias("coverage")
    )
    sizes = legs.groupBy(*keys).agg(F.avg(F.col("r") - F.col("l")).alias("mean_size"))
    return attach(sizes, covered, keys)
