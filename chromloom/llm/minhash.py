"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of distinct runs of ``n_words`` words, a 128-bit digest of that set,
   the minima of ``BANDS * ROWS`` hash functions, the low ``BITS`` bits of each minimum packed into
   64-bit words, and one key a band.
2. Equal sets are one class, whatever their number; only one document of a class goes on.
3. In each band bucket one class is the hub, and every other member is paired with it: pairs grow
   with members, not with their square. Packed signatures estimate a pair's similarity, corrected
   for chance collisions of low bits; only pairs far below the threshold are left out. The rest are
   confirmed on full sets, and links join classes to components.
4. The first hub is the class of the smallest digest. A second round takes, in buckets that still
   hold several components, the member that most hubs have linked to: the middle of its group.
5. What is left is done in full, so that no link is lost through the choice of a hub. A class that
   shares a bucket with a component of ``LARGE`` classes or more is compared with all of that
   component, in blocks of bounded size on both sides, on full sets; only links come out. Other
   classes of a bucket in different components meet in a join that compares packed signatures
   itself, and pairs it lets through are confirmed.

With 50 bands of 6 rows a pair at similarity 0.8 shares a band but for one case in 4 million.
Components come from rounds of star contraction over links; each round is a stored table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromloom.llm.common import bound_batches, stored
from chromloom.llm.words import by_text, byte_pieces, mix64, word_values

BANDS, ROWS, BITS = 50, 6, 4
#: Estimates this far below the threshold are not confirmed: over five standard errors of the
#: estimate at similarity 0.8 with 300 minima of 4 bits.
SLACK = 0.13

_U = np.uint64
#: Salts of the two 64-bit halves of a set's digest; the first half names its class.
NODE, CHECK = 0x6A09E667F3BCC909, 0x3C6EF372FE94F82B
_MULTIPLY = (mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> _U(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix64(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64)) >> _U(32)).astype(np.uint32)
#: Classes that make a component large; classes of one block on each side.
LARGE, BLOCK_MEMBERS, BLOCK_ASKED = 64, 512, 2048
#: Shingles hashed at a time: the block of all functions by shingles stays in the cache.
_BLOCK = 1024


def shingle_sets(texts: pa.Array, n_words: int = 2) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(first row, sets)``: for each text its sorted distinct shingle values."""
    for first, data, offsets in byte_pieces(texts):
        value, text, _, _ = word_values(data, offsets)
        n = len(offsets) - 1
        at = by_text(text, n)
        joined = value[: max(0, len(value) - n_words + 1)].copy()
        for k in range(1, n_words):
            joined = mix64(joined * _U(0x9FB21C651E98DF25) + value[k: k + len(joined)])
        sets = []
        for k in range(n):
            lo, hi = at[k], at[k + 1]
            if hi - lo >= n_words:
                sets.append(np.unique(joined[lo: hi - n_words + 1]))
            elif hi > lo:  # fewer words: the whole sequence is one
                whole = np.array([hi - lo], np.uint64)
                for w in value[lo:hi]:
                    whole = mix64(whole * _U(0x8CB92BA72F3D8DD7) + w)
                sets.append(whole)
            else:
                sets.append(np.zeros(0, np.uint64))
        yield first, sets


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over one set."""
    low = (shingles >> _U(32)).astype(np.uint32)
    least = np.full(len(_MULTIPLY), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), _BLOCK):
        hashed = _MULTIPLY[:, None] * low[None, k: k + _BLOCK] + _ADD[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return least


def pack(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima of many sets (rows), packed into 64-bit words."""
    per = 64 // BITS
    n, k = least.shape
    wide = np.zeros((n, -(-k // per) * per), np.uint64)
    wide[:, :k] = least & np.uint32((1 << BITS) - 1)
    shifts = (np.arange(per, dtype=np.uint64) * _U(BITS))[None, None, :]
    return np.bitwise_or.reduce(wide.reshape(n, -1, per) << shifts, axis=2)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key a band and set; the band's number is part of it."""
    n = len(least)
    rows = least.reshape(n, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key * _U(0xC2B2AE3D27D4EB4F) + rows[:, :, r])
    return key


def estimate(a: np.ndarray, b: np.ndarray, n_minima: int = BANDS * ROWS) -> np.ndarray:
    """Similarity of packed signatures: the part of equal b-bit values, counted by bits, less what
    chance makes equal."""
    x = a ^ b
    shift = 1
    while shift < BITS:
        x = x | (x >> _U(shift))
        shift *= 2
    ones = sum(1 << (BITS * k) for k in range(64 // BITS))
    differ = np.bitwise_count(x & _U(ones)).sum(axis=1)
    chance = 2.0 ** -BITS
    return ((n_minima - differ) / n_minima - chance) / (1 - chance)


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists of longs."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.ravel().view(np.int64)))


def _digest(sets: list[np.ndarray], salt: int) -> np.ndarray:
    """A 64-bit value of each set, whatever the order."""
    return np.array([np.add.reduce(mix64((s ^ _U(salt)) * _U(0xBB67AE8584CAA73B))) for s in sets], np.uint64).view(np.int64)


def _sketch(n_words: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), n_words):
                n = len(sets)
                size = np.array([len(s) for s in sets], np.int64)
                least = np.stack([minima(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(size), pa.array(_digest(sets, NODE)), pa.array(_digest(sets, CHECK)),
                     _lists(pack(least)), _lists(band_keys(least))],
                    ["id", "n", "node", "other", "packed", "keys"])

    return sketch


def _sets(n_words: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch.column(1), n_words):
                ends = np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_digest(sets, NODE)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["node", "shingles"])

    return full


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()


def similar(left: list[Column], right: list[Column], least: float) -> Column:
    """Whether two packed signatures, given by words, are estimated at ``least`` or more."""
    ones = sum(1 << (BITS * k) for k in range(64 // BITS))
    differ = F.lit(0)
    for a, b in zip(left, right):
        x, shift = a.bitwiseXOR(b), 1
        while shift < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift *= 2
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(ones)))
    chance, n = 2.0 ** -BITS, BANDS * ROWS
    return differ <= int(n - n * (least * (1 - chance) + chance))


def _words(packed: str) -> list[Column]:
    return [F.col(packed)[k] for k in range(-(-BANDS * ROWS * BITS // 64))]


def _confirmed(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, at_a), (b, at_b) = _rows(batch.column(2)), _rows(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = a[at_a[k]:at_a[k + 1]], b[at_b[k]:at_b[k + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return linked


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes that their signatures don't rule out."""
    sides = [reps.select(F.col("node").alias(k), F.col("packed").alias(f"packed_{k}")) for k in ("a", "b")]
    fits = similar(_words("packed_a"), _words("packed_b"), percent / 100 - SLACK)
    return stored(pairs.join(sides[0], "a").join(sides[1], "b").filter(fits).select("a", "b"), "op1-near")


def _full_sets(nodes: DataFrame, reps: DataFrame, texts: DataFrame, n_words: int) -> DataFrame:
    """``(node, shingles)`` of the classes in ``nodes``, and of others that share an id with one."""
    ids = stored(reps.join(nodes, "node", "left_semi").select("id"), "op1-wanted")
    return stored(texts.join(ids, "id", "left_semi").mapInArrow(_sets(n_words), "node long, shingles array<long>").dropDuplicates(["node"]), "op1-sets")


def confirmed(near: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, n_words: int = 2) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough.

    ``reps``: ``node, id`` of each class; ``texts``: ``id, text``.
    """
    if near.isEmpty():
        return near
    full = _full_sets(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), reps, texts, n_words)
    left = full.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    right = full.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    both = near.join(left, "b").join(right, "a").select("a", "b", "set_a", "set_b")
    return stored(both.mapInArrow(_confirmed(percent), "a long, b long"), "op1-links")


def _linked_blocks(percent: int):
    def block(members: pa.Table, asked: pa.Table) -> pa.Table:
        """For each class asked one member of the block that it links to, if there is one."""
        found = []
        if members.num_rows and asked.num_rows:
            nodes = members.column("node").to_numpy()
            values, at = _rows(members.column("shingles"))
            size = np.diff(at)
            order = np.argsort(values, kind="stable")
            owner, values = np.repeat(np.arange(len(nodes)), size)[order], values[order]
            shingles, ends = _rows(asked.column("pairs"))
            for k, node in enumerate(asked.column("asker").to_numpy()):
                mine = shingles[ends[k]:ends[k + 1]]
                lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
                many = hi - lo
                places = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                common = np.bincount(owner[places], minlength=len(nodes))
                links = np.flatnonzero(100 * common >= percent * (size + len(mine) - common))
                if len(links):
                    found.append((node, nodes[links[0]]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return block


def _against_large(asks: DataFrame, large: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, n_words: int) -> DataFrame:
    """Links ``(a, b)`` of the classes in ``asks(node, large)`` to members of ``large(node, root)``:
    one for each class and block of the component that holds any."""
    members = large.join(asks.select(F.col("large").alias("root")).distinct(), "root", "left_semi")
    full = _full_sets(asks.select("node").union(members.select("node")).distinct(), reps, texts, n_words)
    parts = lambda df, key, rows: df.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    of_members = parts(members, "root", BLOCK_MEMBERS).withColumnRenamed("parts", "m_parts")
    of_asks = parts(asks.withColumnRenamed("large", "root"), "root", BLOCK_ASKED).withColumnRenamed("parts", "a_parts")
    blocks = stored(of_members.join(of_asks, "root"), "op1-blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = members.join(blocks, "root").select("root", own("m_parts").alias("m"), every("a_parts").alias("a"), "node").join(full, "node")
    right = asks.withColumnRenamed("large", "root").join(blocks, "root").select("root", every("m_parts").alias("m"), own("a_parts").alias("a"), "node").join(full, "node")
    place = ["root", "m", "a"]
    left, right = left.select(*place, "node", "shingles"), right.select(*place, "node", "shingles").toDF("of", "x", "y", "asker", "pairs")
    return stored(left.groupBy(*place).cogroup(right.groupBy("of", "x", "y")).applyInArrow(_linked_blocks(percent), "a long, b long"), "op1-links")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``links(a, b)``: the smallest node it is joined to.

    Alternating star rounds: every node hands all larger neighbours to its smallest neighbour, then
    all smaller ones; links become stars. Each round is stored, so a lost executor repeats one.
    """
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
    edges = stored(links.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "op1-edges")
    before, now = None, state(edges)
    while before != now and now[0]:
        around = edges.select(F.col("lo").alias("v"), F.col("hi").alias("w")).union(edges.select("hi", "lo"))
        least = around.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
        large = around.join(least, "v").filter("w > v").select(F.col("m").alias("lo"), F.col("w").alias("hi"))
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).filter("lo <> hi").distinct()
        edges = stored(small, "op1-round")
        before, now = now, state(edges)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())


def _open_buckets(rooted: DataFrame) -> DataFrame:
    """Rows ``(key, node, root, ...)`` of buckets that hold several components."""
    open_ = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
    return rooted.join(open_, "key", "left_semi")


def _contracted(links: DataFrame) -> DataFrame:
    """``(root, new)``: what components ``links(root_a, root_b)`` join to; others keep their root."""
    joined = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    return stored(joined.select(F.col("node").alias("root"), F.col("root").alias("new")), "op1-roots")


def _renamed(rooted: DataFrame, names: DataFrame) -> DataFrame:
    return rooted.join(names, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")


def _judged(docs: DataFrame, percent: int, doc_id: str, text: str, n_words: int) -> DataFrame:
    """``id, n, node, other, root, component, kept`` of every row; see :func:`near_duplicates`."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sketches = stored(
        texts.mapInArrow(_sketch(n_words), "id long, n long, node long, other long, packed array<long>, keys array<long>"), "op1-sketches")
    digest = ["node", "other", "n"]
    classes = stored(sketches.filter("n > 0 AND id IS NOT NULL").groupBy(*digest).agg(F.min("id").alias("id")), "op1-classes")
    # one row a class; of rows with one id and set any will do
    chosen = [*digest, "id"]
    reps = stored(sketches.join(classes, chosen, "left_semi").dropDuplicates(chosen).select("node", "id", "packed", "keys"), "op1-reps")
    members = reps.select("node", F.explode("keys").alias("key"))
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub <> last").drop("last")
    shared = stored(members.join(hubs, "key").select("key", "node", "hub"), "op1-buckets")

    first = shared.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(plausible(first, reps, percent), reps, texts, percent, n_words)
    roots = stored(components(links), "op1-roots")
    degree = links.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("hubs"))
    placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = _open_buckets(placed).join(degree, "node", "left").withColumn("hubs", F.coalesce("hubs", F.lit(0)))
    open_ = stored(open_.select("key", "node", "hub", "root", "hubs"), "op1-open")

    middle = open_.filter("node <> hub").groupBy("key").agg(F.max(F.struct("hubs", "node", "root")).alias("m"))
    second = (
        open_.join(middle.select("key", F.col("m.node").alias("a"), F.col("m.root").alias("root_a")), "key")
        .filter("root <> root_a AND node <> hub").select("a", "root_a", F.col("node").alias("b"), F.col("root").alias("root_b")).distinct()
    )
    second = stored(second, "op1-second")
    more = confirmed(plausible(second.select("a", "b"), reps, percent), reps, texts, percent, n_words)
    names = _contracted(more.join(second, ["a", "b"]))
    merged = stored(_renamed(open_, names), "op1-merged")

    one = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    two = stored(_renamed(one, names), "op1-two")
    size = two.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") >= LARGE)
    large = stored(two.join(size, "root").select("node", "root"), "op1-large")
    last = stored(_open_buckets(merged).select("key", "node", "root"), "op1-last")
    reached = last.join(large.select("root").distinct(), "root", "left_semi").select(F.col("key"), F.col("root").alias("large")).distinct()
    is_large = large.select("node", F.lit(True).alias("in_large"))
    # of two large components only the one with the larger root asks
    asks = (
        last.join(is_large, "node", "left").join(reached, "key").filter((F.col("root") > F.col("large")) | (F.col("in_large").isNull() & (F.col("root") != F.col("large"))))
        .select("node", "root", "large").distinct()
    )
    asks = stored(asks, "op1-asks")
    blocks = _against_large(asks.select("node", "large"), large, reps, texts, percent, n_words) if not asks.isEmpty() else asks.selectExpr("node AS a", "large AS b")
    side = lambda c: two.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    names_2 = _contracted(blocks.join(side("a"), "a").join(side("b"), "b"))

    # both classes outside large components, as those of the last step have met all of them
    small = _open_buckets(_renamed(last, names_2).join(is_large, "node", "left_anti"))
    signed = stored(small.join(reps.select("node", "packed"), "node"), "op1-signed")
    sides = [signed.select(*[F.col(c).alias(f"{c}_{k}") for c in ("key", "node", "root", "packed")]) for k in ("a", "b")]
    fits = similar(_words("packed_a"), _words("packed_b"), percent / 100 - SLACK)
    met = sides[0].join(sides[1], (F.col("key_a") == F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & (F.col("node_a") < F.col("node_b")) & fits)
    left_over = stored(met.select(F.col("node_a").alias("a"), "root_a", F.col("node_b").alias("b"), "root_b").distinct(), "op1-left")
    final = confirmed(left_over.select("a", "b"), reps, texts, percent, n_words)
    names_3 = _contracted(final.join(left_over, ["a", "b"]))
    joined = stored(_renamed(_renamed(two, names_2), names_3), "op1-final")
    smallest = joined.groupBy("root").agg(F.min("id").alias("component"))
    named = joined.join(smallest, "root").select(*digest, "root", "component")
    out = sketches.select("id", *digest).join(named, digest, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", "n", "node", "other", "root", component.alias("component"), (F.col("id") == component).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", n_words: int = 2) -> DataFrame:
    """Every row with n_shingles, component_id and kept; input columns are those two only.

    Rows link when 100 * intersection >= ``percent`` * union of their sets of runs of ``n_words``
    words; a shorter text is one run. A text without words (or null) has an empty set and links
    with nothing. Rows without an id are returned with null component_id and kept, and take no
    part. Rows of one id with several texts are each judged by their own text. Repeated rows get
    equal results; a component's id is its smallest doc_id. An empty table gives no rows.

    Two losses are possible, both by chance and both rare: a pair at exactly the limit shares no
    band with a chance of 1 in 4 million, and one whose estimate falls short of the limit by more
    than ``SLACK`` is not confirmed where signatures are compared first.
    """
    found = _judged(docs, percent, doc_id, text, n_words)
    return found.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def one_of_each(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", n_words: int = 5) -> DataFrame:
    """Rows of ``docs``, with all columns, of which one stays of each group of near copies.

    It is the row of the smallest id. Of several rows of that id the one with the smallest hash of
    its text stays, so repeated rows become one; texts of one id that belong to different groups
    are judged apart. Rows without an id and the first text without words of each id stay.
    """
    digest = ["node", "other", "n"]
    found = stored(_judged(docs, percent, doc_id, text, n_words).filter("id IS NOT NULL"), "op1-judged")
    several = stored(found.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("id").alias("several")), "op1-several")
    gone = found.filter("NOT kept").select("id").distinct().unionByName(several.select(F.col("several").alias("id"))).distinct()
    gone = stored(gone, "op1-gone")
    own = F.col(f"`{doc_id}`").cast("long")
    single = docs.join(gone, own == F.col("id"), "left_anti")

    @F.arrow_udf("struct<node:long,other:long,n:long>")
    def digests(texts: pa.Array) -> pa.Array:
        parts = [(_digest(sets, NODE), _digest(sets, CHECK), np.array([len(x) for x in sets], np.int64)) for _, sets in shingle_sets(texts, n_words)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64)) for k in range(3)], digest)

    # few rows: those of ids that several rows share
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("id"), F.col(f"`{text}`").alias("text"))
    rows = rows.join(several, F.col("id") == F.col("several"), "left_semi").withColumn("d", digests("text")).select("row", "id", "text", "d.*")
    groups = found.filter("kept").join(several, F.col("id") == F.col("several"), "left_semi").select("id", *digest, F.coalesce("root", "node").alias("root")).distinct()
    first = rows.join(groups, ["id", *digest]).groupBy("id", "root").agg(F.min_by("row", F.xxhash64("text")).alias("row"))
    return single.unionByName(first.select("row.*"))
