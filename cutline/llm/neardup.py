"""Near-duplicates by HyperMinHash, with exact confirmation.

1. Every text becomes its set of distinct word shingles (64-bit hashes). Texts with one set form
   a class; only its smallest id goes on.
2. HyperMinHash: the hash space is cut into buckets, and each keeps the smallest hash that falls
   in it, compressed to the count of its leading zeros and ``MANTISSA`` further bits.
   ``REGISTERS`` such registers serve the estimate; ``BANDS * BAND_SIZE`` others the banding.
3. Banding: bands of ``BAND_SIZE`` compressed registers are hashed; equal bands collide. Small sets
   would leave most buckets empty, so they use fewer buckets, about a quarter of their size, and
   more hash seeds: a band always speaks for about ``BAND_SIZE`` shingles. Sets so near to the next
   size class that a similar set may fall below it take part in both.
4. Linking in two rounds. First every text is paired with one centre, the smallest id, of each of
   its band buckets. Then, in buckets that still hold several components, every text outside the
   largest component is compared with all texts of the bucket, block against block inside tasks,
   and only pairs of different components come out. So all colliding pairs are either linked
   through others already or compared, and no group is expanded into its pairs.
5. Pairs pass the collision-corrected Jaccard estimate of their registers (``SIGMAS`` standard
   deviations of slack) before they are confirmed on the full sets, which are read again only for
   the texts that still matter. Connected components give the result.

At similarity 0.8 two texts miss all bands with a probability of 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches
from . import wordhash
from .frames import bit_filter, bit_test, filter_words, written
from .graph import components

REGISTERS = 512
MANTISSA = 10
BANDS = 32
BAND_SIZE = 5
SIMILARITY = 80
"""Percent: linked where 100 * intersection >= SIMILARITY * union."""
SIGMAS = 4
BLOCK = 256
PAIRS = 50_000
"""Pairs that a task compares at once."""
FILTER_WORDS = 1 << 18
"""Words of the filter of ids at most; fewer ids take fewer."""
CLASSES = (5, 10, 20, 40, 80, 160)
"""Buckets per hash seed by size class; a class starts at four shingles per bucket."""

_BUCKET_BITS = REGISTERS.bit_length() - 1
_VALUE_BITS = 64 - _BUCKET_BITS
_EMPTY = np.uint16(0xFFFF)


def compress(value: np.ndarray) -> np.ndarray:
    """Leading zeros (32 at most) and the ``MANTISSA`` bits after the first one, of 64-bit values."""
    high = (value >> np.uint64(32)).astype(np.float64)
    zeros = np.where(high > 0, 31 - np.floor(np.log2(np.maximum(high, 1))), 32).astype(np.uint64)
    rest = (value << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | rest).astype(np.uint16)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The compressed registers of a sorted set of shingle hashes.

    As the bucket is the top of the hash, the first hash of each bucket is its smallest.
    """
    out = np.full(REGISTERS, _EMPTY)
    if len(shingles):
        bucket = (shingles >> np.uint64(_VALUE_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        out[bucket[first]] = compress(shingles[first] << np.uint64(_BUCKET_BITS))
    return out


def band_hashes(sets: list[np.ndarray], similarity: int = SIMILARITY) -> np.ndarray:
    """64-bit hash of each band of every set, 0 where there is none.

    Row: two rows of ``BANDS``, for even and odd size classes, so that neighbouring classes, which
    a set near their border shares, never stand in one place.
    """
    out = np.zeros((len(sets), 2 * BANDS), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    for c, buckets in enumerate(CLASSES):
        least = 4 * buckets if c else 1
        most = 4 * CLASSES[c + 1] if c + 1 < len(CLASSES) else np.inf
        rows = np.flatnonzero((sizes >= least) & (sizes * similarity < most * 100))
        if not len(rows):
            continue
        hashes = np.concatenate([sets[i] for i in rows])
        text = np.repeat(np.arange(len(rows)), sizes[rows])
        regs = []
        for seed in range(BANDS * BAND_SIZE // buckets):
            value = wordhash.mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64)))
            bucket = ((value >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            least_of = np.full(len(rows) * buckets, 0xFFFFFFFFFFFFFFFF, np.uint64)
            np.minimum.at(least_of, text * buckets + bucket.astype(np.int64), value * np.uint64(0xD6E8FEB86659FD93))
            kept = compress(least_of)
            kept[least_of == np.uint64(0xFFFFFFFFFFFFFFFF)] = _EMPTY
            regs.append(kept.reshape(len(rows), buckets))
        bands = np.concatenate(regs, axis=1).reshape(len(rows), BANDS, BAND_SIZE)
        h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) + np.uint64(1000 * c), (len(rows), 1))
        for k in range(BAND_SIZE):
            h = wordhash.mix(h * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
        h[(bands == _EMPTY).all(2)] = 0
        at = (c % 2) * BANDS
        out[rows, at : at + BANDS] = h
    return out


def _accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree by chance for sets of n and m other hashes.

    Level z holds the minima in [2**-(z+1), 2**-z); within a level the mantissa is taken as even.
    """
    edges = 2.0 ** -np.arange(34)
    both = np.zeros(len(n))
    for z in range(33):
        reach = [np.exp(np.log1p(-np.minimum(edges[z + 1 : z + 2], 0.999)) * s / REGISTERS) - np.exp(np.log1p(-min(edges[z], 1 - 1e-12)) * s / REGISTERS) for s in (n, m)]
        both += reach[0] * reach[1] / (1 << MANTISSA)
    return both


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Whether rows of registers can belong to linked sets of sizes n and m."""
    used = ((a != _EMPTY) | (b != _EMPTY)).sum(1)
    equal = ((a == b) & (a != _EMPTY)).sum(1)
    chance = _accidental(n.astype(float), m.astype(float)) * REGISTERS
    estimate = (equal - chance) / np.maximum(used - chance, 1)
    least = similarity / 100
    union = (n + m) / (1 + least)
    unseen = np.maximum(1 - used / np.maximum(union, 1), 0.02)  # registers that hold most of a small union err little
    slack = SIGMAS * np.sqrt(least * (1 - least) / np.maximum(used, 1) * unseen) + 1 / np.maximum(used, 1)
    return (np.minimum(n, m) * 100 >= np.maximum(n, m) * similarity) & (estimate >= least - slack)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: int) -> DataFrame:
    """(id, n, set_hash, set_hash2, regs, bands) per row: size, two hashes of the whole set, registers and bands as bytes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                sets = wordhash.shingles(*wordhash.words(part.column(1)), width)
                sums = np.array([[s.sum(), wordhash.mix(s).sum()] for s in sets], np.uint64).reshape(-1, 2)
                columns = [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(sums[:, 0].view(np.int64)),
                    pa.array(sums[:, 1].view(np.int64)),
                    pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                    pa.array([b.tobytes() for b in band_hashes(sets, similarity)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "n", "set_hash", "set_hash2", "regs", "bands"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(sketch, "id bigint, n bigint, set_hash bigint, set_hash2 bigint, regs binary, bands binary")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int, at_most: int) -> DataFrame:
    """(id, shingles) of the texts whose ``id`` is in ``wanted``, which holds ``at_most`` ids.

    A bit filter of bounded size drops most other texts at the scan; the join is exact.
    """

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                sets = wordhash.shingles(*wordhash.words(part.column(1)), width)
                ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(ends, pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "shingles"])

    words = filter_words(at_most, FILTER_WORDS)
    bits = bit_filter(wanted.select(F.xxhash64("id").alias("h")), "h", words)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.filter(F.col("id").isNotNull() & bit_test(bits, F.xxhash64("id"), words))
    sets = rows.mapInArrow(shingle, "id bigint, shingles array<bigint>")
    return sets.join(wanted, "id", "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    """The ids that stand in pairs; each side is made distinct first, so an id with many pairs is one row."""
    return pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("i", F.explode(F.array(shared)))
    return joined.filter(F.col("i") * 100 >= similarity * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def _estimated(pairs: DataFrame, regs: DataFrame, similarity: int) -> DataFrame:
    """The (a, b) pairs that their registers let pass."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (2, 4))
            keep = may_link(a, b, batch.column(3).to_numpy(), batch.column(5).to_numpy(), similarity)
            yield batch.select([0, 1]).filter(pa.array(keep))

    left = regs.select(F.col("id").alias("a"), F.col("regs").alias("x"), F.col("n").alias("n"))
    right = regs.select(F.col("id").alias("b"), F.col("regs").alias("y"), F.col("n").alias("m"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "n", "y", "m")
    return rows.mapInArrow(test, "a bigint, b bigint")


def _across(rows: pa.Table, similarity: int) -> Iterator[pa.RecordBatch]:
    """Pairs of whole bucket blocks: every asking row against the block's other rows of other components.

    A pair that collides in several bands comes out of the first one only.
    """
    n = rows.num_rows
    key = np.stack([rows.column(c).to_numpy() for c in ("h", "qb", "rb")])
    group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))]) if n else np.zeros(0, int)
    ids, comps, sizes, band = (rows.column(c).to_numpy() for c in ("id", "comp", "n", "band"))
    asking = rows.column("ask").to_numpy(zero_copy_only=False)
    regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(n, REGISTERS)
    hashes = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.uint64).reshape(n, 2 * BANDS)
    asks, others = np.flatnonzero(asking), np.flatnonzero(~asking)
    low = np.searchsorted(group[others], group[asks], "left")
    count = np.searchsorted(group[others], group[asks], "right") - low
    ends, start = np.cumsum(count), 0
    while start < len(asks):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        k = count[start:stop]
        a = np.repeat(asks[start:stop], k)
        b = others[np.repeat(low[start:stop] - np.cumsum(k) + k, k) + np.arange(k.sum())]
        start = stop
        keep = (comps[a] != comps[b]) & (np.minimum(sizes[a], sizes[b]) * 100 >= np.maximum(sizes[a], sizes[b]) * similarity)
        a, b = a[keep], b[keep]
        keep = ((hashes[a] == hashes[b]) & (hashes[a] != 0)).argmax(1) == band[a]
        a, b = a[keep], b[keep]
        keep = may_link(regs[a], regs[b], sizes[a], sizes[b], similarity)
        x, y = ids[a[keep]], ids[b[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _cross_pairs(buckets: DataFrame, labels: DataFrame, regs: DataFrame, similarity: int) -> DataFrame:
    """Pairs between different components of one bucket that their registers let pass."""
    placed = buckets.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    counts = placed.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("k"))
    shape = counts.groupBy("h").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("size"), F.max("k").alias("most"))
    shape = shape.filter(F.col("size") > F.col("most"))
    mixed = placed.join(shape, "h").join(regs, "id")
    mixed = mixed.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("ask_blocks", F.ceil((F.col("size") - F.col("most")) / BLOCK))
    fields = ["h", "band", "id", "comp", "n", "regs", "bands"]
    asked = mixed.filter(F.col("comp") != F.col("main")).withColumn("qb", F.pmod(F.xxhash64("id"), F.col("ask_blocks")))
    asked = asked.select(*fields, "qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("rb"), F.lit(True).alias("ask"))
    others = mixed.withColumn("rb", F.pmod(F.xxhash64("id"), F.col("blocks")))
    others = others.select(*fields, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ask_blocks") - 1)).alias("qb"), "rb", F.lit(False).alias("ask"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = pa.table(batch) if rest is None else pa.concat_tables([rest, pa.table(batch)]).combine_chunks()
            if not rest.num_rows:
                continue
            key = np.stack([rest.column(c).to_numpy() for c in ("h", "qb", "rb")])
            whole = int(np.flatnonzero((key != key[:, -1:]).any(0))[-1]) + 1 if (key != key[:, -1:]).any() else 0
            yield from _across(rest.slice(0, whole).combine_chunks(), similarity)
            rest = rest.slice(whole)
        if rest is not None:
            yield from _across(rest.combine_chunks(), similarity)

    dealt = asked.unionByName(others).repartition("h", "qb", "rb").sortWithinPartitions("h", "qb", "rb")
    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable), kept (id = component_id).

    A text of fewer than ``width`` words is one shingle of all of them; null texts and texts
    without words have no shingle and link with nothing. Ids are whole numbers; a null id
    stands alone with a null component. Rows that share an id and a set count as one document;
    an id with several sets links with whatever one of them is near to.
    """
    small_batches(docs.sparkSession)
    sigs = written(signatures(docs, id_col, text_col, width, similarity), "signatures")
    usable = sigs.filter((F.col("n") > 0) & F.col("id").isNotNull())
    keys = ["n", "set_hash", "set_hash2"]
    classes = written(usable.groupBy(*keys).agg(F.min("id").alias("rep")), "classes")
    members = usable.join(classes, keys).select("id", "rep", "n")
    one = usable.select("id", *keys, "regs", "bands").join(classes, keys).filter("id = rep").dropDuplicates(["id", *keys])
    regs = written(one.select("id", "n", "regs", "bands"), "registers")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, 2 * BANDS)
            row, band = np.nonzero(h)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(band.astype(np.int32)), pa.array(h[row, band])], names=["id", "band", "h"])

    banded = regs.select("id", "bands").mapInArrow(spread, "id bigint, band int, h bigint")
    centres = banded.groupBy("h").agg(F.min("id").alias("centre"), F.max("id").alias("last")).filter("centre < last").drop("last")
    buckets = written(banded.join(centres, "h"), "buckets")

    stars = buckets.filter("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    near = written(_estimated(stars, regs, similarity), "pairs")
    ends = _ends(near)
    first = written(_confirmed(near, full_sets(docs, ends, id_col, text_col, width, 2 * near.count()), similarity), "links")
    labels = components(first)

    rest = written(_cross_pairs(buckets.select("h", "band", "id"), labels, regs, similarity), "pairs")
    ends = _ends(rest)
    second = written(_confirmed(rest, full_sets(docs, ends, id_col, text_col, width, 2 * rest.count()), similarity), "links")

    same = members.filter("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    whole = components(first.union(second).union(same.filter("a != b")))
    out = sigs.select("id", F.col("n").alias("n_shingles")).join(whole, "id", "left")
    component = F.coalesce("comp", "id")
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of each component's smallest id; rows without an id stay."""
    linked = link(docs.filter(F.col(f"`{id_col}`").isNotNull()), id_col, text_col, width, similarity)
    gone = linked.filter(~F.col("kept")).select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")
