"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

A document's ids (the tokenizer's, then the end id) become pieces of at most ``capacity`` tokens.
Only longer documents are cut: into pieces of ``capacity``, the first of which may be shorter.
Pieces of one length can stand for each other, so a packing is a list of bins by the lengths they
hold, each with the number of times it occurs; its size depends on ``capacity``, not on the
number of documents. What the search is given is the number of pieces of each length.

Every island is a task with a population of packings. A child takes whole well-filled bins of one
parent into the other; bins of the other that now hold a piece twice are removed, and the pieces
that have lost their bin go to the fullest bins that still take them. After every epoch each
island's best packings move on to the next island. The search ends with its epochs, or as soon as
no packing can have fewer bins. The best packing of all islands is then dealt out: each piece has
a rank among those of its length, and ranks map to bins and offsets by one join. Ranks are counted
in buckets of about ``BUCKET`` pieces, so a length that very many pieces share is never one task.

Null and empty texts are the end id alone. Very long texts are tokenised in slices cut where the
tokenizer cuts anyway. Repeated rows and ids are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import written

CAPACITY = 1024
BUCKET = 400
ISLANDS = 6
POPULATION = 6
EPOCHS = 3
GENERATIONS = 10
ELITES = 2
SLICE = 1 << 20
"""Characters of a text that are tokenised at once."""
BROADCAST_ROWS = 100_000

Bin = tuple[tuple[int, int], ...]
"""Lengths and how many pieces of each, longest first."""
Packing = dict[Bin, int]
"""Bins and how often each occurs."""

BREAK = re.compile(r" (?=\S)(?<=\S )")
"""A single space between other characters: byte-level pre-tokenizers always begin a token there."""


ODD = re.compile(r"\S{400,}|\s{400,}|<\|")
"""Long runs, whose cost grows with their square in the rank engine, and special tokens."""


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file; optionally the same vocabulary as ranks, with its pattern, which is faster to apply."""

    tokenizer: str
    ranks: str | None = None
    pattern: str | None = None


class Encoder:
    """Ids of texts as little-endian 32-bit integers, those that ``tokenizers`` gives."""

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(vocabulary.tokenizer)
        self.fast = None
        if vocabulary.ranks:
            import tiktoken

            with open(vocabulary.ranks, "rb") as lines:
                ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast and not ODD.search(text):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """One encoder a worker process."""
    return Encoder(vocabulary)


def whole(encoder: Encoder, text: str) -> bytes:
    """Ids of a whole text, taken in slices where a token begins anyway."""
    out, at = [], 0
    while at < len(text):
        cut = BREAK.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = cut.start() if cut else len(text)
        out.append(encoder(text[at:end]))
        at = end
    return b"".join(out)


def pieces(docs: DataFrame, vocabulary: Vocabulary, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: the id, piece, start, length, ids_crc32, a number of its own (``uid``) and, if asked for, ``ids``."""
    columns = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    id_type = columns.schema["id"].dataType
    fields = [("id", id_type), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("uid", T.LongType())]
    fields += [("ids", T.BinaryType())] * with_ids
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    last = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []

            def flushed(rows: list[tuple], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                at, *rest = zip(*rows, strict=True)
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(v, t) for v, t in zip(rest, types, strict=True)]], names=[n for n, _ in fields])

            for at, text in enumerate(batch.column(1)):
                ids = whole(encoder, text.as_py()) + last
                n = len(ids) // 4
                ends = [n] if n <= capacity else [*range(n % capacity or capacity, n, capacity), n]
                start = 0
                for number, end in enumerate(ends):
                    own = ids[4 * start : 4 * end]
                    rows.append((at, number, start, end - start, zlib.crc32(own), uid, *[own] * with_ids))
                    start, uid = end, uid + 1
                    if len(rows) >= 4096:
                        yield flushed(rows)
                        rows = []
            if rows:
                yield flushed(rows)

    return columns.mapInArrow(cut, schema)


def filled(held: Bin) -> int:
    return sum(length * n for length, n in held)


def fitness(packing: Packing) -> tuple[int, float]:
    """Fewer bins first; then fuller ones, by the sum of squared fills."""
    return sum(packing.values()), -float(sum(m * filled(b) ** 2 for b, m in packing.items()))


def best_fit(packing: Packing, waiting: list[tuple[int, int]], capacity: int) -> Packing:
    """Put each of ``waiting`` (length, number), in this order, into the fullest bins that take it.

    Equal bins are handled together: a length goes as often as it fits into all bins of the
    fullest kind, then into those of the next, and opens new bins at last.
    """
    free: dict[int, Packing] = {}
    open_kinds = 0  # bit r: some bin has r tokens left

    def add(held: Bin, n: int) -> None:
        nonlocal open_kinds
        left = capacity - filled(held)
        kind = free.setdefault(left, {})
        kind[held] = kind.get(held, 0) + n
        open_kinds |= 1 << left

    def grown(held: Bin, length: int, n: int) -> Bin:
        counts = dict(held)
        counts[length] = counts.get(length, 0) + n
        return tuple(sorted(counts.items(), reverse=True))

    for held, n in packing.items():
        add(held, n)
    for length, number in waiting:
        while number:
            fitting = open_kinds >> length
            if fitting:
                left = (fitting & -fitting).bit_length() - 1 + length
                held = next(iter(free[left]))
                there = free[left].pop(held)
                if not free[left]:
                    open_kinds &= ~(1 << left)
            else:
                held, there, left = (), -(-number // (capacity // length)), capacity
            each = left // length
            whole = min(there, number // each)
            if whole:
                add(grown(held, length, each), whole)
            number -= whole * each
            there -= whole
            if there and number:
                part = min(number, each)
                add(grown(held, length, part), 1)
                number -= part
                there -= 1
            if there and held:
                add(held, there)
    return {held: n for kind in free.values() for held, n in kind.items()}


def exact_fill(pool: dict[int, int], capacity: int) -> Packing:
    """Longest pieces first, each with one to three others that fill its bin to the last token; the rest by best fit."""
    left, out = dict(pool), {}

    def fits(held: dict[int, int]) -> bool:
        return all(left.get(length, 0) >= n for length, n in held.items())

    def counted(*lengths: int) -> dict[int, int]:
        return {length: lengths.count(length) for length in lengths}

    def exact(length: int) -> dict[int, int] | None:
        room = capacity - length
        if room == 0 or fits(counted(length, room)):
            return counted(length, room) if room else counted(length)
        have = [x for x in lengths if x <= room and left[x]]
        for x in have:
            if 2 * x < room:
                break
            if fits(held := counted(length, x, room - x)):
                return held
        for at, x in enumerate(have):
            if 3 * x < room:
                break
            for y in have[at:]:
                if x + 2 * y < room:
                    break
                if x + y < room and fits(held := counted(length, x, y, room - x - y)):
                    return held
        return None

    lengths = sorted(pool, reverse=True)
    for length in lengths:
        while left[length] and (held := exact(length)):
            m = min(left[x] // n for x, n in held.items())
            out[tuple(sorted(held.items(), reverse=True))] = m
            for x, n in held.items():
                left[x] -= n * m
    return best_fit(out, [(length, left[length]) for length in lengths if left[length]], capacity)


def ordered(counts: dict[int, int], rng: np.random.Generator, noise: float) -> list[tuple[int, int]]:
    """Lengths to be placed, longest first but for some ``noise``."""
    keys = {length: length * (1 + noise * rng.standard_normal()) for length in counts}
    return [(length, counts[length]) for length in sorted(counts, key=lambda x: (-keys[x], -x)) if counts[length] > 0]


def lost(packing: Packing, pool: dict[int, int]) -> dict[int, int]:
    """Pieces of the pool that no bin holds."""
    left = dict(pool)
    for held, m in packing.items():
        for length, n in held:
            left[length] -= n * m
    return left


def crossed(one: Packing, other: Packing, pool: dict[int, int], rng: np.random.Generator, capacity: int) -> Packing:
    """Whole well-filled bins of ``other`` go into ``one``; what they double is taken out and placed anew."""
    ranked = sorted(other.items(), key=lambda x: (-filled(x[0]), x[0]))
    given = {b: int(np.ceil(m * rng.random())) for b, m in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.5}
    if not given:
        given = dict(ranked[:1])
    over = {length: -left for length, left in lost(given, pool).items()}
    for held, m in one.items():
        for length, n in held:
            over[length] += n * m
    kept = dict(one)
    for held in sorted(one, key=lambda b: (filled(b), b)):
        need = max([0, *(-(-over[length] // n) for length, n in held if over[length] > 0)])
        if gone := min(need, kept[held]):
            kept[held] -= gone
            for length, n in held:
                over[length] -= n * gone
    child = {b: m for b, m in kept.items() if m}
    for held, m in given.items():
        child[held] = child.get(held, 0) + m
    return best_fit(child, ordered(lost(child, pool), rng, 0.02 * rng.integers(2)), capacity)


def mutated(packing: Packing, pool: dict[int, int], rng: np.random.Generator, capacity: int) -> Packing:
    """The emptiest bins and a few others are dissolved, and their pieces are placed anew."""
    kinds = sorted(packing, key=lambda b: (filled(b), b))
    gone = {*kinds[: max(1, len(kinds) // 20)], *(b for b in kinds if rng.random() < 0.05)}
    child = {b: m for b, m in packing.items() if b not in gone}
    return best_fit(child, ordered(lost(child, pool), rng, 0.05 * rng.integers(2)), capacity)


def fewest(pool: dict[int, int], capacity: int) -> int:
    """A bound below every packing: all tokens, or all pieces of which no two fit together."""
    total = sum(length * n for length, n in pool.items())
    return max(-(-total // capacity), sum(n for length, n in pool.items() if 2 * length > capacity))


def evolved(population: list[Packing], pool: dict[int, int], rng: np.random.Generator, capacity: int, generations: int, size: int) -> list[Packing]:
    bound = fewest(pool, capacity)
    population = sorted(population, key=fitness)
    for _ in range(generations):
        if fitness(population[0])[0] <= bound:
            break
        picks = [population[min(rng.integers(len(population), size=2))] for _ in range(size)]
        children = [crossed(a, population[rng.integers(len(population))], pool, rng, capacity) for a in picks]
        children = [mutated(c, pool, rng, capacity) if rng.random() < 0.3 else c for c in children]
        unique = {fitness(p): p for p in [*population, *children]}
        population = [unique[f] for f in sorted(unique)][:size]
    return population[:size]


def flat(packing: Packing) -> list[int]:
    out: list[int] = []
    for held, m in sorted(packing.items(), reverse=True):
        out += [m, len(held), *[x for pair in held for x in pair]]
    return out


def unflat(numbers: list[int]) -> Packing:
    out, at = {}, 0
    while at < len(numbers):
        m, k = int(numbers[at]), int(numbers[at + 1])
        own = [int(x) for x in numbers[at + 2 : at + 2 + 2 * k]]
        out[tuple(zip(own[::2], own[1::2], strict=True))] = m
        at += 2 + 2 * k
    return out


def search(spark, pool: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 11) -> Packing:
    """The best packing that the islands find. ``pool`` has at most ``capacity`` lengths; so has every task."""
    if not pool:
        return {}
    bound = fewest(pool, capacity)
    schema = "island bigint, bins bigint, waste double, packing array<bigint>"

    def row(island: int, packing: Packing) -> tuple:
        bins, waste = fitness(packing)
        return island, bins, waste, flat(packing)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for island in batch["id"]:
                rng = np.random.default_rng([seed, island])
                noises = [0.0, *(0.02 * k + 0.01 * island for k in range(1, POPULATION - 1))]
                made = [exact_fill(pool, capacity), *(best_fit({}, ordered(pool, rng, noise), capacity) for noise in noises)]
                yield pd.DataFrame([row(island, p) for p in made], columns=["island", "bins", "waste", "packing"])

    state = written(spark.range(0, islands, 1, islands).mapInPandas(begin, schema), "packing-start")
    for epoch in range(epochs):
        if state.agg(F.min("bins")).first()[0] <= bound:
            break

        def evolve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            island = int(key[0])
            rng = np.random.default_rng([seed, island, epoch + 1])  # noqa: B023  sent to the tasks of this epoch
            members = sorted((unflat(list(p)) for p in group["packing"]), key=lambda p: (fitness(p), flat(p)))
            found = evolved(members, pool, rng, capacity, GENERATIONS, POPULATION)
            return pd.DataFrame([row(island, p) for p in found], columns=["island", "bins", "waste", "packing"])

        order = Window.partitionBy("island").orderBy("bins", "waste", "packing")
        elite = state.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= ELITES).drop("r")
        moved = elite.withColumn("island", (F.col("island") + 1) % islands)
        state = written(state.unionByName(moved).repartition(islands, "island").groupBy("island").applyInPandas(evolve, schema), "packing-epoch")
    return unflat(state.orderBy("bins", "waste", "packing").first()["packing"])


def places(packing: Packing) -> list[tuple[int, int, int, int, int, int]]:
    """Per length and kind of bin: the ranks it takes, how many a bin holds, the first bin's number and the offset there."""
    out, taken, first = [], {}, 0
    for held, m in sorted(packing.items(), reverse=True):
        offset = 0
        for length, n in held:
            start = taken.get(length, 0)
            out.append((length, start, start + n * m, n, first, offset))
            taken[length] = start + n * m
            offset += n * length
        first += m
    return out


def ranked(cut: DataFrame, counts: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0, counted in buckets of bounded size."""
    buckets = counts.select(F.col("length").alias("_l"), F.ceil(F.col("n") / BUCKET).alias("_buckets"))
    dealt = cut.join(F.broadcast(buckets), F.col("length") == F.col("_l")).withColumn("_bucket", F.pmod(F.xxhash64("uid"), "_buckets")).drop("_l", "_buckets")
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("uid")) - 1
    numbered = dealt.withColumn("_own", own)
    found = numbered.join(starts, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    return found.withColumn("rank", F.col("_start") + F.col("_own")).drop("_l", "_b", "_start", "_own", "_bucket")


def pack(docs: DataFrame, vocabulary: Vocabulary, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id and offset; with ``ids`` (bytes) if asked for."""
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, end_id, capacity, id_col, text_col, with_ids), "packing-pieces")
    counts = written(cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "packing-lengths")
    pool = {int(r["length"]): int(r["n"]) for r in counts.collect()}  # one row per length, at most ``capacity``
    rows = places(search(spark, pool, capacity))
    plan = spark.createDataFrame(rows, "_l bigint, _from bigint, _to bigint, _n bigint, _first bigint, _offset bigint")
    plan = F.broadcast(plan) if len(rows) <= BROADCAST_ROWS else plan
    rank, at = F.col("rank"), F.col("rank") - F.col("_from")
    placed = ranked(cut, counts).join(plan, (F.col("length") == F.col("_l")) & (rank >= F.col("_from")) & (rank < F.col("_to")))

    def whole(x: Column) -> Column:
        return F.floor(x).cast("bigint")

    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("_first") + whole(at / F.col("_n"))).alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_n")) * F.col("length")).alias("offset"),
        *["ids"] * with_ids,
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of ``pack(..., with_ids=True)``: sequence_id and its ids as little-endian 32-bit bytes."""
    listed = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("l"))  # capacity pieces at most
    return listed.select("sequence_id", F.aggregate("l", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
