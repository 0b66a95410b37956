"""Hard-negative mining with a secondary sort.

Scores are integer inner products. Each score that can matter becomes a packed key: anchor,
score from high to low, whether the row is a positive, and id, as big-endian bytes whose order is
the order of the values. ``repartitionAndSortWithinPartitions`` deals the keys out by anchor and
sorts them, in runs on disk where they don't fit. An iterator reads the sorted keys once: an
anchor's first positives open windows of scores below theirs, and each negative that falls into an
open window is emitted until the window has its share. An anchor is never held in memory, only its
windows.

Scores are computed block against block: rows are packed into blocks of bounded bytes without a
shuffle, and each pair of an anchor block and a row block is one small group. Two passes keep the
shuffle small without losing a row: the first finds each block's best positives of each anchor;
with the windows known, the second keeps each block's first negatives of each window. Whatever is
first among all rows is first in its block.

Rows whose id or label is null or whose vector is null or holds a null or non-finite component take
no part, and only vectors of one length are compared. Of rows that share an id the one with the
smallest label and vector counts, so a repeated row counts once. Scores are exact while they fit
into 64 bits, for vectors of any length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import top_per_key
from .frames import written

BLOCK_BYTES = 2 << 20
ANCHOR_BYTES = 1 << 19
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOWER, UPPER = 50, 95
"""Per cent of a positive's score between which its negatives lie."""

KEY = struct.Struct(">QQBQ")
BIAS = 1 << 63

BLOCK = "block bigint, dim int, ids binary, labels binary, vectors binary"


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, all components finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of rows (id, label, v) of one vector length, at most ``size`` bytes each or one row."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 33
        waiting: dict[int, list[tuple]] = {}

        def block(dim: int) -> pd.DataFrame:
            nonlocal number
            number += 1
            ids, labels, vectors = zip(*sorted(waiting.pop(dim), key=lambda r: r[0]), strict=True)
            whole = np.floor(SCALE * np.asarray(vectors, float).reshape(len(ids), dim))
            kept = np.clip(whole, -(2.0**62), 2.0**62).astype("<i8")
            blobs = [np.asarray(ids, "<i8").tobytes(), np.asarray(labels, "<i8").tobytes(), kept.tobytes()]
            return pd.DataFrame([(number, dim, *blobs)], columns=["block", "dim", "ids", "labels", "vectors"])

        for batch in batches:
            for i, label, v in zip(batch["id"], batch["label"], batch["v"], strict=True):
                own = waiting.setdefault(len(v), [])
                own.append((i, label, v))
                if len(own) * (8 * len(v) + 16) >= size:
                    yield block(len(v))
                elif len(waiting) > 64:
                    yield block(max(waiting, key=lambda d: len(waiting[d]) * (d + 2)))
        for dim in list(waiting):
            yield block(dim)

    return rows.mapInPandas(pack, BLOCK)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integers: in doubles where these are exact, else in 64-bit integers."""
    largest = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if largest < 2.0**53:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    return anchors @ rows.T


def _arrays(row, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(getattr(row, f"{side}ids"), "<i8")
    return ids, np.frombuffer(getattr(row, f"{side}labels"), "<i8"), np.frombuffer(getattr(row, f"{side}vectors"), "<i8").reshape(len(ids), row.dim)


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties in the order given."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
        return near[np.argsort(-score[near], kind="stable")[:k]]
    return np.argsort(-score, kind="stable")[:k]


def _key(anchor: int, score: int, negative: int, row: int) -> bytes:
    return KEY.pack(anchor + BIAS, BIAS - 1 - score, negative, row + BIAS)


def _unpacked(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, negative, row = KEY.unpack(key)
    return anchor - BIAS, BIAS - 1 - score, negative, row - BIAS


def _of_anchor(key: bytes) -> int:
    return zlib.crc32(key[:8])


def _streamed(keys: Iterator[tuple[bytes, None]], positives: int, negatives: int) -> Iterator[tuple]:
    """Read sorted keys once. Per open window: positive, its score, negatives so far."""
    current, windows = None, []
    for key, _ in keys:
        anchor, score, negative, row = _unpacked(key)
        if anchor != current:
            current, windows = anchor, []
        if not negative:
            if len(windows) < positives:
                windows.append([row, score, 0])
            continue
        for window in windows:
            positive, high, taken = window
            if taken < negatives and LOWER * high <= 100 * score <= UPPER * high:
                window[2] += 1
                yield anchor, positive, window[2], row, high, score


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, block_bytes: int = BLOCK_BYTES, anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """Per anchor, positive and rank: negative_id, positive_score, negative_score.

    ``anchors`` marks the anchors by the columns of ``vectors``. A positive is one of the first
    ``positives`` other rows of the anchor's label, by score and id; its negatives are the first
    ``negatives`` rows of other labels whose scores lie between ``LOWER`` and ``UPPER`` per cent of its own.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asked"),
    )
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    rows = written(top_per_key(rows, ["id"], [F.col("label"), F.col("v"), F.col("asked")], 1).select("id", "label", "v", "asked"), "negatives-rows")
    row_blocks = written(packed(rows.select("id", "label", "v"), block_bytes), "negatives-blocks")
    asked = rows.filter("asked").select("id", "label", "v")
    anchor_blocks = written(packed(asked.hint("rebalance"), anchor_bytes), "negatives-anchors")

    numbers = row_blocks.select("block", "dim").groupBy("dim").agg(F.collect_list("block").alias("all"))  # a number per block of rows
    named = [F.col(c).alias(f"a_{c}") for c in ("block", "ids", "labels", "vectors")]

    def met(own: DataFrame, *more: str) -> DataFrame:
        """Every block of anchors with every block of rows of its vector length, by an equi-join on the row block."""
        spread = own.select(F.col("dim").alias("a_dim"), *named, *more).join(numbers, F.col("a_dim") == F.col("dim")).drop("dim")
        spread = spread.withColumn("block", F.explode("all")).drop("all", "a_dim")
        return row_blocks.join(spread.hint("shuffle_hash"), "block").groupBy("block", "a_block")

    def best(pairs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for pair in pairs.itertuples():
            own, own_labels, a = _arrays(pair, "a_")
            ids, labels, b = _arrays(pair, "")
            for at, score in enumerate(scores(a, b)):
                same = np.flatnonzero((labels == own_labels[at]) & (ids != own[at]))
                first = same[_first(score[same], positives)]
                out += [(int(pair.a_block), int(own[at]), int(score[j]), int(ids[j])) for j in first]
        return pd.DataFrame(out, columns=["a_block", "anchor", "score", "id"])

    found = met(anchor_blocks).applyInPandas(best, "a_block bigint, anchor bigint, score bigint, id bigint")
    opened = written(top_per_key(found, ["anchor"], [F.desc("score"), F.col("id")], positives).select("a_block", "anchor", "score", "id"), "negatives-positives")
    windows = opened.groupBy("a_block").agg(F.collect_list(F.struct("anchor", "score")).alias("w"))  # a few per anchor of a block
    windows = windows.select("a_block", F.col("w.anchor").alias("opened"), F.col("w.score").alias("highs"))
    with_windows = anchor_blocks.join(windows, F.col("block") == F.col("a_block")).drop("a_block")

    def below(pairs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for pair in pairs.itertuples():
            own, own_labels, a = _arrays(pair, "a_")
            ids, labels, b = _arrays(pair, "")
            bounds: dict[int, set[int]] = {}
            for anchor, high in zip(pair.opened, pair.highs, strict=True):
                bounds.setdefault(int(anchor), set()).add(int(high))
            for at, score in enumerate(scores(a, b)):
                other = np.flatnonzero(labels != own_labels[at])
                values = score[other]
                kept: set[int] = set()
                for high in bounds.get(int(own[at]), ()):
                    # LOWER * high <= 100 * score <= UPPER * high, as bounds of the score itself
                    inside = np.flatnonzero((values >= -(-LOWER * high // 100)) & (values <= UPPER * high // 100))
                    kept.update(inside[_first(values[inside], negatives)].tolist())
                out += [(int(own[at]), int(values[j]), int(ids[other[j]])) for j in kept]
        return pd.DataFrame(out, columns=["anchor", "score", "id"])

    lower = met(with_windows, "opened", "highs").applyInPandas(below, "anchor bigint, score bigint, id bigint")
    keyed = opened.select("anchor", "score", "id", F.lit(0).alias("negative")).unionByName(lower.withColumn("negative", F.lit(1)))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = keyed.rdd.map(lambda r: (_key(r[0], r[1], r[3], r[2]), None))
    ordered = pairs.repartitionAndSortWithinPartitions(parts, _of_anchor)
    mined = ordered.mapPartitions(lambda keys: _streamed(keys, positives, negatives))
    return spark.createDataFrame(mined, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
