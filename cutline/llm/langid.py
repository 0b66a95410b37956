"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to 3, learnt from a bounded sample of
labelled texts and then frozen. A symbol that a context has not seen costs an escape (method C:
distinct successors over count plus distinct successors) and is coded by the next shorter
context with the seen symbols excluded, down to a uniform code. The frozen code length of every
(context, symbol) is tabulated once in each worker, so scoring a text is one table row per byte;
the driver holds and ships only the counts. A longest context that no language has seen reads the
rows of its next shorter one, as it has no lengths of its own.

Bytes are folded to ``SYMBOLS`` classes (the most frequent bytes of the sample, and one class
for the others), which bounds the tables: SYMBOLS**4 + SYMBOLS**3 rows with one length per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_batches
from . import wordhash
from .frames import without

SYMBOLS = 40
ORDER = 3
PER_LANGUAGE = 300
"""Labelled texts that train one language: the bound of the training sample."""


@dataclass
class PpmModel:
    """Symbol class of each byte, languages in order, and per language the (context, symbol) rows of its sample with their counts."""

    classes: np.ndarray
    languages: list[str]
    seen: list[tuple[np.ndarray, np.ndarray]]

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """First row of each context and the rows' bits per language, worked out where they are first read."""
        used = np.unique(np.concatenate([np.zeros(0, np.int32), *(rows // SYMBOLS for rows, _ in self.seen)]))
        shorter = SYMBOLS ** (ORDER - 1)
        first = np.tile(np.arange(shorter, dtype=np.int32), SYMBOLS)
        first[used] = shorter + np.arange(len(used), dtype=np.int32)
        bits = np.empty(((shorter + len(used)) * SYMBOLS, len(self.seen)), np.float32)
        for i, (rows, counts) in enumerate(self.seen):
            bits[:, i] = _lengths(rows, counts, used)
        return first * SYMBOLS, bits

    @property
    def bits(self) -> np.ndarray:
        """Bits of every (context, symbol) row per language, spelled out; scoring reads ``table``."""
        first, bits = self.table
        return bits[(first[:, None] + np.arange(SYMBOLS, dtype=np.int32)).ravel()]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}


def training_sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Up to ``per_language`` whole texts of each language, those with the smallest hash of their id."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = top_hashes(rows.select("lang", "id"), per_language).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= per_language)
    # As many ids as training texts, which the driver is to hold: small enough to broadcast.
    return rows.join(F.broadcast(picked.drop("rn")), ["lang", "id"], "left_semi").select("lang", F.lower("text").alias("text"))


def top_hashes(rows: DataFrame, per_language: int) -> DataFrame:
    """Candidates for each language's smallest hashes: those of 64 slices of its rows, so that no
    task ranks more than a slice."""
    order = Window.partitionBy("lang", "slice").orderBy(F.xxhash64("id"), "id")
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rn", F.row_number().over(order))
    return sliced.filter(F.col("rn") <= max(1, per_language // 16)).drop("slice", "rn")


def _padded(data: np.ndarray, offsets: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with ``ORDER`` spaces before every text, and each text's first padded position."""
    sizes = np.diff(offsets)
    out = np.full(len(data) + ORDER * len(sizes), space, dtype=np.int32)
    out[np.arange(len(data)) + ORDER * (np.repeat(np.arange(len(sizes)), sizes) + 1)] = data
    return out, offsets[:-1] + ORDER * np.arange(1, len(sizes) + 1)


def _rows(symbols: np.ndarray) -> np.ndarray:
    """Table row of each position from ``ORDER`` on: its last symbols and its own as one number."""
    row = symbols[:-ORDER].copy()
    for k in range(1, ORDER + 1):
        row *= SYMBOLS
        row += symbols[k : len(symbols) - ORDER + k]
    return row


def _lengths(rows: np.ndarray, counts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Bits of one language's counts, escapes with exclusion: rows of all contexts one shorter than the longest, then of the longest ones in ``used``."""
    p = np.full((1, SYMBOLS), 1 / SYMBOLS, dtype=np.float32)
    for order in range(ORDER):
        size = SYMBOLS ** (order + 1)
        c = np.bincount(rows % size, counts, size).astype(np.float32).reshape(-1, SYMBOLS)
        # Contexts that differ in their first symbol alone share their shorter contexts.
        p = _mixed(c, np.tile(p, (len(c) // len(p), 1)))
    c = np.zeros((len(used), SYMBOLS), np.float32)
    c[np.searchsorted(used, rows // SYMBOLS), rows % SYMBOLS] = counts
    p = np.concatenate([p, _mixed(c, p[used % len(p)])])
    np.maximum(p, np.float32(1e-30), out=p)
    return np.negative(np.log2(p, out=p), out=p).ravel()


def _mixed(c: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities in contexts with these counts, given those of the next shorter contexts."""
    seen = c > 0
    total, distinct = c.sum(1, keepdims=True), seen.sum(1, keepdims=True, dtype=np.float32)
    rest = 1 - np.where(seen, lower, 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        escaped = distinct / (total + distinct) * lower / rest
        p = np.where(seen, c / (total + distinct), escaped)
        return np.where(total == 0, lower, np.where(distinct == SYMBOLS, c / total, p))


def train(sample: list[tuple[str, str]]) -> PpmModel:
    """Build the trees of all languages from (language, lower-cased text) rows."""
    languages = sorted({lang for lang, _ in sample})
    blobs = {lang: [t.encode() for x, t in sample if x == lang] for lang in languages}
    frequency = sum((np.bincount(np.frombuffer(b, np.uint8), minlength=256) for bs in blobs.values() for b in bs), np.zeros(256, int))
    frequency[0x20] = frequency.max() + 1
    classes = np.zeros(256, dtype=np.int32)
    common = [b for b in np.argsort(-frequency, kind="stable") if frequency[b]][: SYMBOLS - 1]
    classes[common] = np.arange(1, len(common) + 1)
    found = []
    for lang in languages:
        data = classes[np.frombuffer(b"".join(blobs[lang]), np.uint8)]
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs[lang]])]).astype(np.int64)
        symbols, starts = _padded(data, offsets, classes[0x20])
        inside = np.ones(len(symbols), dtype=bool)
        inside[(starts[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
        found.append(np.unique(_rows(symbols)[inside[ORDER:]], return_counts=True))
    return PpmModel(classes, languages, found)


def code_lengths(model: PpmModel, texts: pa.Array) -> np.ndarray:
    """Exact bits of each text under each language."""
    data, offsets = wordhash.text_bytes(texts)
    symbols, starts = _padded(model.classes[data], offsets, model.classes[0x20])
    total = np.zeros((len(symbols) - ORDER + 1, len(model.languages)))
    first, bits = model.table
    np.cumsum(bits[first[_rows(symbols) // SYMBOLS] + symbols[ORDER:]], axis=0, dtype=np.float64, out=total[1:])
    return total[starts - ORDER + np.diff(offsets)] - total[starts - ORDER]


def identify(df: DataFrame, text_col: str, model: PpmModel, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the language with the shortest code and its posterior under equal priors.

    ``und`` with score 0 where the text is null or has no letter, or the model knows no
    language. Ties go to the first language in order. Columns that bear the new names are replaced.
    """
    base = without(df, [pred_col, score_col, "_low"])
    low = F.when(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lower(f"`{text_col}`"))
    if not model.languages:
        return base.withColumns({pred_col: F.lit("und"), score_col: F.lit(0.0)})
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*base.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        names = np.array(ppm.languages, dtype=object)
        for batch in batches:
            for part in wordhash.slices(batch, "_low"):
                texts = part.column(part.num_columns - 1)
                bits = code_lengths(ppm, texts)
                best = bits.argmin(1)
                known = texts.is_valid().to_numpy(zero_copy_only=False)
                gap = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000))
                pred = np.where(known, names[best], "und")
                value = np.where(known, 1 / gap.sum(1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred, pa.string()), pa.array(value)], names=schema.names)

    return base.withColumn("_low", low).mapInArrow(score, schema)


def fit(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PpmModel:
    """Train on the bounded sample of the rows that ``train_rows`` marks; that sample is all the driver sees."""
    rows = training_sample(docs.filter(train_rows), id_col, text_col, lang_col).collect()
    return train([(r["lang"], r["text"]) for r in rows])
