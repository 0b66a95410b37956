"""Language-model scoring by deleted interpolation.

P(w | v) = weight[b] * c(v, w) / c(v) + (1 - weight[b]) * base(w), where b is the frequency bucket
(power of two) of the context v and base(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). A context that
was never seen leaves the base alone. Each bucket's weight is learnt by expectation-maximisation
on held-out counts: one tenth of the training texts, scored with the counts of the others.

Counting and scoring never hold a whole table of n-grams in one place:

1. Texts are cut into chunks of about ``CHUNK`` tokens, written once as word numbers plus the
   chunk's own words (64-bit hashes).
2. Every chunk asks for the counts of its distinct words and pairs: sorted keys and the chunk's
   own training counts, packed per key range. One key comes once from a chunk, however often its
   texts hold it, so no word or pair is a hot key.
3. A key range sums the counts of all chunks and answers each chunk in the order it asked.
4. The answers meet their chunk again, which then knows the corpus counts of all its tokens.

The number of key ranges follows the number of tokens, so a range stays the same size. All
training texts count whole; no n-gram is dropped.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches
from . import wordhash
from .frames import written

CHUNK = 700_000
SLICE = 1 << 19
RANGE_TOKENS = 1_000_000
BUCKETS = 48
"""Context-frequency buckets: powers of two."""
BINS = 256
BIN_WIDTH = 0.25
LOWEST_BIN = -20.0
"""Ratios of pair estimate to base are held as a histogram of their base-2 logarithms."""
ROUNDS = 60

_END, _START = np.uint64(1), np.uint64(2)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_SCHEMA = "chunk bigint, held boolean, ids array<bigint>, folds array<int>, sizes array<bigint>, vocab binary, words binary"


def _give_back() -> None:
    """Return freed memory to the system: a worker process outlives its task, and its executor has a limit for all."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of whole numbers: planes of zeros compress away."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _chunk_row(parts: list[tuple], number: int, held: bool) -> pa.RecordBatch:
    ids, folds, sizes, hashes = ([x for p in parts for x in p[0]], *(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3)))
    vocab, words = np.unique(hashes, return_inverse=True)
    arrays = [
        pa.array([number], pa.int64()),
        pa.array([held]),
        pa.array([ids], pa.list_(pa.int64())),
        pa.array([folds.astype(np.int32)], pa.list_(pa.int32())),
        pa.array([sizes], pa.list_(pa.int64())),
        pa.array([vocab.tobytes()], pa.binary()),
        pa.array([_pack(words.astype(np.int32))], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["chunk", "held", "ids", "folds", "sizes", "vocab", "words"])


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks of (id, text, fold) rows; texts of fold 2 (held-out training) have chunks of their own.

    Fold 0: scored only, 1: training, 2: training that is held out while weights are learnt.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list] = {False: [], True: []}
        number = {False: TaskContext.get().partitionId() << 32, True: (TaskContext.get().partitionId() << 32) + 1}  # odd: held out
        for batch in batches:
            for part in wordhash.slices(batch, "text", SLICE):
                hashes, offsets = wordhash.words(part.column(1))
                folds = part.column(2).to_numpy()
                sizes = np.diff(offsets)
                everything = np.insert(hashes, offsets[1:], _END)
                of_token = np.repeat(folds == 2, sizes + 1)
                for held in (False, True):
                    rows = (folds == 2) == held
                    if rows.any():
                        waiting[held].append((part.column(0).filter(pa.array(rows)).to_pylist(), folds[rows], sizes[rows] + 1, everything[of_token == held]))
                    if sum(len(p[3]) for p in waiting[held]) >= size:
                        yield _chunk_row(waiting[held], number[held], held)
                        waiting[held] = []
                        number[held] += 2
        for held, parts in waiting.items():
            if parts:
                yield _chunk_row(parts, number[held], held)
        _give_back()

    return docs.mapInArrow(cut, _CHUNK_SCHEMA)


def _tokens(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's vocabulary, word numbers, pair keys, text offsets and folds per text."""
    vocab, words = np.frombuffer(row.vocab, np.uint64), _unpack(row.words, np.int32)
    offsets = np.concatenate([[0], np.cumsum(np.asarray(row.sizes, np.int64))]).astype(np.int64)
    before = np.empty(len(words), np.uint64)
    before[1:] = vocab[words[:-1]]
    before[offsets[:-1]] = _START
    return vocab, words, wordhash.mix(before * _PAIR + vocab[words]), offsets, np.asarray(row.folds)


def _asked(chunk_rows: DataFrame, bits: int) -> DataFrame:
    """(kind, range, chunk, keys, counts of fold 1, counts of folds 1 and 2) per chunk and key range."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                vocab, words, pairs, offsets, folds = _tokens(row)
                fold = np.repeat(folds, np.diff(offsets))
                keys, number = np.unique(pairs, return_inverse=True)
                for kind, key, index in (("word", vocab, words), ("pair", keys, number)):
                    kept = np.bincount(index[fold == 1], minlength=len(key))
                    train = kept + np.bincount(index[fold == 2], minlength=len(key))
                    place = (key >> np.uint64(64 - bits)).astype(np.int64)
                    edge = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(key)]])
                    yield pd.DataFrame(
                        [
                            (kind, int(place[a]), row.chunk, _pack(np.diff(key[a:b], prepend=np.uint64(0))), _pack(kept[a:b]), _pack(train[a:b]))
                            for a, b in zip(edge[:-1], edge[1:], strict=True)
                            if b > a
                        ],
                        columns=["kind", "range", "chunk", "keys", "kept", "train"],
                    )
        _give_back()

    return chunk_rows.mapInPandas(ask, "kind string, range bigint, chunk bigint, keys binary, kept binary, train binary")


def _answered(asked: DataFrame) -> DataFrame:
    """Corpus counts per chunk and key range in the order asked; one row (chunk null) counts distinct words."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        keys = [np.cumsum(_unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
        unique, number = np.unique(np.concatenate(keys), return_inverse=True)
        totals = []
        for name in ("kept", "train"):
            total = np.zeros(len(unique), np.int64)
            np.add.at(total, number, np.concatenate([_unpack(c) for c in rows[name]]))
            totals.append(total)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        kind, place = rows["kind"].iloc[0], rows["range"].iloc[0]
        out = [
            (kind, place, chunk, _pack(totals[0][part]), _pack(totals[1][part]), 0, 0)
            for chunk, part in zip(rows["chunk"], np.split(number, ends), strict=True)
        ]
        out.append((kind, place, None, b"", b"", int((totals[0] > 0).sum()), int((totals[1] > 0).sum())))
        out = pd.DataFrame(out, columns=["kind", "range", "chunk", "kept", "train", "v_kept", "v_train"])
        del keys, unique, number, totals
        _give_back()
        return out.astype({"chunk": "Int64"})

    schema = "kind string, range bigint, chunk bigint, kept binary, train binary, v_kept bigint, v_train bigint"
    return asked.groupBy("kind", "range").applyInPandas(answer, schema)


def _counts(row, answers: pd.DataFrame, name: str, n_docs: int) -> tuple[np.ndarray, ...]:
    """Per token of a chunk: count of its word, of its context, of the pair."""
    vocab, words, pairs, offsets, _ = _tokens(row)
    answers = answers.sort_values("range")

    def of(kind: str) -> np.ndarray:
        return np.concatenate([_unpack(c) for c in answers.loc[answers["kind"] == kind, name]])

    word = of("word")[words]
    pair = of("pair")[np.unique(pairs, return_inverse=True)[1]]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[offsets[:-1]] = n_docs
    return word, context, pair


def _ratios(word: np.ndarray, context: np.ndarray, pair: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: base probability, pair estimate over base, context bucket (-1: context never seen)."""
    base = (word + 0.5) / (n + 0.5 * (v + 1))
    seen = context > 0
    ratio = np.where(seen, pair / np.maximum(context, 1), 0) / base
    bucket = np.where(seen, np.minimum(np.log2(np.maximum(context, 1)).astype(int), BUCKETS - 1), -1)
    return base, ratio, bucket


def _histogram(chunk_rows: DataFrame, answers: DataFrame, n: int, v: int, n_docs: int) -> DataFrame:
    """Held-out tokens by context bucket and ratio bin (bin -1: pair never seen)."""

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            _, ratio, bucket = _ratios(*_counts(row, right, "kept", n_docs), n, v)
            bins = np.clip((np.log2(np.maximum(ratio, 1e-12)) - LOWEST_BIN) / BIN_WIDTH, 0, BINS - 1).astype(int)
            bins[ratio == 0] = -1
            keys, counts = np.unique((bucket * (BINS + 1) + bins + 1)[bucket >= 0], return_counts=True)
            out.append(pd.DataFrame({"bucket": keys // (BINS + 1), "bin": keys % (BINS + 1) - 1, "n": counts}))
        return pd.concat(out) if out else pd.DataFrame({"bucket": [], "bin": [], "n": []})

    grouped = chunk_rows.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    rows = grouped.applyInPandas(count, "bucket bigint, bin bigint, n bigint")
    return rows.groupBy("bucket", "bin").agg(F.sum("n").alias("n"))


def learn_weights(histogram: list[tuple[int, int, int]]) -> np.ndarray:
    """Each bucket's weight of the pair estimate, by expectation-maximisation; 0 where nothing was held out."""
    weights = np.zeros(BUCKETS)
    for b in range(BUCKETS):
        rows = [(i, n) for bucket, i, n in histogram if bucket == b]
        if rows:
            bins, counts = np.array(rows, float).T
            ratio = np.where(bins < 0, 0, 2.0 ** (LOWEST_BIN + (bins + 0.5) * BIN_WIDTH))
            weight = 0.5
            for _ in range(ROUNDS):
                mixed = weight * ratio
                weight = float((counts * mixed / (mixed + 1 - weight)).sum() / counts.sum())
                weight = min(max(weight, 1e-9), 1 - 1e-9)
            weights[b] = weight
    return weights


def score(docs: DataFrame, fold: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fold, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    ``fold`` names the column described at ``chunks``. A text is its words (A-Z lower-cased) and
    one end; null and empty texts are the end alone. Without training texts both scores are 0.
    Rows are scored each for itself; ids may be null or repeat.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{fold}`").cast("int").alias("fold"))
    cut = written(chunks(rows), "lm-chunks")
    per_text = cut.select(F.explode(F.arrays_zip("folds", "sizes")).alias("t")).select("t.folds", "t.sizes")
    sums = {r["folds"]: (r["tokens"], r["docs"]) for r in per_text.groupBy("folds").agg(F.sum("sizes").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    tokens = {k: sums.get(k, (0, 0))[0] for k in (0, 1, 2)}
    texts = {k: sums.get(k, (0, 0))[1] for k in (1, 2)}
    n_kept, n_train = tokens[1], tokens[1] + tokens[2]
    bits = max(3, math.ceil(math.log2(max(1, sum(tokens.values()) / RANGE_TOKENS))))
    answers = written(_answered(_asked(cut, bits)), "lm-counts")
    sizes = answers.filter("chunk is null and kind = 'word'").agg(F.sum("v_kept").alias("k"), F.sum("v_train").alias("t")).first()
    v_kept, v_train = sizes["k"] or 0, sizes["t"] or 0
    answers = answers.filter("chunk is not null")

    held = cut.filter("held")
    of_held = answers.filter("chunk % 2 = 1").select("chunk", "kind", "range", "kept")
    seen = _histogram(held, of_held, n_kept, v_kept, texts[1]).collect()
    weights = learn_weights([(r["bucket"], r["bin"], r["n"]) for r in seen])

    def add_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            word, context, pair = _counts(row, right, "train", texts[1] + texts[2])
            base, ratio, bucket = _ratios(word, context, pair, n_train, v_train)
            weight = np.where(bucket >= 0, weights[bucket], 0)
            starts = np.concatenate([[0], np.cumsum(np.asarray(row.sizes, np.int64))]).astype(np.int64)[:-1]
            low = np.log10(base)
            out.append(
                pd.DataFrame(
                    {
                        "id": pd.array(row.ids, dtype="Int64") if any(i is None or i != i for i in row.ids) else row.ids,
                        "fold": row.folds,
                        "n_tokens": row.sizes,
                        "n_known": np.add.reduceat((word > 0).astype(np.int64), starts),
                        "base_score": np.add.reduceat(low, starts),
                        "score": np.add.reduceat(low + np.log10(weight * ratio + 1 - weight), starts),
                    }
                )
            )
        _give_back()
        return pd.concat(out)

    grouped = cut.groupBy("chunk").cogroup(answers.select("chunk", "kind", "range", "train").groupBy("chunk"))
    scored = grouped.applyInPandas(add_up, "id bigint, fold int, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n_train).cast("bigint"))
