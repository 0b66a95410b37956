"""Toxicity scores: gradient-boosted trees over dense text features, isotonic calibration.

Features come from one pass over the bytes of the whole text, for a slice of texts at once:
densities of lexicon hits by category, of words whose stems were learnt from the labels, of hits
near a second-person pronoun and of hits that only show once letter look-alikes and separators
are undone; rates of capital words, of marks and of masked words; the text's length. Trees and calibration are fitted by Spark ML on a
bounded, class-balanced and weighted sample of labelled rows (``SAMPLE_ROWS``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_batches
from . import wordhash
from .frames import without

SAMPLE_ROWS = 8000
"""Labelled rows that may train the model, half of them of each label if there are enough."""
SAMPLE_PARTS = 8
"""Tasks that read the sample: trees and calibration read it some forty times over, whatever the session's shuffle partitions."""
LEARNT_STEMS = 64
STEM_SIZES = (4, 5, 6)
LEARNT_SHARE = 0.02
LEARNT_PRECISION = 0.97
"""A learnt stem begins words in this share of the toxic sample, and that often only in toxic texts."""

# The default lexicon by category, and second-person pronouns.
LEXICON = {
    "insult": (
        "idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage clown clowns pathetic worthless disgusting "
        "imbecile cretin fool fools coward jerk creep freak pig pigs rat vermin filth filthy parasite parasites scumbag lowlife "
        "brainless clueless spineless ugly hideous repulsive useless dummkopf abschaum wertlos idiota imbecil estupido estupida "
        "basura escoria imbécile crétin ordure minable débile"
    ).split(),
    "profanity": "fuck fucking fucked shit shitty bitch bastard asshole crap damn scheisse scheiße arschloch puta mierda merde putain connard salope".split(),
    "threat": "kill die hang hurt destroy burn punch beat murder choke stab shoot".split(),
}
SECOND_PERSON = "you your you're youre yours yourself ur du dich dir dein deine ihr tú tu usted eres vous votre vos".split()
# Characters that stand in for letters.
_LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
NEAR = 4
"""A pronoun up to this many words before or after a hit is near it."""

FEATURES = ["insult", "profanity", "threat", "learnt", "hits", "near_you", "hidden", "capitals", "marks", "masked", "length"]


@dataclass
class ToxicityModel:
    """Learnt stems, trees and calibration; without both labels in the sample only ``prior``."""

    stems: list[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARK, _MASK, _JOIN = np.zeros((3, 256), dtype=bool)
_MARK[[ord(c) for c in "!?"]] = True
_MASK[[ord(c) for c in "*@$#0123456789"]] = True
_JOIN[[ord(c) for c in ".*_-"]] = True
_PLAIN = wordhash.LOWER.copy()
for _from, _to in _LOOK_ALIKES.items():
    _PLAIN[ord(_from)] = ord(_to)


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(wordhash.words(pa.array(words, pa.string()))[0]) if words else np.zeros(0, np.uint64)


def _sum(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Set flags between consecutive offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets]).astype(float)


def _known(words: wordhash.Words, lexicon: np.ndarray, stems: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which words are in the lexicon, and which begin with a stem."""
    begins = np.zeros(len(words.hashes), dtype=bool)
    for size, hashes in stems.items():
        begins |= np.isin(words.beginnings(size), hashes)
    return np.isin(words.hashes, lexicon), begins


def _undone(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter look-alikes replaced and separators between letters taken out."""
    plain = _PLAIN[data]
    letter = _LETTER[plain]
    drop = np.zeros(len(plain), dtype=bool)
    drop[1:-1] = _JOIN[plain[1:-1]] & letter[:-2] & letter[2:]
    return plain[~drop], offsets - np.concatenate([[0], np.cumsum(drop)])[offsets]


def features(texts: pa.Array, stems: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` per text (null: as empty)."""
    data, offsets = wordhash.text_bytes(texts)
    by_size = {n: _hashes([s for s in stems if len(s.encode()) == n]) for n in {len(s.encode()) for s in stems}}
    found = wordhash.split_words(wordhash.LOWER[data], offsets, ~_LETTER)
    count, size = {}, np.diff(found.offsets).astype(float)
    hit = np.zeros(len(found.hashes), dtype=bool)
    for name, words in LEXICON.items():
        inside, begins = _known(found, _hashes(words), by_size)
        count[name] = _sum(inside, found.offsets)
        hit |= inside | begins
    count["learnt"] = _sum(begins, found.offsets)
    pronoun = np.concatenate([[0], np.cumsum(np.isin(found.hashes, _hashes(SECOND_PERSON)))])
    place = np.flatnonzero(hit)
    text = np.searchsorted(found.offsets, place, "right") - 1
    near = np.zeros(len(hit), dtype=bool)
    near[place] = pronoun[np.minimum(place + NEAR + 1, found.offsets[text + 1])] > pronoun[np.maximum(place - NEAR, found.offsets[text])]
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shout = (upper[found.ends] - upper[found.starts] == found.ends - found.starts) & (found.ends - found.starts > 1)
    letter = _LETTER[data]
    masked = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        masked[1:-1] = _MASK[data[1:-1]] & letter[:-2] & letter[2:]
    undone = wordhash.split_words(*_undone(data, offsets), ~_LETTER)
    all_words = _hashes([w for ws in LEXICON.values() for w in ws])
    unmasked = _sum(np.logical_or(*_known(undone, all_words, by_size)), undone.offsets)
    hits = _sum(hit, found.offsets)
    rate = 1 / np.maximum(size, 1)
    columns = {name: count[name] * rate for name in [*LEXICON, "learnt"]} | {
        "hits": np.minimum(hits, 20),
        "near_you": _sum(near, found.offsets) * rate,
        "hidden": np.maximum(unmasked - hits, 0) * rate,
        "capitals": _sum(shout, found.offsets) * rate,
        "marks": _sum(_MARK[data], offsets) * rate,
        "masked": _sum(masked, offsets) * rate,
        "length": np.log1p(size),
    }
    return np.stack([columns[name] for name in FEATURES], axis=1)


def learn_stems(sample: DataFrame) -> list[str]:
    """Beginnings of words that tell toxic texts (``y`` 1) of a bounded sample from the others.

    A stem that extends another learnt one is left out.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{{min(STEM_SIZES)},}}"), 0)
    stems = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(*[F.left(w, F.lit(n)) for n in STEM_SIZES]))))
    n_toxic = sample.filter("y = 1").count()
    seen = sample.select("y", F.explode(stems).alias("stem")).groupBy("stem").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n"))
    good = seen.filter((F.col("toxic") >= max(5.0, LEARNT_SHARE * n_toxic)) & (F.col("toxic") >= LEARNT_PRECISION * F.col("n")))
    kept: list[str] = []
    for row in good.orderBy(F.desc("toxic"), "stem").limit(8 * LEARNT_STEMS).collect():
        kept = [k for k in kept if not k.startswith(row["stem"])] + [row["stem"]] if not any(row["stem"].startswith(k) for k in kept) else kept
    return sorted(kept[:LEARNT_STEMS])


def _vectors(df: DataFrame, text_col: str, stems: list[str]) -> DataFrame:
    """Add the feature vector ``_x``; the text passes through the workers with its row."""
    schema = T.StructType([*df.schema.fields, T.StructField("_f", T.ArrayType(T.DoubleType()))])
    at = df.columns.index(text_col)
    small_batches(df.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, batch.schema.names[at]):
                rows = features(part.column(at), stems)
                lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=schema.names)

    return df.mapInArrow(measure, schema).withColumn("_x", array_to_vector("_f")).drop("_f")


def _raw(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    scored = trees.transform(rows)
    return scored.withColumn("_p", vector_to_array("_prob")[1]).drop("_raw", "_prob", "_class", "_x")


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Train on labelled rows that ``train_rows`` (over the column ``id_col``) marks.

    The sample takes the rows of each label with the smallest hash of their id (of each of 64
    slices of the ids at first), weighted by what they stand for. Three tenths of it calibrate, the rest grow the trees.
    """
    usable = labels.filter(train_rows).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).filter("y in (0, 1)")
    totals = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = totals.get(1.0, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return ToxicityModel([], None, None, prior)
    # Candidates first come from 64 slices of the ids, so that no task ranks all rows of a label.
    by_hash = [F.xxhash64("id"), F.col("id")]
    sliced = usable.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(64)))
    sliced = sliced.withColumn("rn", F.row_number().over(Window.partitionBy("y", "slice").orderBy(*by_hash))).filter(F.col("rn") <= max(1, sample_rows // 32))
    picked = sliced.withColumn("rn", F.row_number().over(Window.partitionBy("y").orderBy(*by_hash))).filter(F.col("rn") <= sample_rows // 2).drop("rn", "slice")
    weight = F.when(F.col("y") == 1, totals[1.0] / min(totals[1.0], sample_rows // 2)).otherwise(totals[0.0] / min(totals[0.0], sample_rows // 2))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # The picked rows are ids and labels, at most sample_rows of them, so they may be broadcast.
    sample = texts.join(F.broadcast(picked), "id").withColumns({"w": weight, "part": F.pmod(F.xxhash64("id", F.lit("part")), F.lit(10))})
    sample = sample.repartition(SAMPLE_PARTS, "id").coalesce(SAMPLE_PARTS).persist()
    words = learn_stems(sample.filter("part >= 3"))
    rows = _vectors(sample, "text", words).select("_x", "y", "w", "part").persist()
    try:
        grown = rows.filter("part >= 3")
        if grown.select("y").distinct().count() < 2:
            return ToxicityModel(words, None, None, prior)
        booster = GBTClassifier(featuresCol="_x", labelCol="y", weightCol="w", predictionCol="_class", maxIter=12, maxDepth=3, stepSize=0.3, seed=1)
        booster = booster.setProbabilityCol("_prob").setRawPredictionCol("_raw")
        trees = booster.fit(grown)
        held = _raw(trees, rows.filter("part < 3").withColumnRenamed("y", "label"))
        calibration = IsotonicRegression(featuresCol="_p", labelCol="label", weightCol="w", predictionCol="_s").fit(held) if held.take(1) else None
        return ToxicityModel(words, trees, calibration, prior)
    finally:
        rows.unpersist()
        sample.unpersist()


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the calibrated probability of toxicity; null and empty texts score like a text without words.

    Columns that bear the new name, or one that starts with ``_``, are replaced.
    """
    base = without(df, [score_col, "_f", "_x", "_p", "_s", "_raw", "_prob", "_class"])
    if model.trees is None:
        return base.withColumn(score_col, F.lit(float(model.prior)))
    scored = _raw(model.trees, _vectors(base, text_col, model.stems))
    if model.calibration is None:
        return scored.withColumnRenamed("_p", score_col)
    bounded = F.least(F.greatest(F.col("_s"), F.lit(0.0)), F.lit(1.0))
    return model.calibration.transform(scored).withColumn(score_col, bounded).drop("_p", "_s")
