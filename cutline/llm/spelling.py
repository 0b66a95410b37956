"""Grouping of spelling variants: asymmetric q-chunks, a positional join, verification.

Two words are near if one inserted, deleted or replaced code point makes them equal. Of such a
pair the shorter word (of two as long, the first in code-point order) contributes two disjoint
chunks, its first and its last half of ``q = length // 2`` code points; the edit spoils at most one
of them. The other word contributes its positional grams of that q. A chunk that the edit spares
lies in the other word at the same place or one further, so chunks and grams join on length, chunk
and text where their positions differ by one at most; of all grams only those near a chunk's
place are made. Every candidate is verified on the whole words, and a pair found by both chunks
counts once.

Chunks and grams are rows of the vocabulary, not of the texts: words are counted before the join,
map-side first. A chunk that very many words share is split by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import once, written

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 5
MIN_COUNT = 3


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``word``, one row for every run of letters; null and empty texts have none."""
    words = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(RUN), F.lit(0))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(words).alias("word")).withColumn("word", lowered(F.col("word")))


def dropped_letters(found: DataFrame, every: int = 97) -> DataFrame:
    """Delete one letter of the runs whose hash ``every`` divides: known misspellings, the same in every run.

    The hash is the crc32 of ``<id>:<word>`` (a null id counts as the text 'null'); the letter is
    the one at the hash modulo the length.
    """
    named = found.withColumn("_h", once(F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("word")))))
    at = (F.col("_h") % F.length("word")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return named.withColumn("word", F.when(F.col("_h") % every == 0, cut).otherwise(F.col("word"))).drop("_h")


def vocabulary(found: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word`` and its number of occurrences ``n``."""
    long = found.filter(F.length("word") >= min_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of distinct words one edit apart, each once, with their ``n`` as ``a_n`` and ``b_n``.

    ``words`` has distinct ``word`` of at least two code points and ``n``.
    """
    m = F.length("word")
    q = F.expr("length(word) div 2")
    chunks = words.select(
        F.col("word").alias("a"), F.col("n").alias("a_n"), m.alias("size"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), F.substring(F.col("word"), F.lit(1), q).alias("q")),
            F.struct(F.lit(1).alias("k"), (m - q).alias("at"), F.substring(F.col("word"), m - q + 1, q).alias("q")),
        )).alias("c"),
    ).select("a", "a_n", "size", "c.*")

    # Partners are as long as the word or one shorter; their last chunk begins at size - size div 2.
    sized = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(F.array(m - 1, m)).alias("b_size"))
    placed = sized.withColumn("b_k", F.explode(F.array(F.lit(0), F.lit(1))))
    start = F.when(F.col("b_k") == 0, 0).otherwise(F.expr("b_size - b_size div 2"))
    placed = placed.withColumn("b_at", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda shift: start + shift)))
    fits = (F.col("b_at") >= 0) & (F.col("b_at") + F.expr("b_size div 2") <= F.length("b"))
    grams = placed.filter(fits).withColumn("b_q", F.substring(F.col("b"), F.col("b_at") + 1, F.expr("b_size div 2")))

    met = (F.col("size") == F.col("b_size")) & (F.col("k") == F.col("b_k")) & (F.col("q") == F.col("b_q"))
    within = F.abs(F.col("at") - F.col("b_at")) <= 1
    once_each = (F.col("size") < F.length("b")) | (F.col("a") < F.col("b"))
    verified = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    found = chunks.join(grams, met & within & once_each & verified)
    return found.select("a", "a_n", "b", "b_n").distinct()


def grouped(words: DataFrame) -> DataFrame:
    """Per word: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word with the largest ``n`` (of several, the first in code-point order)
    if it occurs at least twice as often, else null. ``root`` is the last form reached by
    following forms, the word itself if it has none. Counts at least double along the way, so
    it has no circles and fewer than 64 steps, which six rounds of pointer doubling cover.
    """
    words = written(words, "spelling-words")
    pairs = written(near_pairs(words), "spelling-pairs")
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("top"))
    joined = words.join(best, "word", "left")
    strong = -F.col("top.less") >= 2 * F.col("n")
    formed = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(strong, F.col("top.form")).alias("form"), F.when(strong, -F.col("top.less")).alias("form_n"),
    )
    formed = written(formed, "spelling-forms")
    links = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(6):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = written(moved, "spelling-roots")
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    out = formed.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int | None = None) -> DataFrame:
    """Spelling groups of the words of all whole texts; with ``every``, planted misspellings come first (``dropped_letters``).

    Null and empty texts have no words, very long ones are read whole, repeated rows count as
    often as they occur, other columns are ignored and an empty table gives no rows.
    """
    found = runs(docs, id_col, text_col)
    found = dropped_letters(found, every) if every else found
    return grouped(vocabulary(found, min_length, min_count))
