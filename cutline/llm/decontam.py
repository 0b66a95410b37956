"""Benchmark decontamination by spaced seeds.

Tokens are runs of letters and digits of the lower-cased text; in scripts written without spaces
each letter is one. A seed is the hash of the tokens
that a fixed mask keeps of a run (``1``: kept, ``0``: ignored), so a substituted token breaks
only the seeds that keep it. Seeds of the benchmark and of every document position are joined,
and every hit is verified: of the windows of ``WINDOW`` tokens that contain it, the best must
agree in ``AGREE`` of its positions.

Items shorter than the window are one window themselves; items shorter than the masks (but of
``SHORT`` tokens or more) are seeded by their first ``SHORT`` tokens less any one of them. At
every length the masks together ignore each set of changed tokens that ``AGREE`` allows, so no
leak goes unseen. Items under ``SHORT`` tokens are too short to tell a leak from chance and
match nothing.

All of it is DataFrame operations. Documents are cut into slices of ``SLICE`` positions, each with the
tokens that its windows reach, so a row holds a slice and never a whole document: what a long one
takes grows with its length alone. Positions are tested against a bit filter sized by the seeds
before anything is shuffled, so only likely hits reach the join. Items of equal tokens are looked
for once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dealt
from .frames import bit_filter, bit_table, bit_test, filter_words, maybe_in, once, written

MASKS = ("1110010101", "1101100011", "1011001101", "1000111011", "0011110110", "1101011100", "0111011001", "0110101110", "0101111010")
"""Weight 6 of span 10: for any two of the ten positions, one mask ignores both."""
FULL = 4
"""Of a window of ``WINDOW`` tokens, the first four masks ignore any two in one of its places."""
SHORT = 5
SHORT_MASKS = tuple("1" * k + "0" + "1" * (SHORT - 1 - k) for k in range(SHORT))
ALL_MASKS = MASKS + SHORT_MASKS
UNSPACED = (
    r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF"
    r"\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
)
"""Thai, Lao, Burmese, Khmer, kana and Han."""
TOKEN = rf"[\p{{L}}\p{{N}}&&[^{UNSPACED}]]+|[\p{{L}}\p{{N}}]"
WINDOW = 13
AGREE = 0.8
SPAN = len(MASKS[0])
_BEFORE = WINDOW - SPAN
SLICE = 128
FILTER_WORDS = 1 << 23
"""At most: 64 MB, sixteen bits each for 33 million seeds."""
LEAKY_WORDS = 1 << 18
"""2 MB at most, as the plan holds them; a million leaky ids have sixteen bits each."""


def token_hashes(text: Column) -> Column:
    """64-bit hashes of a text's tokens, in order (null: none)."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _run(tokens: str, position: str) -> list[Column]:
    """Columns x0, x1, ... of the tokens from ``position`` on, null outside of the text.

    Bound once, so that the many masks do not repeat the look-ups in the generated code.
    """
    return [F.get(tokens, (F.col(position) + k).cast("int")).alias(f"x{k}") for k in range(SPAN)]


def _seed(mask: str, number: int) -> Column:
    """Hash of the tokens of a run that the mask keeps, null where the mask does not fit."""
    kept = [F.col(f"x{k}") for k, c in enumerate(mask) if c == "1"]
    return F.when(F.col(f"x{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(number), *kept))


def _around(tokens: str, position: str) -> Column:
    """The tokens that windows around a hit can reach, null outside of the text."""
    reach = F.sequence(F.lit(-_BEFORE), F.lit(WINDOW - 1))
    return F.transform(reach, lambda k: F.get(tokens, (F.col(position) + k).cast("int")))


def item_seeds(items: DataFrame) -> DataFrame:
    """(class, n, q, window, item_around, mask, seed) of every position and mask of ``items``, rows of class and tokens t."""
    rows = items.withColumn("n", F.size("t"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    fits = [(F.col("n") >= SPAN) & ((F.col("n") < WINDOW) | F.lit(i < FULL)) for i in range(len(MASKS))]
    fits += [(F.col("n") < SPAN) & (F.col("q") == 0)] * SHORT
    seeds = [F.when(fit, _seed(mask, i)) for i, (fit, mask) in enumerate(zip(fits, ALL_MASKS, strict=True))]
    return rows.select("class", "t", "n", "q", *_run("t", "q")).select(
        "class", "n", "q", F.least("n", F.lit(WINDOW)).alias("window"), _around("t", "q").alias("item_around"), F.posexplode(F.array(*seeds)).alias("mask", "seed")
    ).filter(F.col("seed").isNotNull())


def _slices(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, m, s, first, t): of a text of m tokens the positions from s on, and the tokens they reach, from the one numbered ``first`` on."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), once(token_hashes(F.col(f"`{text_col}`"))).alias("tokens"))
    rows = rows.filter(F.size("tokens") >= SHORT).select("doc_id", F.size("tokens").alias("m"), "tokens")

    def part(s: Column) -> Column:
        first = F.greatest(s - _BEFORE, F.lit(0))
        return F.struct(s.alias("s"), first.alias("first"), F.slice("tokens", first + 1, s + SLICE + WINDOW - 1 - first).alias("t"))

    starts = F.sequence(F.lit(0), F.col("m") - SHORT, F.lit(SLICE))
    return rows.select("doc_id", "m", F.explode(F.transform(starts, part)).alias("part")).select("doc_id", "m", "part.*")


def _agreement() -> tuple[Column, Column]:
    """Most agreeing positions over the windows that contain the hit and lie inside both texts,
    from a column ``equal``, and the column itself.

    Work on few rows: array functions keep the generated code of the scan before them small.
    """
    equal = F.zip_with("item_around", "doc_around", lambda a, b: F.when(a == b, 1).otherwise(0))

    def agreeing(start: Column) -> Column:
        inside = (F.col("q") + start >= 0) & (F.col("p") + start >= 0) & (F.col("q") + start + F.col("window") <= F.col("n"))
        inside = inside & (F.col("p") + start + F.col("window") <= F.col("m"))
        reaches = (start + F.col("window") >= SPAN) | (F.col("n") < SPAN)
        return F.when(inside & reaches, F.aggregate(F.slice("equal", start + _BEFORE + 1, F.col("window")), F.lit(0), lambda x, y: x + y))

    starts = F.sequence(F.lit(-_BEFORE), F.lit(0))
    return F.array_max(F.transform(starts, agreeing)), equal


def _tokens(items: DataFrame, item_id_col: str, item_text_col: str) -> DataFrame:
    """(item_id, class, t) of the items that can match; items of equal tokens share a class."""
    rows = items.select(F.col(f"`{item_id_col}`").alias("item_id"), token_hashes(F.col(f"`{item_text_col}`")).alias("t"))
    return written(rows.filter(F.size("t") >= SHORT).withColumn("class", F.xxhash64("t")), "leak-items")


def _matches(docs: DataFrame, tokens: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, class, matched, window) of every hit that agrees; a document and a class may come many times."""
    seeds = written(item_seeds(dealt(tokens.select("class", "t").dropDuplicates(["class"]), "class")), "leak-seeds")
    masks = [r["mask"] for r in seeds.select("mask").distinct().orderBy("mask").collect()]
    words = filter_words(2 * seeds.count(), FILTER_WORDS)
    rows = _slices(docs, id_col, text_col)
    rows = rows.withColumn("p", F.explode(F.sequence(F.col("s"), F.least(F.col("s") + SLICE - 1, F.col("m") - SHORT))))
    rows = rows.withColumn("at", F.col("p") - F.col("first")).select("doc_id", "m", "t", "p", "at", *_run("t", "at"))
    found = F.array(*[_seed(ALL_MASKS[i], i) for i in masks]) if masks else F.array().cast("array<bigint>")
    rows = rows.select("doc_id", "m", "t", "p", "at", F.explode(found).alias("seed"))
    rows = maybe_in(rows, bit_table(seeds, "seed", words), "seed", words).select("doc_id", "m", "p", _around("t", "at").alias("doc_around"), "seed")
    best, equal = _agreement()
    hits = rows.join(seeds, "seed").withColumn("equal", once(equal)).withColumn("matched", once(best))
    return hits.filter(F.col("matched") >= F.col("window") * AGREE).select("doc_id", "class", "matched", "window")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it leaks: doc_id, item_id, matched, window.

    ``matched`` is the largest number of agreeing tokens in a window, ``window`` its length.
    Empty and null texts leak nothing; rows with equal ids count as one document; repeated items
    with one id as one item. Other columns are not read.
    """
    tokens = _tokens(items, item_id_col, item_text_col)
    most = [F.max("matched").cast("bigint").alias("matched"), F.max("window").cast("bigint").alias("window")]
    found = _matches(docs, tokens, id_col, text_col).groupBy("doc_id", "class").agg(*most)
    return found.join(tokens.select("item_id", "class").distinct(), "class").groupBy("doc_id", "item_id").agg(*most)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without those that leak an item; rows that share an id share the decision.

    Only documents whose id is in a bit filter of the leaky ones are shuffled for the exact join.
    """
    found = _matches(docs, _tokens(items, item_id_col, item_text_col), id_col, text_col).select(F.col("doc_id").alias("_leaky"))
    found = written(found.distinct(), "leaky")
    own, words = F.col(f"`{id_col}`"), filter_words(found.count(), LEAKY_WORDS)
    maybe = bit_test(bit_filter(found.select(F.xxhash64("_leaky").alias("h")), "h", words), F.xxhash64(own), words)
    return docs.filter(~maybe).unionAll(docs.filter(maybe).join(found, own.eqNullSafe(F.col("_leaky")), "left_anti"))
