"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

BIT_WORDS = 1 << 16
"""64-bit words of a membership filter: its size is fixed, whatever the data."""


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns that an operator is about to add, matching names as Spark does."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null"))) % parts


def once(column: Column) -> Column:
    """A generator of one row: later steps read its output instead of repeating ``column``."""
    return F.explode(F.array(column))


def filter_words(n: int, most: int) -> int:
    """Words of a filter for ``n`` values: sixteen bits a value, a power of two from 1,024 to ``most``.

    The driver ships a filter with every stage that tests it, several copies at once.
    """
    return min(most, 1 << max(10, (n // 4).bit_length()))


def _word_and_bits(value: Column, words: int) -> tuple[Column, Column]:
    """The word that a 64-bit hash falls in, and its three bits there."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(value, k).bitwiseAND(63).cast("int")) for k in (20, 26, 32)]
    return F.shiftrightunsigned(value, 40).bitwiseAND(words - 1).cast("int"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def bit_filter(hashes: DataFrame, column: str, words: int = BIT_WORDS) -> Column:
    """Bits of a set of 64-bit hashes, as a scalar subquery for ``bit_test``.

    The set is folded into ``words`` 64-bit words by an aggregate, so what reaches the other
    side is one row of fixed size, however large the set; ``words`` is a power of two.
    """
    word, bits = _word_and_bits(F.col(column), words)
    folded = hashes.filter(F.col(column).isNotNull()).select(word.alias("w"), bits.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    every = hashes.sparkSession.range(0, words, 1, 1).select(F.col("id").cast("int").alias("w")).join(folded, "w", "left")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))).alias("l"))
    return listed.select(F.transform("l", lambda x: x["b"]).alias("bits")).scalar()


def bit_test(bits: Column, value: Column, words: int = BIT_WORDS) -> Column:
    """False only for values that are not in the filter's set; an exact join must follow."""
    word, mask = _word_and_bits(value, words)
    return F.get(bits, word).bitwiseAND(mask) == mask


CHUNK = 1 << 12


def bit_table(hashes: DataFrame, column: str, words: int) -> DataFrame:
    """The bits of ``bit_filter`` as rows (chunk, bits) of ``CHUNK`` words, for sets whose filter is too large for a plan."""
    word, bits = _word_and_bits(F.col(column), words)
    folded = hashes.filter(F.col(column).isNotNull()).select(word.alias("w"), bits.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    every = hashes.sparkSession.range(0, words).select(F.col("id").cast("int").alias("w")).join(folded, "w", "left")
    chunks = every.groupBy(F.floor(F.col("w") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))).alias("l"))
    return written(chunks.select("chunk", F.transform("l", lambda x: x["b"]).alias("bits")), "bits")


def maybe_in(rows: DataFrame, table: DataFrame, column: str, words: int) -> DataFrame:
    """``rows`` with the filter's columns, without those whose value is not in its set; an exact join must follow.

    The table is sent to every executor, 8 bytes a word.
    """
    word, mask = _word_and_bits(F.col(column), words)
    tested = rows.join(F.broadcast(table), F.shiftright(word, CHUNK.bit_length() - 1).cast("bigint") == F.col("chunk"))
    return tested.filter(F.get("bits", word.bitwiseAND(CHUNK - 1)).bitwiseAND(mask) == mask)
