"""Keyword groups as a table, found in any number of values without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import strip
from .matching import MAX_BROADCAST_ALIASES, MAX_BROADCAST_CHARS, contains_join

# Letters whose lower case is, or begins with, an ASCII letter.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZKİ"
LOWER = "abcdefghijklmnopqrstuvwxyzki"


def _folded(value: Column) -> Column:
    """One character for one character, so that whatever occurs in a text occurs in its folded form."""
    return F.translate(value, UPPER, LOWER)


def keyword_in(value: Column, keyword: Column) -> Column:
    """E14 with the keyword as a column: ASCII keywords match without case, others exactly."""
    plain = keyword.rlike(r"^[A-Za-z0-9+_.-]+$")
    return F.when(plain, F.lower(value).contains(F.lower(keyword))).otherwise(value.contains(keyword))


def keyword_table(groups: DataFrame) -> DataFrame:
    """Distinct (group_name, keyword) rows with blanks around keywords, empty and missing ones removed."""
    clean = groups.select("group_name", strip(F.col("keyword")).alias("keyword"))
    return clean.filter((F.col("keyword") != "") & F.col("group_name").isNotNull()).distinct()


def group_hits(
    values: DataFrame,
    key: str,
    value: str,
    precedence: str,
    groups: DataFrame,
    max_aliases: int = MAX_BROADCAST_ALIASES,
    max_chars: int = MAX_BROADCAST_CHARS,
) -> DataFrame:
    """(key, group_name, precedence) for the groups of which a keyword occurs in a value of the key.

    ``values`` has any number of rows per key, such as its majors (precedence 1) and its labels (2); a group found in
    several takes the smallest precedence, a null one only if there is no other. Values are searched where they lie and
    are not shuffled. Keywords beyond the bounds are found by their rarest gram and then tested on the place where they
    stand (see ``contains_join``). Null values, blank keywords and empty tables give no rows.
    """
    words = keyword_table(groups)
    held = values.select(F.struct(F.col(key).alias("k"), F.col(precedence).alias("p")).alias("_id"), F.col(value).alias("_value"))
    held = held.filter("_value <> ''").select("_id", "_value", _folded(F.col("_value")).alias("_text"))
    aliases = words.select("keyword", _folded(F.col("keyword")).alias("_word")).distinct()
    found = contains_join(held, "_id", "_text", aliases, "keyword", "_word", max_aliases, max_chars, "_value", keyword_in)
    of_key = found.join(words, "keyword").groupBy(F.col("_id.k").alias(key), "group_name")
    return of_key.agg(F.min("_id.p").alias(precedence))


def targets(df: DataFrame, key: str, hits: DataFrame, precedence: str, selected: list[str] | None = None, out: str = "target") -> DataFrame:
    """Rows with the group of smallest precedence (ties: the first name), null when none of the selected hits."""
    chosen = hits if selected is None else hits.filter(F.col("group_name").isin(selected))
    rank = F.struct(F.col(precedence).isNull().alias("none"), F.col(precedence).alias("p"), F.col("group_name").alias("g"))
    best = chosen.groupBy(F.col(key).alias("_hit")).agg(F.min(rank)["g"].alias(out))
    return df.join(best, F.col(key) == F.col("_hit"), "left").drop("_hit")
