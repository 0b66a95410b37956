"""Small building blocks shared by all expression modules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by a Unicode-aware strip; Spark's trim removes only U+0020.
SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text(col: Column | str) -> Column:
    """Null-safe string."""
    return F.coalesce(c(col).cast("string"), F.lit(""))


def strip(col: Column | str) -> Column:
    return F.btrim(c(col), F.lit(SPACE))


def strip_chars(col: Column | str, chars: str) -> Column:
    return F.btrim(c(col), F.lit(chars))


def no_space(col: Column | str) -> Column:
    """Remove all whitespace, Unicode-aware."""
    return F.regexp_replace(c(col), r"(?U)\s+", "")


def parens(col: Column | str) -> Column:
    return F.translate(c(col), "（）", "()")


def blank_to_null(col: Column | str) -> Column:
    return F.nullif(c(col), F.lit(""))


def lookup(col: Column | str, mapping: Mapping[str, object], default: object = None) -> Column:
    """Value of a small fixed mapping, ``default`` when the key is absent."""
    pairs = []
    for key, value in mapping.items():
        pairs += [F.lit(key), F.lit(value)]
    found = F.element_at(F.create_map(*pairs), c(col))
    return found if default is None else F.coalesce(found, F.lit(default))


def alternation(words: Iterable[str]) -> str:
    """Regex that matches any of the words literally (Java and RE2 agree on it)."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


def contains_any(col: Column | str, words: Iterable[str]) -> Column:
    """True when the text holds any of the words. Few words: plain substring tests."""
    words = list(words)
    if not words:
        return F.lit(False)
    if len(words) > 12:
        return c(col).rlike(alternation(words))
    hit = c(col).contains(words[0])
    for word in words[1:]:
        hit = hit | c(col).contains(word)
    return hit


def count_words(col: Column | str, words: Iterable[str]) -> Column:
    """SF13: how many of the words occur, each counted at most once."""
    total = F.lit(0)
    for word in words:
        total = total + c(col).contains(word).cast("int")
    return total


def ends_with_any(col: Column | str, words: Iterable[str]) -> Column:
    return c(col).rlike("(?:" + alternation(words) + ")$")


def array_of(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def number_text(col: Column) -> Column:
    """Shortest text of a number: no decimal point for whole numbers."""
    return F.when(col == F.floor(col), col.cast("bigint").cast("string")).otherwise(col.cast("string"))


def number(value: Column) -> Column:
    """Decimal text to double, anything else to null. A plain cast would also take Java
    forms such as ``1d`` and ``nan``."""
    return F.when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value.try_cast("double"))


def js_number(col: Column | str) -> Column:
    """Text to number where blank or missing counts as 0 and junk is null (Q5, Q6)."""
    value = strip(text(col))
    return F.when(value == "", F.lit(0.0)).otherwise(number(value))


def first_group(col: Column, patterns: Iterable[str], group: int = 1) -> Column:
    """SF33: first pattern that matches wins; null when none does."""
    return F.coalesce(*[blank_to_null(F.regexp_extract(col, p, group)) for p in patterns])


def let(value: Column, fn) -> Column:
    """Bind a costly expression to a name once: ``fn`` may use its argument many times
    without the plan repeating the expression."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))
