"""Major lists from text, labels and records.

One document is one cell: its lists are read inside its row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.expr import c, contains_any, let, strip, text
from ..functions.text import (
    clean_majors,
    display_key,
    display_label_majors,
    han_count,
    is_display_major,
    is_major,
    label_majors,
    merge_lists,
    normalise_major,
    split_tokens,
)

HEADING = r"^(?:[一二三四五六七八九十]+|[0-9]{1,2})[、.．)]|^[（(](?:[一二三四五六七八九十]+|[0-9]{1,2})[）)]"
SENTENCE = r"招生专业(?:及计划|及招生计划|目录)?\s*[:：]\s*([^。\n]{2,200})"


MARK = "\x01"
"""Parts the tokens of a text; a text's own U+0001 counts as a space."""


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that later steps read: the output of a generator is not computed again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _spans(hints: Column, n: Column, chars: Column, span: int, slack: int, short: int) -> Column:
    """W6 on hint lines: array of (start, end). Texts without a hint are read from the start when short."""

    def end(at: Column) -> Column:
        return F.least(at + span, n)

    last = F.size(hints) - 1
    starts = F.filter(hints, lambda at, i: (i == 0) | (at > end(F.get(hints, i - 1)) + slack))
    ends = F.filter(hints, lambda at, i: (i == last) | (F.get(hints, i + 1) > end(at) + slack))
    found = F.transform(starts, lambda at, i: F.struct(at.alias("start"), end(F.get(ends, i)).alias("end")))
    head = F.array(F.struct(F.lit(0).alias("start"), F.least(F.lit(span), n).alias("end")))
    return F.when(last >= 0, found).when(chars < short, head).otherwise(F.slice(head, 1, 0))


def majors_from_text(
    df: DataFrame,
    key: str,
    value: str,
    out: str = "majors",
    limit: int = 400,
    hints: Sequence[str] = tuple(V.LIST_HINTS),
    stops: Sequence[str] = tuple(V.LIST_STOPS),
    headers: Sequence[str] = tuple(V.TABLE_HEADERS),
    heading: str = HEADING,
    number_token: str = r"^[0-9]+$|[一二三四五六七八九十]年制|[0-9]+年制",
    sentence: str | None = SENTENCE,
    tokens: Callable[[Column], Column] = split_tokens,
    normalise: Callable[[Column], Column] = normalise_major,
    plausible: Callable[[Column], Column] = is_major,
    fragment: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per text with its ordered unique major list (texts without one give no row).

    A text is read inside its row: no line or token becomes a row of its own, so nothing is
    shuffled. The tokens of a span of lines are written one after another, each behind a mark and
    its kind (a name, a fragment, a break), and one pattern reads names and runs of two to six
    fragments from left to right, which is linear in the text.
    """
    fragment = fragment or (
        lambda s: (F.length(s) == 2) & (han_count(s) == 2) & ~contains_any(s, V.FRAGMENT_STOPS)
    )

    def line_of(line: Column) -> Column:
        toks = F.transform(tokens(line), lambda t: F.struct(t.rlike(number_token).alias("num"), normalise(t).alias("name")))
        stop = contains_any(line, stops) & line.rlike(heading)
        return F.struct(contains_any(line, headers).alias("header"), stop.alias("stop"), toks.alias("toks"))

    def marked(line: Column) -> Column:
        def token(t: Column) -> Column:
            kind = F.when(t["num"], "B").when(plausible(t["name"]), "N").when(fragment(t["name"]), "F").otherwise("B")
            return F.concat(F.lit(MARK), kind, t["name"])

        return F.when(line["header"], F.lit(MARK + "B")).otherwise(F.array_join(F.transform(line["toks"], token), ""))

    def before_stop(lines: Column) -> Column:
        """Lines up to the first stop line after a line with content."""
        content = F.array_position(F.transform(lines, lambda x: x["header"] | F.exists(x["toks"], lambda t: ~t["num"])), True)

        def cut(hit: Column) -> Column:
            stop = F.array_position(F.transform(lines, lambda x, i: (hit > 0) & (i + 1 > hit) & x["stop"]), True)
            return F.when(stop > 0, F.slice(lines, F.lit(1), stop.cast("int") - 1)).otherwise(lines)

        return let(content, cut)

    def read(lines: Column) -> Column:
        """The marked tokens of one span; nothing runs on from one span into the next."""
        return F.concat(F.array_join(F.transform(let(lines, before_stop), marked), ""), F.lit(MARK + "B"))

    def name_of(found: Column) -> Column:
        run = normalise(F.replace(found, F.lit(MARK + "F"), F.lit("")))
        return F.when(found.startswith(MARK + "N"), F.substring(found, 3, 1 << 30)).otherwise(let(run, lambda x: F.when(plausible(x), x)))

    docs = df.select(key, F.length(text(value)).alias("_chars"), text(value).alias("_text"))
    docs = _bound(docs, "_lines", F.filter(F.transform(F.split(F.translate(F.replace("_text", F.lit("\r\n"), F.lit("\n")), MARK, " "), "\n"), strip), lambda x: x != ""))
    docs = _bound(docs, "_hints", F.array_compact(F.transform("_lines", lambda x, i: F.when(contains_any(x, hints), i))))
    docs = _bound(docs, "_spans", _spans(F.col("_hints"), F.size("_lines"), F.col("_chars"), 220, 10, 1500))
    inside = F.transform("_spans", lambda s: read(F.transform(F.slice("_lines", s["start"] + 1, s["end"] - s["start"]), line_of)))
    docs = _bound(docs, "_marked", F.array_join(inside, ""))
    runs = F.regexp_extract_all("_marked", F.lit(f"{MARK}N[^{MARK}]*|(?:{MARK}F[^{MARK}]*){{2,6}}"), F.lit(0))
    names = F.array_compact(F.transform(runs, name_of))
    if sentence:
        chunks = F.slice(F.regexp_extract_all("_text", F.lit(sentence), F.lit(1)), 1, 20)
        hinted = contains_any("_text", hints) | (F.col("_chars") < 1500)
        extra = F.filter(F.transform(F.flatten(F.transform(chunks, tokens)), normalise), plausible)
        names = F.concat(names, F.when(hinted, extra).otherwise(F.array().cast("array<string>")))
    docs = _bound(docs, out, F.slice(F.array_distinct(names), 1, limit))
    return docs.filter(F.size(out) > 0).select(key, out)


def row_majors(row: Column | str, label: Column | str, school: Column | str) -> Column:
    """The row's own majors, else from its label, else the institution's."""

    def useful(values: Column | str) -> Column:
        items = F.coalesce(c(values), F.array().cast("array<string>"))
        return F.array_distinct(F.filter(F.transform(items, display_key), is_display_major))

    own, named = useful(row), display_label_majors(label)
    return F.when(F.size(own) > 0, own).when(F.size(named) > 0, named).otherwise(useful(school))


def school_majors(df: DataFrame, school: str, school_list: str, row_list: str) -> DataFrame:
    """Distinct majors per institution, its own first. Values are folded before they are collected."""
    own = F.transform(
        F.filter(
            F.transform(F.coalesce(F.col(school_list), F.array().cast("array<string>")), display_key), is_display_major
        ),
        lambda v: F.struct(F.lit(0).alias("k"), v.alias("v")),
    )
    rows = F.transform(F.col(row_list), lambda v: F.struct(F.lit(1).alias("k"), v.alias("v")))
    exploded = df.select(school, F.explode(F.concat(own, rows)).alias("e")).select(school, "e.k", "e.v")
    firsts = exploded.groupBy(school, "v").agg(F.min("k").alias("k"))
    items = F.sort_array(F.collect_list(F.struct("k", "v")))
    return firsts.groupBy(school).agg(F.transform(items, lambda x: x["v"]).alias("school_majors"))


def attach_majors(df: DataFrame, extraction: str, majors: str) -> DataFrame:
    """X11: text majors on the record; department majors from the label where none are given."""
    e = F.col(extraction)
    e = F.when(F.size(majors) > 0, e.withField("majors", F.col(majors))).otherwise(e)

    def patched(d: Column) -> Column:
        derived = label_majors(d["department"])
        keep = F.coalesce(F.size(d["majors"]), F.lit(0)) > 0
        return d.withField("majors", F.when(keep | (F.size(derived) == 0), d["majors"]).otherwise(derived))

    step = df.withColumn(extraction, e)
    e = F.col(extraction)
    return step.withColumn(
        extraction, e.withField("department_requirements", F.transform(e["department_requirements"], patched))
    )


def backfill_majors(before: Column | str, new: Column | str, replace: bool) -> Column:
    """Merge new majors in, or replace with the cleaned old list as fallback."""
    if not replace:
        merged = merge_lists(before, new, 800)
        return F.when(F.size(merged) > 0, merged).otherwise(c(before))
    fresh = merge_lists(new, F.array().cast("array<string>"), 800)
    old = clean_majors(before)
    return F.when(F.size(fresh) > 0, fresh).when(F.size(old) > 0, old)
