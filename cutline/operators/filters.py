"""Predicates and row selection. All return columns or filtered frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.expr import c, count_words, no_space, text
from ..functions.urls import low_quality


def all_of(*predicates: Column | None) -> Column:
    """Conjunction of the predicates that are set."""
    out = None
    for p in predicates:
        if p is not None:
            out = p if out is None else out & p
    return F.lit(True) if out is None else out


def equals_if(col: Column | str, value: object) -> Column | None:
    return None if value in (None, "") else c(col) == value


def in_if(col: Column | str, values: Iterable[object] | None) -> Column | None:
    """Membership; an empty set is no filter."""
    values = list(values or [])
    return c(col).isin(values) if values else None


def recognised_if(col: Column | str, setting: str | None) -> Column | None:
    flag = F.coalesce(c(col), F.lit(False))
    return {"yes": flag, "no": ~flag}.get(setting or "")


def search_if(query: str | None, *cols: Column | str) -> Column | None:
    """Case-insensitive substring over one text, or several joined with blanks."""
    q = (query or "").strip().lower()
    return F.lower(F.concat_ws(" ", *[text(x) for x in cols])).contains(q) if q else None


def search_any_if(query: str | None, name: Column | str, *lists: Column | str) -> Column | None:
    """The name or any element of the list columns holds the query."""
    q = (query or "").strip().lower()
    if not q:
        return None
    hit = F.lower(text(name)).contains(q)
    for values in lists:
        hit = hit | F.coalesce(F.exists(c(values), lambda x: F.lower(x).contains(q)), F.lit(False))
    return hit


def not_failed(df: DataFrame, status: str) -> DataFrame:
    """P5."""
    return df.filter(F.col(status) != "fail")


def bucket_filter(setting: str, bucket: Column | str = "bucket") -> Column:
    """P6."""
    b = c(bucket)
    if setting == "all":
        return b != "incomplete"
    if setting == "star_good":
        return b.isin("star_good", "oppty")
    if setting in V.BUCKETS:
        return b == setting
    return F.lit(True)


def found(status: Column | str | None, found_flag: Column | str) -> Column:
    """Success and found; the export passes no status."""
    ok = F.coalesce(c(found_flag), F.lit(False))
    return ok if status is None else (c(status) == "success") & ok


def work_list(df: DataFrame, status: str, statuses: Iterable[str], key: str, limit: int | None = None) -> DataFrame:
    """Rows in the given states, in key order, optionally the first ``limit``."""
    out = df.filter(F.col(status).isin(list(statuses))).orderBy(key)
    return out.limit(limit) if limit is not None else out


def backfill(status: Column | str, found_flag: Column | str, majors: Column | str, skip_existing: bool) -> Column:
    """P12."""
    ok = found(status, found_flag)
    empty = F.size(F.coalesce(c(majors), F.array().cast("array<string>"))) == 0
    return ok & empty if skip_existing else ok


def keep_row(status: Column | str, only_eligible: bool, include_unknown: bool, show_fail: bool) -> Column:
    """P13."""
    if not only_eligible:
        return F.lit(True)
    keep = ["pass"] + (["unknown"] if include_unknown else []) + (["fail"] if show_fail else [])
    return c(status).isin(keep)


def has_evidence(value: Column | str, words=tuple(V.SHORT_TEXT_SIGNALS), min_length: int = 30, min_hits: int = 2) -> Column:
    """Short text that still carries signals."""
    t = no_space(text(value))
    return (F.length(t) >= min_length) & (count_words(t, words) >= min_hits)


def keep_page(value: Column | str, min_length: int = 100, **kw) -> Column:
    """A page stays when long enough or when it carries signals."""
    return (F.length(text(value)) >= min_length) | has_evidence(value, **kw)


def coherent_source(
    same_org: Column, edu: Column, gov: Column, admission: Column, name_hit: Column, has_preferred: Column
) -> Column:
    """With a preferred organisation gov pages do not count on their own."""
    base = same_org | edu | admission | name_hit
    return F.when(has_preferred, base).otherwise(base | gov)


def active_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Columns in which some row has a value; one aggregate row reaches the driver."""
    columns = list(columns)
    row = df.agg(*[F.coalesce(F.max(F.col(x).isNotNull()), F.lit(False)).alias(x) for x in columns]).first()
    return [x for x in columns if row[x]]


def select_active(df: DataFrame, keep: Iterable[str], columns: Iterable[str]) -> DataFrame:
    return df.select(*keep, *active_columns(df, columns))


def science_side(track: Column | str, keyword_hit: Column) -> Column:
    """Science row or a row that hits a keyword."""
    return (c(track) == "science") | keyword_hit


def low_quality_rows(df: DataFrame, status: str, url: str) -> DataFrame:
    """P11 selection: unresolved rows on weak hosts."""
    return df.filter((F.col(status) == "not_found") & low_quality(url))


