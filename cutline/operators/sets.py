"""Set operations over rows and over list columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import c
from .dedupe import first_occurrences


def nested_set(base: DataFrame, more: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Union of name sets minus the removed names."""
    out = base.union(more).distinct()
    return out.exceptAll(removed) if removed is not None else out


def merge_years(first: Column | str, second: Column | str) -> Column:
    """Sorted distinct years; entries that are not all digits go."""
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(c(first), empty), F.coalesce(c(second), empty))
    digits = F.filter(F.transform(both, lambda y: F.trim(y)), lambda y: y.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(digits, lambda y: y.try_cast("int")))))


def append_sources(frames: list[DataFrame]) -> DataFrame:
    """U4."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def missing_selected(selected: Column, available: Column | str) -> Column:
    """Selected values that are not available, in order."""
    return F.array_except(selected, c(available))


def any_selected(selected: Column, values: Column | str) -> Column:
    """U6."""
    return F.arrays_overlap(selected, c(values))


def major_filter(
    df: DataFrame, school: str, row_majors: str, school_majors: str | None, selected: list[str]
) -> DataFrame:
    """Rows that hit a selected major; where an institution hits but none of its rows
    does, all its rows stay with ``mapping_unknown``.

    The per-institution flags are an aggregate joined back, not a window, so a hot
    institution is pre-aggregated.
    """
    if not selected:
        return df.withColumn("mapping_unknown", F.lit(False))
    wanted = F.array(*[F.lit(s) for s in selected])
    hit = F.coalesce(F.arrays_overlap(F.col(row_majors), wanted), F.lit(False))
    school_hit = hit
    if school_majors:
        school_hit = hit | F.coalesce(F.arrays_overlap(F.col(school_majors), wanted), F.lit(False))
    flagged = df.withColumn("_hit", hit).withColumn("_school_hit", school_hit)
    flags = flagged.groupBy(school).agg(
        F.bool_or("_hit").alias("_any_row"), F.bool_or("_school_hit").alias("_any_school")
    ).filter("_any_school")
    return (
        flagged.join(flags, school)
        .filter(F.col("_hit") | ~F.col("_any_row"))
        .withColumn("mapping_unknown", ~F.col("_any_row"))
        .drop("_hit", "_school_hit", "_any_row", "_any_school")
    )


def union_by_url(df: DataFrame, keys: list[str], url: str, order: list[str]) -> DataFrame:
    """Attachments of several lists, each URL once per key at its first place."""
    return first_occurrences(df, keys, url, order)
