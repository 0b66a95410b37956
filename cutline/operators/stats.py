"""Counts, cutoffs, ranks and report aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import c, let
from .scans import global_rank, top_per_key


def count_by(df: DataFrame, col: str, categories: Iterable[str], name: str = "n") -> DataFrame:
    """Rows per fixed category, zero where none; one pass, one row per category."""
    categories = list(categories)
    counts = df.agg(*[F.count_if(F.col(col) == k).alias(f"c{i}") for i, k in enumerate(categories)])
    pairs = F.array(*[F.struct(F.lit(k).alias(col), F.col(f"c{i}").alias(name)) for i, k in enumerate(categories)])
    return counts.select(F.inline(pairs))


def match_totals(df: DataFrame, status: Column | str, active: bool = True) -> DataFrame:
    """A3: total, pass, unknown, fail; the last three are 0 without a profile."""
    s = c(status)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[
            (F.count_if(s == k) if active else F.lit(0).cast("bigint")).alias(f"stat_{k}")
            for k in ("pass", "unknown", "fail")
        ],
    )


def group_best(df: DataFrame, keys: Sequence[str], status: Column | str, fit: Column | str) -> DataFrame:
    """Smallest fit over passing rows, best status rank and row count per institution."""
    s = c(status)
    rank = F.when(s == "pass", 3).when(s == "unknown", 2).otherwise(1)
    return df.groupBy(*keys).agg(
        F.min(F.when(s == "pass", c(fit))).alias("best_fit"),
        F.max(rank).alias("status_rank"),
        F.count(F.lit(1)).alias("row_span"),
    )


def cutoff_stats(df: DataFrame, keys: Sequence[str], year: str, cutoff: str, years: Sequence[int] | None = None) -> DataFrame:
    """A5: median, maximum, count and per-year map of the yearly cutoffs (one row per year)."""
    rows = df.filter(F.col(cutoff).isNotNull())
    if years is not None:
        rows = rows.filter(F.col(year).isin(list(years)))
    return rows.groupBy(*keys).agg(
        F.median(cutoff).alias("median_cutoff"),
        F.max(cutoff).alias("max_cutoff"),
        F.count(F.lit(1)).alias("n_years"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(year, cutoff)))).alias("by_year"),
    )


def sorted_median(values: Column) -> Column:
    """Median of a short array; nulls are skipped, an empty array gives null."""

    def middle(a: Column) -> Column:
        n = F.size(a)
        half = F.floor((n - 1) / 2).cast("int")
        return F.when(n > 0, (F.get(a, half) + F.get(a, F.floor(n / 2).cast("int"))) / 2)

    return let(F.array_sort(F.array_compact(values)), middle)


def cutoff_frame(df: DataFrame, keys: Sequence[str], year: Column | str, cutoff: Column, years: Sequence[int]) -> DataFrame:
    """A5 over a fixed set of years: ``cutoff`` is folded per year as conditional minima.

    One shuffle with map-side combine: the years are columns, not rows, until the
    aggregate is done.
    """
    y = c(year)
    named = {int(v): f"y{int(v)}" for v in years}
    per_year = df.groupBy(*keys).agg(*[F.round(F.min(F.when(y == v, cutoff)), 4).alias(n) for v, n in named.items()])
    values = F.array(*[F.col(n) for n in named.values()])
    return (
        per_year.withColumn("median_cutoff", sorted_median(values))
        .withColumn("max_cutoff", F.array_max(values))
        .withColumn("n_years", F.size(F.array_compact(values)).cast("bigint"))
        .filter(F.col("n_years") > 0)
    )


def selectivity(df: DataFrame, school: str, median: str = "median_cutoff", most: int = 10) -> DataFrame:
    """Median of the ``most`` smallest programme medians of each institution."""
    top = top_per_key(df.filter(F.col(median).isNotNull()), [school], [F.col(median).asc()], most)
    return top.groupBy(school).agg(F.median(median).alias("score"))


def school_rank(df: DataFrame, school: str, median: str = "median_cutoff") -> DataFrame:
    """W9 over A6: sequential rank, ties by name (Q19)."""
    return global_rank(selectivity(df, school, median), [F.col("score").asc(), F.col(school).asc()], "school_rank")


def change_report(df: DataFrame, before: Column, after: Column, token: str) -> DataFrame:
    """A10: changed records, and records in which ``token`` appeared. Pass canonical JSON texts."""
    changed = ~before.eqNullSafe(after)
    appeared = changed & after.contains(token) & ~before.contains(token)
    return df.agg(
        F.count_if(changed).alias("changed"), F.count_if(F.coalesce(appeared, F.lit(False))).alias("appeared")
    )


def source_summary(df: DataFrame, keys: Sequence[str], is_row: Column, is_error: Column) -> DataFrame:
    """Rows, errors and state per source: success, empty or failed."""
    n, errors = F.count_if(is_row), F.count_if(is_error)
    out = df.groupBy(*keys).agg(n.alias("row_count"), errors.alias("error_count"))
    return out.withColumn(
        "status",
        F.when(F.col("row_count") > 0, F.lit("success")).when(F.col("error_count") > 0, F.lit("failed")).otherwise(F.lit("empty")),
    )


def size_report(df: DataFrame, before: Column, after: Column, error: Column) -> DataFrame:
    """Processed, updated, present and error counts of a list backfill."""
    ok = ~error
    return df.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(ok & (after > before)).alias("updated"),
        F.count_if(ok & (after > 0)).alias("present_after"),
        F.count_if(error).alias("errors"),
    )


def facet(df: DataFrame, value: Column | str, name: str = "value") -> DataFrame:
    """Distinct non-empty values."""
    return df.select(c(value).alias(name)).filter(F.col(name).isNotNull() & (F.col(name) != "")).distinct()


def opportunity_meta(df: DataFrame, keys: Sequence[str], kind: str, status: str, fit: str, gap: str) -> DataFrame:
    """Best score, smallest gap and which kinds an institution has."""
    transfer, near = F.col(kind) == "transfer", F.col(kind) == "nearmiss"
    t_score = (
        F.when(F.col(status) == "pass", F.coalesce(F.col(fit), F.lit(0)))
        .when(F.col(status) == "unknown", 500)
        .otherwise(5000)
    )
    gap_value = F.coalesce(F.col(gap), F.lit(99))
    score = F.when(transfer, t_score).when(near, gap_value * 100 + 10000)
    return df.groupBy(*keys).agg(
        F.coalesce(F.min(score.cast("double")), F.lit(9e15)).alias("score"),
        F.min(F.when(near, gap_value)).alias("best_gap"),
        F.coalesce(F.bool_or(transfer), F.lit(False)).alias("has_transfer"),
        F.coalesce(F.bool_or(near), F.lit(False)).alias("has_nearmiss"),
    )


def first_group_wins(df: DataFrame, key: str, group_order: str) -> DataFrame:
    """One row per programme, from the first group that lists it (Q11)."""
    return top_per_key(df, [key], [F.col(group_order).asc()], 1)


def kind_counts(df: DataFrame, school: str, kind: str) -> DataFrame:
    """Institutions with a transfer and with a near-miss row.

    Distinct (institution, kind) first, so the count is an ordinary two-phase sum.
    """
    pairs = df.select(school, kind).distinct()
    return pairs.agg(
        F.count_if(F.col(kind) == "transfer").alias("transfer_schools"),
        F.count_if(F.col(kind) == "nearmiss").alias("nearmiss_schools"),
    )


def row_span(df: DataFrame, key: str) -> DataFrame:
    """Rows per key on every row, by aggregate and join so a hot key is not one window."""
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("row_span")), key)


def first_row_flag(pos: Column | str) -> Column:
    """W10."""
    return c(pos) == 0


