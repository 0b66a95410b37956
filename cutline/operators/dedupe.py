"""Keep-best and first-occurrence operators.

Winner selection is a top-1 per key, which Spark limits before the shuffle; list
unions are min-position aggregates, so copies are folded map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.expr import c, contains_any, let, strip, text
from ..functions.standards import confidence_rank, extraction_has_requirements, status_rank
from ..functions.urls import is_edu, is_gov, netloc
from .scans import top_per_key


def source_quality(source: Column | str, url: Column | str, length: Column | str) -> Column:
    """SF14."""
    src, n = F.lower(text(source)), F.coalesce(c(length), F.lit(0))

    def host_points(host: Column) -> Column:
        return (
            F.when(is_edu(host), 120).otherwise(0)
            + F.when(is_gov(host), 80).otherwise(0)
            + F.when(contains_any(host, V.ADMISSION_HOST_WORDS), 60).otherwise(0)
            + F.when(contains_any(host, V.LOW_QUALITY_HOSTS), -220).otherwise(0)
        )

    source_points = F.when(src == "official", 150).when(src == "search", 20).otherwise(0)
    return (source_points + let(netloc(url), host_points) + F.least(F.floor(n / 200), F.lit(60))).cast("int")


def best_order(
    status: Column | str,
    has_requirements: Column,
    confidence: Column | str,
    length: Column | str,
    quality: Column,
    arrival: Column | str,
) -> list[Column]:
    """W1 as a total order: status; then for successes requirements, confidence, length;
    for the rest source quality, length; the earliest wins full ties (Q1)."""
    success = text(status) == "success"
    n = F.coalesce(c(length), F.lit(0))
    return [
        status_rank(status).desc(),
        F.when(success, has_requirements.cast("int")).otherwise(quality).desc(),
        F.when(success, confidence_rank(confidence)).otherwise(0).desc(),
        n.desc(),
        c(arrival).asc(),
    ]


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order."""
    return top_per_key(df, keys, order, 1)


def result_order(arrival: str = "arrival") -> list[Column]:
    """W1 order over the result-record columns."""
    ext = F.col("extraction")
    return best_order(
        "status",
        F.coalesce(extraction_has_requirements(ext), F.lit(False)),
        ext["confidence"],
        "raw_text_length",
        source_quality("source", "source_url", "raw_text_length"),
        arrival,
    )


def keep_best_results(df: DataFrame, key: str = "school_id", arrival: str = "arrival", cap: int = 600, dept_cap: int = 200) -> DataFrame:
    """W1 with J12 over result records: the best version per key, its major lists
    completed from the other versions, best version first.

    Only other versions that have an extraction give; a lone record stays untouched. The
    union of their lists is an aggregate of minimum positions per (key, value); the
    version's place in the order is part of the position, so no window spans a key.
    """
    from ..functions.text import merge_lists

    ranked = df.withColumn("_ord", F.struct(*_ascending(arrival)))
    best = keep_best(ranked, [key], [F.col("_ord").asc()])
    winners = best.select(key, F.col("_ord").alias("_win"))
    others = ranked.join(winners, key).filter((F.col("_ord") != F.col("_win")) & F.col("extraction").isNotNull())
    given = others.select(key).distinct().withColumn("_given", F.lit(True))
    general = (
        others.select(key, "_ord", F.posexplode(F.col("extraction.majors")).alias("_pos", "_val"))
        .withColumn("_val", strip("_val"))
        .filter("_val <> ''")
    )
    majors = first_occurrence_lists(general, [key], "_val", ["_ord", "_pos"], cap, "_majors")
    depts = others.select(
        key, "_ord", F.posexplode("extraction.department_requirements").alias("_dpos", "_d")
    ).select(key, "_ord", "_dpos", strip(text("_d.department")).alias("_label"), F.col("_d.majors").alias("_m"))
    firsts = depts.groupBy(key, "_ord", "_label").agg(F.min_by("_m", "_dpos").alias("_m")).filter("_label <> ''")
    dept_vals = (
        firsts.select(key, "_label", "_ord", F.posexplode("_m").alias("_pos", "_val"))
        .withColumn("_val", strip("_val"))
        .filter("_val <> ''")
    )
    donor = first_occurrence_lists(dept_vals, [key, "_label"], "_val", ["_ord", "_pos"], dept_cap, "_dm")
    # Labels per institution are few; the map is read only for the labels of the winner.
    wanted = best.select(key, F.explode("extraction.department_requirements").alias("_d")).select(
        key, strip(text("_d.department")).alias("_label")
    ).distinct()
    donor_map = (
        wanted.join(donor, [key, "_label"])
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("_label", "_dm"))).alias("_donors"))
    )

    def patched(d: Column) -> Column:
        extra = F.element_at(F.col("_donors"), strip(text(d["department"])))
        merged = merge_lists(d["majors"], extra, dept_cap)
        return d.withField("majors", F.when(extra.isNotNull() & (F.size(merged) > 0), merged).otherwise(d["majors"]))

    ext = F.col("extraction")
    merged = merge_lists(ext["majors"], F.col("_majors"), cap)
    ext = F.when(F.col("_given") & (F.size(merged) > 0), ext.withField("majors", merged)).otherwise(ext)
    return (
        best.join(given, key, "left")
        .join(majors, key, "left")
        .join(donor_map, key, "left")
        .withColumn("extraction", ext)
        .withColumn(
            "extraction",
            F.when(
                F.col("_donors").isNotNull(),
                F.col("extraction").withField(
                    "department_requirements", F.transform("extraction.department_requirements", patched)
                ),
            ).otherwise(F.col("extraction")),
        )
        .drop("_ord", "_given", "_majors", "_donors")
    )


def _ascending(arrival: str) -> list[Column]:
    """The W1 order as ascending values, to compare versions as one struct."""
    ext = F.col("extraction")
    success = text("status") == "success"
    n = F.coalesce(F.col("raw_text_length"), F.lit(0))
    has = F.coalesce(extraction_has_requirements(ext), F.lit(False)).cast("int")
    quality = source_quality("source", "source_url", "raw_text_length")
    return [
        (-status_rank("status")).alias("a"),
        (-F.when(success, has).otherwise(quality)).alias("b"),
        (-F.when(success, confidence_rank(ext["confidence"])).otherwise(0)).alias("c"),
        (-n).alias("d"),
        F.col(arrival).alias("e"),
    ]


def history_order(round1: str = "round1", round2: str = "round2", page: str = "page", pos: str = "pos") -> list[Column]:
    """Most filled values, then a filled first value, then page and position."""

    def filled(name: str) -> Column:
        return F.coalesce(F.size(F.filter(name, lambda v: v.isNotNull())), F.lit(0))

    has_first = F.coalesce(F.get(F.col(round1), F.lit(0)).isNotNull(), F.lit(False)).cast("int")
    return [
        (F.greatest(filled(round1), F.lit(0)) + F.greatest(filled(round2), F.lit(0))).desc(),
        has_first.desc(),
        F.col(page).asc(),
        F.col(pos).asc(),
    ]


def most_orders(orders: str = "min_orders", source: str = "source_no") -> list[Column]:
    """More orders win, the first source wins ties."""
    return [F.coalesce(F.size(orders), F.lit(-1)).desc(), F.col(source).asc()]


def first_occurrences(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Each value once per key, with its smallest position; folded map-side."""
    if len(order) == 1:  # a plain minimum is a hash aggregate; a struct needs a sort
        return df.groupBy(*keys, value).agg(F.min(order[0]).alias("_min")).select(
            *keys, value, F.struct(F.col("_min").alias("o0")).alias("_first")
        )
    names = [f"o{i}" for i in range(len(order))]
    position = F.struct(*[F.col(o).alias(n) for o, n in zip(order, names)])
    return df.groupBy(*keys, value).agg(F.min(position).alias("_first"))


def first_occurrence_lists(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], cap: int, out: str
) -> DataFrame:
    """Ordered unique list per key with its cap; the cap is applied before collecting."""
    firsts = first_occurrences(df, keys, value, order)
    capped = top_per_key(firsts, keys, [F.col("_first").asc(), F.col(value).asc()], cap)
    pairs = F.sort_array(F.collect_list(F.struct("_first", F.col(value).alias("v"))))
    return capped.groupBy(*keys).agg(F.transform(pairs, lambda x: x["v"]).alias(out))
