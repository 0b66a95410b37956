"""Key lookups. All are equi-joins; Spark picks broadcast by size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import blank_to_null, c, strip, text
from ..functions.text import merge_lists


def with_status(rows: DataFrame, results: DataFrame, key: str, status: str = "status", default: str = "pending") -> DataFrame:
    """Left lookup of the state, with a default for keys without a record."""
    return rows.join(results.select(key, status), key, "left").withColumn(
        status, F.coalesce(F.col(status), F.lit(default))
    )


def with_labels(results: DataFrame, schools: DataFrame, key: str, fallback: dict[str, Column]) -> DataFrame:
    """Labels of the institution; computed fallback when the key is unknown (Q16).

    ``fallback`` maps label columns to expressions over the result row.
    """
    defaults = {"tier_source": F.lit("fallback_local"), "taiwan_source": F.lit("fallback_local"), "taiwan_recognized": F.lit(False)}
    side = schools.select(key, *[F.col(x).alias(f"_s_{x}") for x in fallback], F.lit(True).alias("_known"))
    joined = results.drop(*fallback).join(side, key, "left")
    for name, expr in fallback.items():
        known = F.col(f"_s_{name}")
        if name in defaults:
            known = F.coalesce(known, defaults[name])
        joined = joined.withColumn(name, F.when(F.col("_known"), known).otherwise(expr))
    return joined.drop("_known", *[f"_s_{x}" for x in fallback])


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """J3."""
    return work.join(done.select(key), key, "left_anti")


def known_only(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """J4."""
    return rows.join(dimension.select(key), key, "left_semi")


def fill_from_catalog(rows: DataFrame, catalog: DataFrame, key: str, name: str, attach: dict[str, str]) -> DataFrame:
    """Blank names from the catalogue, and catalogue columns under new names."""
    side = catalog.select(key, F.col(name).alias("_cat_name"), *[F.col(s).alias(d) for s, d in attach.items()])
    joined = rows.join(side, key, "left")
    return joined.withColumn(
        name, F.when(strip(text(name)) != "", F.col(name)).otherwise(F.coalesce("_cat_name", F.col(name)))
    ).drop("_cat_name")


def compose_programs(
    catalog: DataFrame,
    star_details: DataFrame,
    apply_details: DataFrame,
    star_history: DataFrame,
    apply_history: DataFrame,
    years: Sequence[int],
) -> DataFrame:
    """One row per (programme, year) with current details, derived apply code and history.

    Stays long: the nested per-year document is only built at the sink (K8).
    """
    base = (
        catalog.select("program_code", "school_name", "program_name", F.col("group").alias("star_group"))
        .join(
            star_details.select(
                "program_code",
                F.col("school_name").alias("_ds"),
                F.col("program_name").alias("_dp"),
                "requirements",
                "tie_break_items",
            ),
            "program_code",
            "left",
        )
        .select(
            "program_code",
            F.col("program_code").substr(1, 3).alias("school_code"),
            "star_group",
            F.coalesce(blank_to_null("school_name"), blank_to_null("_ds"), F.lit("")).alias("school_name"),
            F.coalesce(blank_to_null("program_name"), blank_to_null("_dp"), F.lit("")).alias("program_name"),
            "requirements",
            "tie_break_items",
            F.concat("program_code", F.lit("2")).alias("apply_code"),
        )
        .join(apply_details.select(F.col("program_code").alias("apply_code"), "stage1"), "apply_code", "left")
    )
    framed = base.withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    return framed.join(star_history, ["program_code", "year"], "left").join(apply_history, ["apply_code", "year"], "left")


def overlay_years(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per (key, year) the new entry where there is one, else the old one."""
    fresh = new.select(*keys, F.struct(*columns).alias("_new"))
    kept = old.select(*keys, F.struct(*columns).alias("_old"))
    merged = kept.join(fresh, list(keys), "full_outer").withColumn("_e", F.coalesce("_new", "_old"))
    return merged.select(*keys, *[F.col(f"_e.{x}").alias(x) for x in columns])


def local_tier(df: DataFrame, reference: DataFrame, name: str, type_text: Column | str) -> DataFrame:
    """Tier by set precedence, type text as the last hint; adds ``local_tier``.

    ``reference`` is (name, set_name, precedence); a name in several sets takes the smallest.
    """
    best = reference.groupBy("name").agg(F.min_by("set_name", "precedence").alias("_tier"))
    return (
        df.join(best.withColumnRenamed("name", "_ref"), F.col(name) == F.col("_ref"), "left")
        .withColumn(
            "local_tier",
            F.coalesce(F.col("_tier"), F.when(text(type_text).contains("双一流"), F.lit("双一流")), F.lit("非双一流")),
        )
        .drop("_tier", "_ref")
    )


def member_flag(df: DataFrame, names: DataFrame, key: str, out: str) -> DataFrame:
    """True when the key is in the one-column set."""
    member = names.select(F.col(names.columns[0]).alias("_m")).distinct().withColumn("_yes", F.lit(True))
    return (
        df.join(member, F.col(key) == F.col("_m"), "left")
        .withColumn(out, F.coalesce("_yes", F.lit(False)))
        .drop("_m", "_yes")
    )


def live_labels(in_985: Column, in_211: Column, in_syl: Column, tier: Column, by_domain: Column, by_list: Column) -> dict[str, Column]:
    """Live sets override the local tier; value and source of both labels."""
    return {
        "tier": F.when(in_985, F.lit("985")).when(in_211, F.lit("211")).when(in_syl, F.lit("双一流")).otherwise(tier),
        "tier_source": F.when(in_985, F.lit("online_moe_985"))
        .when(in_211, F.lit("online_moe_211"))
        .when(in_syl, F.lit("online_moe_shuangyiliu"))
        .otherwise(F.lit("fallback_local")),
        "taiwan_recognized": by_domain | by_list,
        "taiwan_source": F.when(~by_domain & by_list, F.lit("fallback_local")).otherwise(F.lit("online_tw_moe_domain")),
    }


def donor_lists(rows: DataFrame, donors: DataFrame, key: str, label: str, pos: str, values: str, cap: int = 200) -> DataFrame:
    """List of each (key, label) row completed from the first donor with that label."""
    firsts = donors.select(key, strip(text(label)).alias("_label"), F.struct(F.col(pos).alias("p"), F.col(values).alias("v")).alias("_d"))
    firsts = firsts.filter("_label <> ''").groupBy(key, "_label").agg(F.min_by("_d.v", "_d.p").alias("_donor"))
    joined = rows.withColumn("_label", strip(text(label))).join(firsts, [key, "_label"], "left")
    merged = merge_lists(values, "_donor", cap)
    return joined.withColumn(
        values, F.when(F.col("_donor").isNotNull() & (F.size(merged) > 0), merged).otherwise(F.col(values))
    ).drop("_label", "_donor")


def name_or_lookup(rows: DataFrame, dimension: DataFrame, key: str, name: str, dim_name: str) -> DataFrame:
    """Own name, else the dimension's name, else empty."""
    side = dimension.select(key, F.col(dim_name).alias("_dim_name"))
    return (
        rows.join(side, key, "left")
        .withColumn(name, F.coalesce(blank_to_null(name), "_dim_name", F.lit("")))
        .drop("_dim_name")
    )


def zip_inner(first: Column | str, second: Column | str) -> Column:
    """Pairs by position, cut to the shorter list."""
    n = F.least(F.size(c(first)), F.size(c(second)))
    return F.arrays_zip(F.slice(c(first), F.lit(1), n).alias("a"), F.slice(c(second), F.lit(1), n).alias("b"))


def zip_left(first: Column | str, *others: Column | str) -> Column:
    """One entry per element of the first list; missing partners are null."""
    n = F.size(c(first))
    return F.arrays_zip(c(first), *[F.slice(c(o), F.lit(1), n) for o in others])


def candidate_rows(applications: DataFrame, profiles: DataFrame, rows: DataFrame, profile_key: str, row_key: str) -> DataFrame:
    """Candidates meet the rows they applied to, through an application table."""
    return applications.join(profiles, profile_key).join(rows, row_key)
