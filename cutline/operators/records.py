"""X21-X24, P8, K-report rows: result records to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.expr import blank_to_null, strip, text
from ..functions.standards import extraction_has_requirements, format_requirement
from ..functions.text import context_groups, first_url, other_text
from ..functions.urls import low_quality
from .evaluate import any_of_groups, inherit, inherit_export, merge_groups
from .filters import found
from .ordering import unresolved_order

NO_TIER = "非双一流"
ALL_LABEL = "全部"
EMPTY = "array<string>"


def evaluation_rows(results: DataFrame) -> DataFrame:
    """One row per department of every found record, one "all" row when it has none."""
    ext = F.col("extraction")
    base = results.filter(found("status", ext["found"])).select(
        "school_id",
        text("school_name").alias("school_name"),
        text("area").alias("area"),
        F.coalesce(blank_to_null("tier"), F.lit(NO_TIER)).alias("tier"),
        F.coalesce("taiwan_recognized", F.lit(False)).alias("taiwan_recognized"),
        first_url("source_url").alias("source_url"),
        ext["confidence"].alias("confidence"),
        ext["application_deadline"].alias("application_deadline"),
        F.coalesce(ext["majors"], F.array().cast(EMPTY)).alias("school_list"),
        ext["notes"].alias("notes"),
        ext["other_conditions"].alias("conditions"),
        ext["general_requirements"].alias("_gen"),
        F.posexplode_outer(ext["department_requirements"]).alias("_idx", "_d"),
    )
    step = base.withColumn("idx", F.coalesce("_idx", F.lit(0))).withColumn("reqs", inherit(F.col("_gen"), F.col("_d.subjects")))
    context = F.concat_ws(" ", blank_to_null("notes"), F.array_join("conditions", " "), blank_to_null(F.col("_d.notes")))
    step = step.withColumn("_ctx", context)
    return step.select(
        "school_id",
        "school_name",
        "area",
        "tier",
        "taiwan_recognized",
        "source_url",
        "confidence",
        "application_deadline",
        "school_list",
        "notes",
        "conditions",
        "idx",
        F.concat_ws("__", "school_id", F.col("idx").cast("string")).alias("row_key"),
        F.coalesce(blank_to_null(F.col("_d.department")), F.lit(ALL_LABEL)).alias("label"),
        text("_d.notes").alias("row_notes"),
        F.coalesce(F.col("_d.majors"), F.array().cast(EMPTY)).alias("row_list"),
        "reqs",
        merge_groups(context_groups("_ctx"), any_of_groups(F.col("reqs"))).alias("choice_groups"),
        other_text("conditions", F.col("_d.notes"), F.col("idx") == 0).alias("other_text"),
    )


def export_record(results: DataFrame) -> DataFrame:
    """Eleven columns of every found record; the state is not tested."""
    ext = F.col("extraction")
    return results.filter(found(None, ext["found"])).select(
        "school_name",
        text("area").alias("area"),
        text("type").alias("type"),
        text("tier").alias("tier"),
        F.coalesce("taiwan_recognized", F.lit(False)).alias("taiwan_recognized"),
        ext["general_requirements"].alias("general_requirements"),
        ext["department_requirements"].alias("department_requirements"),
        ext["other_conditions"].alias("other_conditions"),
        ext["application_deadline"].alias("application_deadline"),
        ext["confidence"].alias("confidence"),
        "source_url",
    )


def export_rows(export: DataFrame) -> DataFrame:
    """Flat text rows of the export, with export inheritance (Q9)."""
    rows = export.select("*", F.posexplode_outer("department_requirements").alias("_idx", "_d"))
    reqs = inherit_export(F.col("general_requirements"), F.col("_d.subjects"))
    rows = rows.withColumn("_r", reqs)
    conds = F.filter(F.coalesce("other_conditions", F.array().cast(EMPTY)), lambda x: x.isNotNull() & (x != ""))
    own = F.when(text("_d.notes") != "", F.array(F.col("_d.notes"))).otherwise(F.array().cast(EMPTY))
    return rows.select(
        "school_name",
        "area",
        F.coalesce(blank_to_null("tier"), F.lit(NO_TIER)).alias("tier"),
        F.when(F.col("taiwan_recognized"), F.lit("是")).otherwise(F.lit("否")).alias("recognised"),
        F.coalesce(blank_to_null(F.col("_d.department")), F.lit(ALL_LABEL)).alias("label"),
        *[F.coalesce(format_requirement(F.col("_r")[k]), F.lit("-")).alias(k) for k in V.SUBJECT_KEYS],
        F.array_join(F.concat(own, conds), "; ").alias("other_conditions"),
        text("application_deadline").alias("deadline"),
        text("confidence").alias("confidence"),
        text("source_url").alias("source_url"),
    )


def detail_rows(results: DataFrame) -> DataFrame:
    """X22, listing form: first two conditions on the first row only, and its row span."""
    ext = F.col("extraction")
    rows = results.filter(found("status", ext["found"])).select(
        "school_id",
        "school_name",
        F.coalesce(blank_to_null("tier"), F.lit(NO_TIER)).alias("tier"),
        ext["general_requirements"].alias("_gen"),
        F.coalesce(ext["other_conditions"], F.array().cast(EMPTY)).alias("_conds"),
        F.greatest(F.size(F.coalesce(ext["department_requirements"], F.array())), F.lit(1)).alias("_n"),
        F.posexplode_outer(ext["department_requirements"]).alias("_idx", "_d"),
    )
    first = F.coalesce("_idx", F.lit(0)) == 0
    rows = rows.withColumn("_r", inherit_export(F.col("_gen"), F.col("_d.subjects")))
    own = F.when(text("_d.notes") != "", F.array(F.col("_d.notes"))).otherwise(F.array().cast(EMPTY))
    shown = F.filter(F.slice("_conds", 1, 2), lambda x: x.isNotNull() & (x != ""))
    return rows.select(
        "school_id",
        "school_name",
        "tier",
        F.coalesce("_idx", F.lit(0)).alias("idx"),
        F.coalesce(blank_to_null(F.col("_d.department")), F.lit(ALL_LABEL)).alias("label"),
        *[F.coalesce(format_requirement(F.col("_r")[k]), F.lit("-")).alias(k) for k in V.SUBJECT_KEYS],
        F.when(first, F.array_join(F.concat(shown, own), "; ")).otherwise(text("_d.notes")).alias("other_conditions"),
        F.when(first, F.col("_n")).otherwise(0).alias("row_span"),
    )


def recategorise(results: DataFrame, pattern: str = V.SHORT_FAILURE_PATTERN, reason: str = V.SHORT_FAILURE_NOTE) -> DataFrame:
    """Failures for lack of content become not_found, with a note; ``changed`` marks them."""
    ext = F.col("extraction")
    err = F.coalesce(blank_to_null(ext["error"]), blank_to_null("error"), F.lit(""))
    hit = (F.col("status") == "failed") & err.rlike(pattern)
    notes = strip(text(ext["notes"]))
    new_notes = F.when(notes == "", F.lit(reason)).otherwise(F.concat(notes, F.lit(" " + reason)))
    fixed = (
        ext.withField("found", F.lit(False)).withField("error", F.lit(None).cast("string")).withField("notes", new_notes)
    )
    return (
        results.withColumn("changed", F.coalesce(hit, F.lit(False)))
        .withColumn("extraction", F.when(F.col("changed"), fixed).otherwise(ext))
        .withColumn("status", F.when(F.col("changed"), F.lit("not_found")).otherwise(F.col("status")))
        .withColumn("error", F.when(~F.col("changed"), F.col("error")))
    )


def unresolved_rows(results: DataFrame, schools: DataFrame) -> DataFrame:
    """Failed and not-found records with names and host quality, in report order."""
    names = schools.select(F.col("id").alias("school_id"), F.col("name").alias("_name"))
    ext = F.col("extraction")
    rows = results.filter(F.col("status").isin("failed", "not_found")).join(names, "school_id", "left")
    return rows.select(
        "school_id",
        F.coalesce(blank_to_null("school_name"), "_name", F.lit("")).alias("school_name"),
        "status",
        text("source").alias("source"),
        text("source_url").alias("source_url"),
        F.coalesce("raw_text_length", F.lit(0)).alias("raw_text_length"),
        F.coalesce(blank_to_null(ext["error"]), blank_to_null("error"), F.lit("")).alias("error"),
        text(ext["notes"]).alias("notes"),
        F.when(low_quality("source_url"), F.lit("yes")).otherwise(F.lit("no")).alias("low_quality_host"),
    ).orderBy(*unresolved_order())


def follow_up_rows(results: DataFrame, schools: DataFrame) -> DataFrame:
    """Found records without any subject requirement."""
    names = schools.select(F.col("id").alias("school_id"), F.col("name").alias("_name"))
    ext = F.col("extraction")
    rows = results.filter(found("status", ext["found"]) & ~F.coalesce(extraction_has_requirements(ext), F.lit(False)))
    return rows.join(names, "school_id", "left").select(
        "school_id",
        F.coalesce(blank_to_null("school_name"), "_name", F.lit("")).alias("school_name"),
        text("source_url").alias("source_url"),
        "related_links",
        "image_links",
        text(ext["notes"]).alias("notes"),
        text(ext["confidence"]).alias("confidence"),
    )


def canonical_json(col: Column | str) -> Column:
    """A10: JSON text with a fixed field order, to compare records."""
    return F.to_json(F.col(col) if isinstance(col, str) else col)
