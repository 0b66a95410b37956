"""K1-K8: result stores, tables, reports and keyed documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def write_store(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: a new version of the store with its update stamp; never the path being read."""
    results.withColumn("last_updated", F.current_timestamp()).write.mode("errorifexists").format(fmt).save(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], quote_all: bool = False, bom: bool = True) -> None:
    """K2/K3: fixed column order; quotes doubled. The BOM is put before the first header
    name, so every part file starts with it; values are quoted when ``quote_all``."""
    out = df.select(*columns)
    if bom:
        out = out.withColumnRenamed(columns[0], BOM + columns[0])
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", quote_all)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def write_fragments(df: DataFrame, path: str, partitions: Sequence[str] = ("year", "school_code")) -> None:
    """K4: only the partitions present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).json(path)


def write_history(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """K5: flat history rows and the per-source summary side by side."""
    rows.write.mode("overwrite").partitionBy("year").parquet(f"{path}/rows")
    summary.write.mode("overwrite").parquet(f"{path}/summary")


def report_row(df: DataFrame, **fields: Column) -> DataFrame:
    """K6: one JSON document of aggregates."""
    return df.agg(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("value"))


def retry_summary(unresolved: DataFrame, results: DataFrame, samples: int = 80) -> DataFrame:
    """State counts, the longest not-found records and the weak-host count, as JSON."""
    counts = results.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "not_found", "failed")]
    ).select(F.struct("success", "not_found", "failed").alias("status"))
    missing = unresolved.filter("status = 'not_found'")
    top = missing.orderBy(F.col("raw_text_length").desc(), "school_id").limit(samples)
    item = F.struct(
        (-F.col("raw_text_length")).alias("o"), F.col("school_id").alias("k"), F.col("school_name").alias("name"), "source_url", "raw_text_length"
    )
    listed = top.agg(
        F.transform(
            F.sort_array(F.collect_list(item)),
            lambda x: F.struct(x["name"].alias("name"), x["source_url"].alias("source_url"), x["raw_text_length"].alias("raw_text_length")),
        ).alias("not_found_samples")
    )
    weak = missing.agg(F.count_if(F.col("low_quality_host") == "yes").alias("low_quality_not_found_count"))
    parts = counts.unionByName(listed, True).unionByName(weak, True)
    names = ["status", "not_found_samples", "low_quality_not_found_count"]
    one = parts.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    return one.select(F.to_json(F.struct(*names)).alias("value"))


def write_json_rows(df: DataFrame, path: str) -> None:
    """K6: a one-column table of JSON texts."""
    df.write.mode("overwrite").text(path)


def write_names(df: DataFrame, name: str, path: str) -> None:
    """K7: distinct names in order, one per line."""
    df.select(F.col(name).alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def program_documents(
    programs: DataFrame, star_history: DataFrame, apply_history: DataFrame, sieve_history: DataFrame | None = None
) -> DataFrame:
    """K8: one JSON document per programme, histories re-nested by year (a few years per programme).

    A history belongs to its code; one that names both codes belongs to the programme with both, so that programmes may
    share one of them.
    """

    def nested(out: DataFrame, history: DataFrame, name: str) -> DataFrame:
        keys = [x for x in ("program_code", "apply_code") if x in history.columns]
        cols = [x for x in history.columns if x not in (*keys, "year")]
        entry = F.struct(F.col("year").cast("string"), F.struct(*cols))
        return out.join(history.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(name)), keys, "left")

    out = nested(programs, star_history, "star_history")
    out = nested(out, apply_history, "apply_history")
    if sieve_history is not None:
        out = nested(out, sieve_history, "apply_sieve_history")
    return out.select("program_code", F.to_json(F.struct(*[F.col(x) for x in out.columns])).alias("document"))

