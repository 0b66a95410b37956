"""Label sync: authority texts to tier and recognition labels of institutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import c
from ..functions.text import match_text, name_aliases
from ..functions.urls import mixed_host
from .lookup import live_labels, local_tier, member_flag
from .matching import domain_matches, names_in_texts
from .pages import authority_domains
from .stats import count_by

TIERS = ["985", "211", "双一流", "非双一流"]


def authority_sets(
    schools: DataFrame, name: str, texts: DataFrame, set_name: str, value: str, aliases: Column | None = None
) -> DataFrame:
    """(set_name, name) pairs found in the authority texts of each set.

    Texts are matched under an id of their own and collapse to their sets afterwards, so
    a set with many texts is no hot key and no candidate meets the other texts of its set.
    """
    prepared = texts.select(set_name, match_text(value).alias("_text")).withColumn("_tid", F.xxhash64("_text"))
    once = prepared.select("_tid", "_text").dropDuplicates(["_tid", "_text"])
    matched = names_in_texts(once, "_tid", "_text", schools.select(name).distinct(), name, name_aliases(name) if aliases is None else aliases)
    return matched.join(prepared.select("_tid", set_name).distinct(), "_tid").select(set_name, name).distinct()


def label_schools(
    schools: DataFrame,
    matched: DataFrame,
    domain_texts: DataFrame,
    domain_value: str,
    reference: DataFrame,
    recognised: DataFrame,
    name: str = "name",
    type_text: Column | str = "type",
    url: str = "zsjz_url",
    set_names: tuple[str, str, str] = ("985", "211", "双一流"),
) -> DataFrame:
    """Tier, recognition and their sources for every institution."""
    step = local_tier(schools, reference, name, type_text)
    flags = matched.groupBy(F.col("name" if "name" in matched.columns else name).alias("_n")).agg(
        *[F.bool_or(F.col("set_name") == s).alias(f"_in{i}") for i, s in enumerate(set_names)]
    )
    step = step.join(flags, F.col(name) == F.col("_n"), "left").drop("_n")
    step = step.withColumn("_host", mixed_host(url))
    domains = authority_domains(domain_texts, domain_value)
    good = domain_matches(step, "_host", domains, "domain").withColumn("_dom", F.lit(True))
    step = step.join(good, "_host", "left")
    step = member_flag(step, recognised, name, "_listed")

    def flag(x: str) -> Column:
        return F.coalesce(c(x), F.lit(False))

    labels = live_labels(flag("_in0"), flag("_in1"), flag("_in2"), F.col("local_tier"), flag("_dom"), flag("_listed"))
    for col, expr in labels.items():
        step = step.withColumn(col, expr)
    return step.drop("_host", "_dom", "_listed", "_in0", "_in1", "_in2", "local_tier")


def tier_report(schools: DataFrame, recognised: str = "taiwan_recognized") -> DataFrame:
    """A2: institutions per tier, zero-filled, and those of them that are recognised, with a row ``total``."""
    found = schools.filter(F.coalesce(F.col(recognised), F.lit(False)))
    per_tier = count_by(schools, "tier", TIERS).join(count_by(found, "tier", TIERS).withColumnRenamed("n", "recognised"), "tier")
    total = schools.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(recognised), F.lit(False))).alias("recognised"))
    return per_tier.unionByName(total.withColumn("tier", F.lit("total")))
