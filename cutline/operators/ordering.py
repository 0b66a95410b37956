"""Sort keys of the listings. Every function returns Columns for ``orderBy``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import c, text
from ..functions.standards import bucket_rank, confidence_rank, tier_rank

FAR = 9e15


def unresolved_order(status: str = "status", length: str = "raw_text_length", key: str = "school_id") -> list[Column]:
    """Failed first, then longer texts; key breaks ties."""
    return [
        F.when(F.col(status) == "failed", 0).otherwise(1).asc(),
        F.coalesce(F.col(length), F.lit(0)).desc(),
        F.col(key).asc(),
    ]


def longest(df: DataFrame, length: str, key: str, n: int = 80) -> DataFrame:
    """The ``n`` longest rows."""
    return df.orderBy(F.coalesce(F.col(length), F.lit(0)).desc(), F.col(key).asc()).limit(n)


def _deadline(col: Column | str) -> Column:
    return c(col).asc_nulls_last()


def institution_order(
    mode: str,
    scored: bool,
    opportunity: bool = False,
    tier: Column | str = "tier",
    confidence: Column | str = "confidence",
    status_rank: Column | str = "status_rank",
    fit: Column | str = "best_fit",
    score: Column | str = "oppty_score",
    deadline: Column | str = "deadline",
    name: Column | str = "school_name",
) -> list[Column]:
    """T4: institution order by mode (fit, tier, deadline), deadline and name last."""
    by_tier, by_conf = tier_rank(tier).desc(), confidence_rank(confidence).desc()
    tail = [_deadline(deadline), text(name).asc()]
    if not scored:
        return [by_tier, by_conf, *tail]
    if opportunity:
        by_value, head = F.coalesce(c(score), F.lit(FAR)).asc(), []
    else:
        by_value, head = F.coalesce(c(fit), F.lit(10_000)).asc(), [c(status_rank).desc()]
    keys = {
        "fit": [by_value, by_tier, by_conf],
        "tier": [by_tier, by_value, by_conf],
        "deadline": [_deadline(deadline), by_value, by_tier],
    }.get(mode, [])
    return [*head, *keys, *tail]


def institution_keys(
    mode: str,
    scored: bool,
    opportunity: bool = False,
    tier: Column | str = "tier",
    confidence: Column | str = "confidence",
    status_rank: Column | str = "status_rank",
    fit: Column | str = "best_fit",
    score: Column | str = "oppty_score",
    deadline: Column | str = "deadline",
) -> list[Column]:
    """T4 as numbers to be sorted upwards, as many in every mode, so that one sort can serve all
    modes (``scans.ranks_by_mode``). The name comes after them."""
    by_tier, by_conf = -tier_rank(tier), -confidence_rank(confidence)
    by_date = F.coalesce(F.unix_date(c(deadline)).cast("double"), F.lit(FAR))
    if not scored:
        keys = [by_tier, by_conf, by_date]
    else:
        by_value = F.coalesce(c(score), F.lit(FAR)) if opportunity else F.coalesce(c(fit), F.lit(10_000))
        head = [] if opportunity else [-c(status_rank)]
        ordered = {"fit": [by_value, by_tier, by_conf], "tier": [by_tier, by_value, by_conf], "deadline": [by_date, by_value, by_tier]}
        keys = [*head, *ordered.get(mode, []), by_date]
    return [*[k.cast("double") for k in keys], *[F.lit(0.0)] * (5 - len(keys))]


def row_order(scored: bool, status: Column | str = "status", fit: Column | str = "fit", label: Column | str = "label") -> list[Column]:
    """T5: rows inside an institution."""
    by_label = text(label).asc()
    if not scored:
        return [by_label]
    rank = F.when(c(status) == "pass", 3).when(c(status) == "unknown", 2).otherwise(1)
    return [rank.desc(), F.coalesce(c(fit), F.lit(10_000)).asc(), by_label]


def hard_score(apply_status: Column | str, fail_count: Column | str, pass_count: Column | str) -> Column:
    """How hard the other route is."""
    base = F.when(c(apply_status) == "fail", 100).otherwise(0)
    return base + F.coalesce(c(fail_count), F.lit(0)) * 10 - F.coalesce(c(pass_count), F.lit(0))


def program_order(
    mode: str,
    bucket: Column | str = "bucket",
    school_rank: Column | str = "school_rank",
    slack: Column | str = "slack",
    hard: Column | str = "hard_score",
    school: Column | str = "school_name",
    program: Column | str = "program_name",
    collation: str | None = None,
) -> list[Column]:
    """Bucket, then the mode, then the name (binary, or a collation such as zh_Hans_CHN; Q18)."""
    by_rank = F.coalesce(c(school_rank).cast("double"), F.lit(1e9)).asc()
    by_slack = F.coalesce(c(slack), F.lit(-1e15)).desc()
    keys = {
        "schoolBest": [by_rank, by_slack],
        "starSlack": [by_slack, by_rank],
        "applyHard": [c(hard).desc(), by_rank],
    }.get(mode, [])
    name = F.concat(text(school), F.lit(" "), text(program))
    if collation:
        name = F.collate(name, collation)
    return [bucket_rank(bucket).asc(), *keys, name.asc()]


def facet_order(rank: Column | str, name: Column | str, collation: str | None = None) -> list[Column]:
    """T7."""
    shown = F.collate(c(name), collation) if collation else c(name)
    return [F.coalesce(c(rank).cast("double"), F.lit(1e9)).asc(), shown.asc()]
