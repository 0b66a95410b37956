"""Transfer and near-miss rows per institution."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import top_per_key


def opportunities(
    df: DataFrame,
    school: Sequence[str],
    position: str,
    label: str,
    track: str,
    keyword_hit: Column,
    match: str = "match",
    gap: str = "gap",
    gap_text: str = "gap_text",
    area: str | None = None,
    hot_areas: Sequence[str] = (),
    gap_limit: int = 1,
    include_unknown: bool = False,
    transfer: bool = True,
    near_miss: bool = True,
    target: Column | None = None,
) -> DataFrame:
    """E13 over evaluated rows (``match`` from evaluate_rows, ``gap`` from gap_rows).

    A transfer row is the institution's best non-science row when nothing on the
    science side passes; a near miss is its closest failing science-side row. Both orders are
    packed into numbers, so one hash aggregate finds every institution's best number of each
    kind and tests the institution; the rows that have it are joined back and ties fall to the
    label and ``position``, the row's place as a number. With ``target`` (J15 over a row's own
    majors and label), institutions of which no row hits it give nothing.
    """
    gap_limit = max(1, min(3, int(gap_limit or 1)))
    columns = df.columns
    m, g = F.col(match), F.col(gap)
    science = F.coalesce((F.col(track) == "science") | keyword_hit, F.lit(False))
    states = ["pass", "unknown"] if include_unknown else ["pass"]
    no = F.lit(None).cast("bigint")
    to, near = no, no
    if transfer:
        worse = F.when(m["status"] == "pass", 0).otherwise(1).cast("bigint")
        packed = worse * (1 << 40) + (1 << 32) - F.coalesce(m["fit"], F.lit(-1)).cast("bigint")
        to = F.when(m["status"].isin(states) & (F.col(track) != "science"), packed)
    if near_miss:
        cand = (m["status"] == "fail") & (g["status"] == "fail") & (F.size(g["details"]) <= 1) & (g["max_deficit"] <= gap_limit)
        if area and hot_areas:
            cand = cand & F.col(area).isin(list(hot_areas))
        packed = g["max_deficit"].cast("bigint") * (1 << 32) + F.length(F.coalesce(F.col(gap_text), F.lit("")))
        near = F.when(cand & science, packed)
    rows = df.select(
        *columns, to.alias("_to"), near.alias("_near"), ((m["status"] == "pass") & science).alias("_direct"),
        (F.lit(True) if target is None else target).alias("_target"),
    )
    best = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(school)]).agg(
        F.min("_to").alias("_best_to"), F.min("_near").alias("_best_near"),
        F.coalesce(F.bool_or("_direct"), F.lit(False)).alias("_any_direct"), F.coalesce(F.bool_or("_target"), F.lit(False)).alias("_any_target"),
    ).filter("_any_target")
    same = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(school)])
    won = rows.filter("_to is not null or _near is not null").join(best, same)
    is_to = ~F.col("_any_direct") & (F.col("_to") == F.col("_best_to"))
    kinds = F.array_compact(F.array(F.when(is_to, F.lit("transfer")), F.when(F.col("_near") == F.col("_best_near"), F.lit("nearmiss"))))
    tied = won.select(*columns, F.explode(kinds).alias("kind"))
    order = [F.when(F.col("kind") == "nearmiss", F.coalesce(F.col(label), F.lit(""))), F.col(position)]
    return top_per_key(tied, [*school, "kind"], order, 1)
