"""Transfer and near-miss picks, major filter, opportunity report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.standards import format_gap
from ..functions.text import flex_signals, keyword_hit, other_text, row_track
from ..operators import evaluate, opportunity, packed, sets, stats
from ..operators.matching import target_hit
from ..session import table
from . import query
from .evaluation import EVAL, PROFILE, part_rows

KEYWORDS = ["gear", "Ring"]

_PICKS = (
    EVAL
    + """,
rws as (
  select v.*, p.p_brand || '/' || p_size % 10 as inst, p.p_name, p.p_type,
    case when p_type in ('PROMO', 'LARGE') then 'science' when p_type = 'SMALL' then 'mixed' else 'arts' end as track,
    contains(lower(p_name), 'gear') or contains(lower(p_name), 'ring') as hit
  from verdict v join part p using (p_partkey)),
target as (select distinct inst from rws where hit),
direct as (select distinct inst from rws where status = 'pass' and (track = 'science' or hit)),
tr as (
  select *, row_number() over (partition by inst order by case status when 'pass' then 2 else 1 end desc,
    case when status = 'pass' then fit0 else -1 end desc, p_partkey) as rn
  from rws where status in ('pass', 'unknown') and track <> 'science' and inst not in (select inst from direct) and inst in (select inst from target)),
nm as (
  select *, row_number() over (partition by inst order by gap0, label_len, p_name, p_partkey) as rn
  from rws where status = 'fail' and (track = 'science' or hit) and gap_status = 'fail' and gap_n <= 1 and gap0 <= 2 and inst in (select inst from target)),
picks as (
  select inst, p_partkey, 'transfer' as kind, status, case when status = 'pass' then fit0 end as fit, cast(null as integer) as gap
  from tr where rn = 1
  union all
  select inst, p_partkey, 'nearmiss', status, null, gap0 from nm where rn = 1)
"""
)


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_rows(spark, sf_dir)
    rows = evaluate.match_and_gap(rows, PROFILE, groups=packed.ANY_OF, include_unknown=True).withColumn("gap_text", format_gap("gap.details"))
    track = F.when(F.col("p_type").isin("PROMO", "LARGE"), "science").when(F.col("p_type") == "SMALL", "mixed").otherwise("arts")
    return opportunity.opportunities(
        rows.withColumns({"track": track, "inst": F.concat_ws("/", "p_brand", (F.col("p_size") % 10).cast("string"))}),
        ["inst"],
        "p_partkey",
        "p_name",
        "track",
        keyword_hit("p_name", KEYWORDS),
        gap_limit=2,
        include_unknown=True,
        target=target_hit(F.array("p_name"), F.array("p_type"), KEYWORDS),
    )


@query("opportunities", _PICKS + " select * from picks")
def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transfer and one near-miss row per institution at most."""
    rows = picks(spark, sf_dir)
    return rows.select(
        "inst",
        "p_partkey",
        "kind",
        F.col("match.status").alias("status"),
        F.when(F.col("kind") == "transfer", F.col("match.fit")).alias("fit"),
        F.when(F.col("kind") == "nearmiss", F.col("gap.max_deficit")).alias("gap"),
    )


@query(
    "oppty_meta",
    _PICKS
    + """
select inst,
  cast(min(case when kind = 'transfer' then case status when 'pass' then fit else 500 end else 10000 + gap * 100 end) as double)
    as score,
  min(gap) as best_gap, bool_or(kind = 'transfer') as has_transfer, bool_or(kind = 'nearmiss') as has_nearmiss
from picks group by 1""",
)
def oppty_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return stats.opportunity_meta(opportunities(spark, sf_dir), ["inst"], "kind", "status", "fit", "gap")


@query(
    "oppty_counts",
    _PICKS
    + """ select count(distinct inst) filter (kind = 'transfer') as transfer_schools,
  count(distinct inst) filter (kind = 'nearmiss') as nearmiss_schools from picks""",
)
def oppty_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    return stats.kind_counts(opportunities(spark, sf_dir), "inst", "kind")


@query(
    "major_filter_fallback",
    """
with m as (
  select p_partkey, p_brand, p_name like '%gear%' or p_name like '%lamp%' as hit,
    p_type = 'PROMO' as school_hit from part),
s as (select p_brand, bool_or(hit) as any_row, bool_or(hit or school_hit) as any_school from m group by 1)
select p_partkey, m.p_brand, not any_row as mapping_unknown
from m join s using (p_brand) where any_school and (hit or not any_row)
""",
)
def major_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a selected major; all rows of institutions that hit only as a whole."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.split("p_name", " ").alias("row_majors"), F.array(F.lower("p_type")).alias("school_majors")
    )
    out = sets.major_filter(part, "p_brand", "row_majors", "school_majors", ["gear", "lamp", "promo"])
    return out.select("p_partkey", "p_brand", "mapping_unknown")


@query(
    "missing_selected",
    """
select p_partkey, case when p_name like '%gear%' then '' else 'gear' end as missing,
  p_name like '%gear%' as any_hit from part
""",
)
def missing_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U5, U6."""
    part = table(spark, sf_dir, "part")
    wanted = F.array(F.lit("gear"))
    return part.select(
        "p_partkey",
        F.array_join(sets.missing_selected(wanted, F.split("p_name", " ")), ",").alias("missing"),
        sets.any_selected(wanted, F.split("p_name", " ")).alias("any_hit"),
    )


@query(
    "row_track",
    """
with r as (
  select p_partkey, p_size, lower(p_type) || '·' || p_name as label, p_size % 4 as k, p_size % 3 as f, p_partkey % 2 as g
  from part),
t as (
  select *, contains(label, 'promo') as is_mixed, contains(label, 'gear') or contains(label, 'small') as arts,
    contains(label, 'ring') or contains(label, 'large') as sci from r)
select p_partkey,
  case when is_mixed then 'mixed' when arts and sci then 'mixed' when sci then 'science' when arts then 'arts'
       when k = 0 and f = 0 then 'mixed' when k = 0 then 'science' when f = 0 then 'arts' else 'unknown' end as track,
  case when g = 0 then 'c1；c2' else '' end || case when g = 0 and k <> 1 then '；' else '' end
    || case when k <> 1 then 'note ' || k else '' end as other_text,
  case when k = 2 then '面试,择优' when k = 3 then '作品/项目' else '' end as signals,
  g = 0 as first_row
from t
""",
)
def row_track_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF27-SF29, W10."""
    part = table(spark, sf_dir, "part")
    k, f, g = F.col("p_size") % 4, F.col("p_size") % 3, F.col("p_partkey") % 2
    label = F.concat(F.lower("p_type"), F.lit("·"), F.col("p_name"))
    track = row_track(
        label,
        F.array().cast("array<string>"),
        F.lit(""),
        F.when(k == 0, "均标"),
        F.when(f == 0, "前标"),
        mixed_words=["promo"],
        arts_words=["gear", "small"],
        science_words=["ring", "large"],
    )
    conds = F.array(F.lit("c1"), F.lit(" "), F.lit("c2"), F.lit("c3"))
    note = F.when(k != 1, F.concat(F.lit(" note "), k.cast("string"), F.lit(" ")))
    flex = F.when(k == 2, "需 面 试，择 优录取").when(k == 3, "竞赛获奖").otherwise("无")
    return part.select(
        "p_partkey",
        track.alias("track"),
        other_text(conds, note, stats.first_row_flag(g)).alias("other_text"),
        F.array_join(flex_signals([flex]), ",").alias("signals"),
        stats.first_row_flag(g).alias("first_row"),
    )
