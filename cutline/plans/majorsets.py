"""Major lists from labels, rows and records, over the programmes of ``part``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.standards import has_requirements
from ..operators import majors
from ..session import table
from . import query

_LABELS = ("中医学、针灸推拿学", "理工类专业", "法学，音乐/法学", "")


def _pick(values: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % len(values)).cast("int"))


@query(
    "label_majors",
    """
select p_partkey, v.named, v.shown from part join (values (0, '中医学|针灸推拿学', '中医学|针灸推拿学'), (1, '', null), (2, null, '法学|音乐'), (3, '', ''))
  v(k, named, shown) on v.k = p_partkey % 4
""",
)
def label_majors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9, SF10, SF11: majors named by a label, in the record form and the display form (null: not asked)."""
    label, k = _pick(_LABELS), F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(k != 2, F.array_join(T.label_majors(label), "|")).alias("named"),
        F.when(k != 1, F.array_join(T.display_label_majors(label), "|")).alias("shown"),
    )


@query(
    "row_majors",
    """
select p_partkey, case when p_partkey % 2 = 0 then '法学' when p_partkey % 3 = 0 then '音乐' else '临床医学' end as majors from part
""",
)
def row_majors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row's own majors, else those of its label, else the institution's."""
    none = F.array().cast("array<string>")
    own = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("法学"))).otherwise(none)
    label = F.when(F.col("p_partkey") % 3 == 0, "音乐").otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", own.alias("own"), label.alias("label"), F.array(F.lit("临床医学")).alias("school"))
    return rows.select("p_partkey", F.array_join(majors.row_majors("own", "label", "school"), "|").alias("majors"))


@query(
    "school_majors",
    """
with own as (select p_brand, '法学' as v, 0 as k from part union all
  select p_brand, case p_type when 'PROMO' then '音乐' when 'SMALL' then '护理学' else '法学' end, 1 from part),
f as (select p_brand, v, min(k) as k from own group by 1, 2)
select p_brand, string_agg(v, '|' order by k, v) as majors from f group by 1
""",
)
def school_majors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct majors of an institution, its own before those of its rows."""
    row = F.when(F.col("p_type") == "PROMO", "音乐").when(F.col("p_type") == "SMALL", "护理学").otherwise("法学")
    rows = table(spark, sf_dir, "part").select("p_brand", F.array(F.lit("法学")).alias("own"), F.array(row).alias("row"))
    return majors.school_majors(rows, "p_brand", "own", "row").select("p_brand", F.array_join("school_majors", "|").alias("majors"))


@query(
    "attach_majors",
    """
select p_partkey, case when p_size % 2 = 0 then '医学' else '旧' end as majors,
  case p_partkey % 3 when 0 then '已有' when 1 then '法学|护理学' else '' end as dept_majors
from part
""",
)
def attach_majors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: found majors go onto the record; departments without majors take those of their label."""
    none = F.array().cast("array<string>")
    k = F.col("p_partkey") % 3
    dept = F.struct(
        F.when(k == 2, "理工类专业").otherwise("法学、护理学").alias("department"), F.when(k == 0, F.array(F.lit("已有"))).otherwise(none).alias("majors")
    )
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.struct(F.array(F.lit("旧")).alias("majors"), F.array(dept).alias("department_requirements")).alias("extraction"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("医学"))).otherwise(none).alias("found"),
    )
    ext = majors.attach_majors(rows, "extraction", "found")
    first = F.get("extraction.department_requirements", F.lit(0))
    return ext.select("p_partkey", F.array_join("extraction.majors", "|").alias("majors"), F.array_join(first["majors"], "|").alias("dept_majors"))


@query(
    "backfill_majors",
    """
select p_partkey, case when p_partkey % 2 = 0 then '首页|法学|护理学' else '首页|法学' end as merged,
  case when p_partkey % 2 = 0 then '护理学' else '法学' end as replaced from part
""",
)
def backfill_majors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New majors merged into the old list, or in its place with the cleaned old list as fallback."""
    new = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("护理学"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.lit("首页"), F.lit(" 法学 ")).alias("old"), new.alias("new"))
    return rows.select(
        "p_partkey",
        F.array_join(majors.backfill_majors("old", "new", False), "|").alias("merged"),
        F.array_join(majors.backfill_majors("old", "new", True), "|").alias("replaced"),
    )


@query("has_requirements", "select p_partkey, p_type = 'PROMO' or p_size % 3 <> 0 as present from part")
def has_requirement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF12: a standard or a level other than 0 in any subject."""
    none = F.struct(F.lit(None).cast("string").alias("standard"), F.lit(None).cast("int").alias("min_score"))
    some = F.struct(F.when(F.col("p_type") == "PROMO", "均标").alias("standard"), (F.col("p_size") % 3).cast("int").alias("min_score"))
    subjects = F.struct(*[(some if s == "math_b" else none).alias(s) for s in ("chinese", "english", "math_a", "math_b", "social", "science")])
    return table(spark, sf_dir, "part").select("p_partkey", has_requirements(subjects).alias("present"))
