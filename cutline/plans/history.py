"""Cutoff history: selectivity, buckets, boundaries, screening minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import dedupe, evaluate, filters, lookup, ordering, scans, stats
from ..session import cut_lineage, spread_table, table
from . import query

# The candidate's percentile used by the cutoff queries.
USER_PERCENT = 3.0


def latest_years(df: DataFrame, year, n: int = 3) -> list[int]:
    """The last ``n`` years present; one aggregated row reaches the driver (Q20)."""
    top = df.agg(F.max(year)).first()[0]
    return list(range(top - n + 1, top + 1))


def yearly_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cutoff per (institution, programme, year) of the latest three years."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_discount")
    years = latest_years(li, F.year("l_shipdate"))
    # A range on the date column reaches the parquet scan; year(...) alone would not.
    recent = li.filter(F.col("l_shipdate") >= F.lit(f"{years[0]}-01-01").cast("timestamp_ntz"))
    return recent.groupBy("l_suppkey", "l_partkey", F.year("l_shipdate").alias("year")).agg(
        F.round(F.min("l_discount") * 100, 4).alias("cutoff")
    )


def program_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_discount")
    years = latest_years(li, F.year("l_shipdate"))
    recent = li.filter(F.col("l_shipdate") >= F.lit(f"{years[0]}-01-01").cast("timestamp_ntz"))
    framed = stats.cutoff_frame(recent, ["l_suppkey", "l_partkey"], F.year("l_shipdate"), F.col("l_discount") * 100, years)
    return framed.select("l_suppkey", "l_partkey", "median_cutoff", "max_cutoff", "n_years")


_MEDIANS = """
yearly as (
  select l_suppkey, l_partkey, year(l_shipdate) as y, round(min(l_discount) * 100, 4) as cutoff
  from lineitem
  where year(l_shipdate) > (select max(year(l_shipdate)) - 3 from lineitem)
  group by 1, 2, 3),
prog as (
  select l_suppkey, l_partkey, median(cutoff) as median_cutoff, max(cutoff) as max_cutoff, count(*) as n_years
  from yearly group by 1, 2),
topk as (
  select *, row_number() over (partition by l_suppkey order by median_cutoff, l_partkey) as rn from prog),
score as (
  select l_suppkey, round(median(median_cutoff), 6) as score from topk where rn <= 10 group by 1),
ranks as (
  select l_suppkey, score, row_number() over (order by score, l_suppkey) as school_rank from score)
"""


def ranked_schools(medians: DataFrame) -> DataFrame:
    sel = stats.selectivity(medians, "l_suppkey").withColumn("score", F.round("score", 6))
    return scans.global_rank(sel, [F.col("score").asc(), F.col("l_suppkey").asc()], "school_rank")


@query("selectivity_rank", f"with {_MEDIANS} select l_suppkey, score, school_rank from ranks")
def selectivity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, A6, W9."""
    return ranked_schools(program_medians(spark, sf_dir)).select("l_suppkey", "score", "school_rank")


@query(
    "cutoff_stats",
    f"with {_MEDIANS} select l_suppkey, l_partkey, median_cutoff, max_cutoff, n_years from prog",
)
def cutoff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return stats.cutoff_stats(yearly_cutoffs(spark, sf_dir), ["l_suppkey", "l_partkey"], "year", "cutoff").select(
        "l_suppkey", "l_partkey", "median_cutoff", "max_cutoff", "n_years"
    )


_BUCKETS = f"""
with {_MEDIANS},
cand as (
  select p_partkey, p_name, case when p_size <= 10 then 'unknown' else 'pass' end as status,
         p_type = 'PROMO' as apply_hard
  from part where p_size <= 45),
base as (
  select g.l_suppkey, g.l_partkey, s_name, p_name, status, apply_hard, median_cutoff,
         median_cutoff - {USER_PERCENT} as slack, school_rank
  from prog g join cand on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  join ranks using (l_suppkey)),
b1 as (
  select *, case when status <> 'pass' then 'incomplete' when slack >= 0 then 'star_good'
                 when slack >= -1 then 'star_edge' else 'star_hard' end as b0 from base),
b2 as (select *, case when b0 = 'star_good' and apply_hard then 'oppty' else b0 end as bucket from b1)
"""


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    status = F.when(F.col("p_size") <= 10, "unknown").when(F.col("p_size") > 45, "fail").otherwise("pass")
    # P5: programmes the candidate cannot enter leave before the history join.
    cand = filters.not_failed(part.withColumn("status", status), "status")
    # The medians feed the ranks and the listing: written once, so the facts are read once.
    medians = cut_lineage(program_medians(spark, sf_dir))
    prog = medians.join(cand, F.col("l_partkey") == F.col("p_partkey"))
    ranks = ranked_schools(medians).select("l_suppkey", "school_rank")
    joined = prog.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(ranks, "l_suppkey")
    slack = F.col("median_cutoff") - F.lit(USER_PERCENT)
    return joined.withColumn("slack", slack).withColumn(
        "bucket", evaluate.bucket(F.col("status"), F.col("slack"), F.col("p_type") == "PROMO")
    )


@query(
    "bucket_programs",
    _BUCKETS
    + """
select l_suppkey, l_partkey, s_name, p_name, median_cutoff, slack, bucket, school_rank,
  row_number() over (order by case bucket when 'oppty' then 0 when 'star_good' then 1 when 'star_edge' then 2 else 3 end,
    school_rank, slack desc, s_name || ' ' || p_name, l_suppkey, l_partkey) as position
from b2 where bucket <> 'incomplete'
""",
)
def bucket_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship listing."""
    shown = bucketed(spark, sf_dir).filter(filters.bucket_filter("all"))
    order = ordering.program_order("schoolBest", school="s_name", program="p_name")
    ranked = scans.global_rank(shown, [*order, F.col("l_suppkey").asc(), F.col("l_partkey").asc()], "position")
    return ranked.select(
        "l_suppkey", "l_partkey", "s_name", "p_name", "median_cutoff", "slack", "bucket", "school_rank", "position"
    )


@query(
    "bucket_counts",
    _BUCKETS
    + """
select t.bucket, (select count(*) from b2 where b2.bucket = t.bucket) as n
from (values ('oppty'), ('star_good'), ('star_edge'), ('star_hard'), ('incomplete')) t(bucket)
""",
)
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per bucket, zero-filled."""
    return stats.count_by(bucketed(spark, sf_dir), "bucket", V.BUCKETS)


# ---- boundary vectors ------------------------------------------------------------------

ITEMS = ["在校學業成績全校排名百分比", "學測國文級分", "英文數學A級分總和", "英聽等級"]
SCORES = {"chinese": "8", "english": "9", "math_a": "8", "math_b": "", "social": "11", "science": "12", "listen": "B"}
PERCENTS = {"overall": "5"}


@query(
    "boundary_compare",
    """
with v as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    round(l_discount * 100, 4) as v1,
    case when l_tax > 0 then l_linenumber + 4 end as v2,
    case when l_returnflag <> 'R' then cast(l_quantity as int) % 30 end as v3,
    case l_linestatus when 'O' then 'A' else 'C' end as v4,
    round(l_tax * 100, 4) as w1
  from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  case when 5 < v1 then 'pass' when 5 > v1 then 'fail'
       when v2 is null then 'unknown' when 8 > v2 then 'pass' when 8 < v2 then 'fail'
       when v3 is null then 'unknown' when 17 > v3 then 'pass' when 17 < v3 then 'fail'
       when v4 = 'A' then 'fail' else 'pass' end as status,
  least(v1, w1) as overall
from v
""",
)
def boundary_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One projection over the fact rows."""
    li = spread_table(spark, sf_dir, "lineitem")

    def num(col):
        return F.when(col.isNotNull(), F.struct(col.cast("double").alias("num"), F.lit(None).cast("string").alias("txt")))

    listening = F.when(F.col("l_linestatus") == "O", "A").otherwise("C")
    vec = F.array(
        num(F.round(F.col("l_discount") * 100, 4)),
        num(F.when(F.col("l_tax") > 0, F.col("l_linenumber") + 4)),
        num(F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("int") % 30)),
        F.struct(F.lit(None).cast("double").alias("num"), listening.alias("txt")),
    )
    rows = li.withColumn("vec", vec).withColumn("vec2", F.array(num(F.round(F.col("l_tax") * 100, 4))))
    items = F.array(*[F.lit(i) for i in ITEMS])
    test = evaluate.boundary_test(items, "vec", evaluate.profile_map(SCORES), evaluate.profile_map(PERCENTS))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        test["status"].alias("status"),
        evaluate.overall_cutoff("vec", "vec2").alias("overall"),
    )


_SIEVE = """
with yrs as (select max(year(o_orderdate)) as m from orders),
h as (
  select o_custkey, year(o_orderdate) as y,
    cast(floor(max(o_totalprice)) as bigint) % 31 as need1, cast(floor(min(o_totalprice)) as bigint) % 28 as need2
  from orders, yrs where year(o_orderdate) > m - 3 group by 1, 2),
t as (
  select o_custkey, y, case when 17 > need1 then 'pass' when 17 < need1 then 'fail'
       when 20 > need2 then 'pass' when 20 < need2 then 'fail' else 'unknown' end as status
  from h)
"""


def sieve_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    years = latest_years(orders, F.year("o_orderdate"))
    recent = orders.filter(F.col("o_orderdate") >= F.lit(f"{years[0]}-01-01").cast("timestamp_ntz"))
    per_year = recent.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        (F.floor(F.max("o_totalprice")) % 31).cast("int").alias("need1"),
        (F.floor(F.min("o_totalprice")) % 28).cast("int").alias("need2"),
    )

    def rule(order: int, expr: str, need: str):
        return F.struct(
            F.lit(order).alias("order"), F.lit(expr).alias("expr"), F.col(need).alias("min_score"), F.lit(expr).alias("raw")
        )

    orders_col = F.array(rule(2, "數A＋自然", "need2"), rule(1, "國文、英文", "need1"))
    return per_year.withColumn("min_orders", orders_col), years


@query(
    "sieve_year_stats",
    _SIEVE
    + """
, c as (select o_custkey, count(*) filter (status = 'pass') as p, count(*) filter (status = 'fail') as f from t group by 1)
select o_custkey, p as pass_count, f as fail_count, 3 - p - f as unknown_count, f >= 2 as likely_fail, p >= 2 as likely_pass
from (select o_custkey, coalesce(p, 0) as p, coalesce(f, 0) as f
      from (select distinct o_custkey from orders) left join c using (o_custkey))
""",
)
def sieve_year_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screening history of the last three years per programme."""
    history, years = sieve_history(spark, sf_dir)
    tested = history.withColumn("status", evaluate.sieve_test("min_orders", evaluate.profile_map(SCORES))["status"])
    programs = table(spark, sf_dir, "orders").select("o_custkey")
    return evaluate.sieve_year_stats(tested, "o_custkey", "status", "year", years, programs)


@query(
    "subject_sum",
    """
with e as (
  select p_partkey, p_size, p_size % 7 as k from part)
select p_partkey,
  case k when 0 then cast(9 + 8 as double) when 1 then 8 + 8 when 2 then 8 when 3 then null when 4 then 0 + 11
         when 5 then null else 12 + 8 + 9 + 8 + 11 end as expr_value,
  case k when 0 then cast(8 as double) when 1 then 9 + 8 when 2 then null when 3 then 5 when 4 then 12 when 5 then null else 0 end
    as item_value,
  case k when 0 then '國英' when 1 then '(數A)國文' when 2 then '数学' when 3 then 'APCS' when 4 then '數B社' when 5 then 'x'
         else '國英數A社自' end as expr_norm
from e
""",
)
def subject_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19, E9, E10, SF31: blank scores count as 0."""
    k = F.col("p_size") % 7
    exprs = ["國、英", "（數A） 國文", "数学", "APCS", "數B：社", "x", "國英數A社自"]
    items = ["學測國文級分", "英文數學A級分總和", "術科等級", "在校學業成績全校排名百分比", "學測自然級分", "數學學業成績總平均全校排名百分比", "學測數學B級分"]

    def pick(values):
        return F.get(F.array(*[F.lit(v) for v in values]), k)

    scores, pct = evaluate.profile_map(SCORES), evaluate.profile_map(PERCENTS)
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(exprs).alias("e"), pick(items).alias("i"))
    return rows.select(
        "p_partkey",
        evaluate.expression_value("e", scores).alias("expr_value"),
        evaluate.tie_item_value(F.col("i"), scores, pct)["num"].alias("item_value"),
        evaluate.normal_expression("e").alias("expr_norm"),
    )


# ---- best entries ------------------------------------------------------------------------


@query(
    "best_history_entry",
    """
with e as (
  select o_custkey, o_orderkey, cast(substr(o_orderpriority, 1, 1) as int) as page,
    (case when o_orderstatus <> 'P' then 1 else 0 end) + (case when o_totalprice > 200000 then 1 else 0 end)
      + (case when o_totalprice > 300000 then 1 else 0 end) as filled,
    case when o_orderstatus <> 'P' then 1 else 0 end as has_first
  from orders)
select o_custkey, o_orderkey, filled, has_first = 1 as has_first from (
  select *, row_number() over (partition by o_custkey order by filled desc, has_first desc, page, o_orderkey) as rn from e)
where rn = 1
""",
)
def best_history_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-1 per key, limited before the shuffle."""
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    rows = orders.select(
        "o_custkey",
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("page"),
        F.array(F.when(F.col("o_orderstatus") != "P", price), F.when(price > 200000, price)).alias("round1"),
        F.array(F.when(price > 300000, price)).alias("round2"),
    )
    best = dedupe.keep_best(rows, ["o_custkey"], dedupe.history_order(pos="o_orderkey"))
    both = F.concat("round1", "round2")
    return best.select(
        "o_custkey",
        "o_orderkey",
        F.size(F.filter(both, lambda v: v.isNotNull())).alias("filled"),
        F.get("round1", F.lit(0)).isNotNull().alias("has_first"),
    )


@query(
    "most_orders_first_wins",
    """
with e as (
  select o_custkey, year(o_orderdate) as y, cast(substr(o_orderpriority, 1, 1) as int) as n, o_orderkey from orders)
select o_custkey, cast(y as integer) as year, n as n_orders, o_orderkey from (
  select *, row_number() over (partition by o_custkey, y order by n desc, o_orderkey) as rn from e) where rn = 1
""",
)
def most_orders_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry with more screening orders, the first source on ties."""
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.year("o_orderdate").alias("year"),
        F.array_repeat(F.lit(1), F.substring("o_orderpriority", 1, 1).cast("int")).alias("min_orders"),
        "o_orderkey",
    )
    best = dedupe.keep_best(rows, ["o_custkey", "year"], dedupe.most_orders(source="o_orderkey"))
    return best.select("o_custkey", "year", F.size("min_orders").alias("n_orders"), "o_orderkey")


@query(
    "last_kind_wins",
    """
select o_custkey, o_orderstatus, o_orderkey from (
  select *, row_number() over (partition by o_custkey
    order by case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end desc, o_orderkey) as rn from orders)
where rn = 1
""",
)
def last_kind_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later kind overrides an earlier one."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return dedupe.keep_best(rows, ["o_custkey"], [kind.desc(), F.col("o_orderkey").asc()])


@query(
    "compose_history",
    """
with yrs as (select max(year(l_shipdate)) as m from lineitem),
star as (
  select cast(l_partkey as varchar) as program_code, year(l_shipdate) as year, min(l_discount) as cutoff
  from lineitem where l_returnflag <> 'R' group by 1, 2),
app as (
  select cast(l_partkey as varchar) || '2' as apply_code, year(l_shipdate) as year, max(l_tax) as dist
  from lineitem where l_linestatus = 'O' group by 1, 2),
base as (
  select cast(p_partkey as varchar) as program_code, p_size as star_group,
    case when p_size % 3 = 0 then case when p_size % 2 = 0 then upper(p_brand) else '' end else p_brand end as school_name,
    case when p_size % 5 = 0 then p_type else p_name end as program_name
  from part)
select b.program_code, substr(b.program_code, 1, 3) as school_code, star_group, school_name, program_name,
  b.program_code || '2' as apply_code, cast(m - y.i as integer) as year, cutoff, dist
from base b, yrs, (values (0), (1), (2)) y(i)
left join star s on s.program_code = b.program_code and s.year = m - y.i
left join app a on a.apply_code = b.program_code || '2' and a.year = m - y.i
""",
)
def compose_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue, current details, derived-key details and yearly histories."""
    part = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    years = latest_years(li, F.year("l_shipdate"))
    code = F.col("p_partkey").cast("string")
    catalog = part.select(
        code.alias("program_code"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("school_name"),
        F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_name")).alias("program_name"),
        F.col("p_size").alias("group"),
    )
    details = part.select(
        code.alias("program_code"),
        F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise("").alias("school_name"),
        F.col("p_type").alias("program_name"),
        F.lit(None).cast("map<string,string>").alias("requirements"),
        F.lit(None).cast("array<string>").alias("tie_break_items"),
    )
    apply_current = part.select(
        F.concat(code, F.lit("2")).alias("program_code"),
        F.lit(None).cast("array<struct<subject:string,standard:string,multiplier:string>>").alias("stage1"),
    )
    recent = li.filter(F.col("l_shipdate") >= F.lit(f"{years[0]}-01-01").cast("timestamp_ntz"))
    year = F.year("l_shipdate").alias("year")
    star = recent.filter("l_returnflag <> 'R'").groupBy(F.col("l_partkey").cast("string").alias("program_code"), year).agg(
        F.min("l_discount").alias("cutoff")
    )
    app = recent.filter("l_linestatus = 'O'").groupBy(
        F.concat(F.col("l_partkey").cast("string"), F.lit("2")).alias("apply_code"), year
    ).agg(F.max("l_tax").alias("dist"))
    rows = lookup.compose_programs(catalog, details, apply_current, star, app, years)
    return rows.select(
        "program_code", "school_code", "star_group", "school_name", "program_name", "apply_code", "year", "cutoff", "dist"
    )


@query(
    "overlay_years",
    """
with old as (select l_partkey, year(l_shipdate) as year, min(l_discount) as cutoff, count(*) as n from lineitem group by 1, 2),
new as (select l_partkey, year(l_shipdate) as year, min(l_tax) as cutoff, count(*) as n from lineitem
        where l_returnflag = 'N' and l_quantity > 25 group by 1, 2)
select coalesce(n.l_partkey, o.l_partkey) as l_partkey, cast(coalesce(n.year, o.year) as integer) as year,
  case when n.l_partkey is not null then n.cutoff else o.cutoff end as cutoff,
  case when n.l_partkey is not null then n.n else o.n end as n
from old o full join new n on o.l_partkey = n.l_partkey and o.year = n.year
""",
)
def overlay_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New years override old ones."""
    li = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate").alias("year")
    count = F.count(F.lit(1)).alias("n")
    old = li.groupBy("l_partkey", year).agg(F.min("l_discount").alias("cutoff"), count)
    new = li.filter("l_returnflag = 'N' and l_quantity > 25").groupBy("l_partkey", year).agg(F.min("l_tax").alias("cutoff"), count)
    return lookup.overlay_years(old, new, ["l_partkey", "year"], ["cutoff", "n"])
