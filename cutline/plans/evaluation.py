"""Requirement rows against candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import standards, vocab as V
from ..functions.expr import array_of
from ..operators import evaluate, filters, packed, stats
from ..session import dealt, table
from . import query

KEYS = V.SUBJECT_KEYS
WORDS = ["底标", "后标", "均标", "前标", "顶标"]
# One multiplier per subject spreads the ranks 0..5 (0 means no requirement).
FACTORS = [1, 2, 3, 5, 7, 11]
PROFILE = {"chinese": "均标", "english": "前标", "math_a": "底标", "social": "后标", "science": "顶标"}
RANKS = [3, 4, 1, None, 2, 5]


def word(rank: Column) -> Column:
    return F.get(array_of(WORDS), (rank - 1).cast("int"))


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement rows out of ``part``: E1 inheritance, any-of prefixes and some score requirements."""
    part = dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    key = F.col("p_partkey")
    row_std, row_score, gen_std = {}, {}, {}
    for i, (k, m) in enumerate(zip(KEYS, FACTORS), start=1):
        rank = F.nullif(((key * m + F.col("p_size")) % 6).cast("int"), F.lit(0))
        prefix = F.when((key + i) % 3 == 0, F.lit("任一")).otherwise("")
        row_std[k] = F.when(rank.isNotNull(), F.concat(prefix, word(rank)))
        general = F.nullif(F.lit((i * 2) % 6), F.lit(0))
        gen_std[k] = F.when(F.col("p_type").isin("PROMO", "LARGE"), word(general))
    row_score["chinese"] = F.when(key % 13 == 0, 10)
    rows = part.withColumn("row", evaluate.requirement_struct(row_std, row_score)).withColumn(
        "general", evaluate.requirement_struct(gen_std)
    )
    return rows.withColumn("reqs", evaluate.inherit(F.col("general"), F.col("row"))).drop("row", "general")


def user_case(ranks=RANKS) -> str:
    return "case k " + " ".join(f"when {i} then {'null' if r is None else r}" for i, r in enumerate(ranks, 1)) + " end"


_REQS = """
subj as (select * from (values (1, 1), (2, 2), (3, 3), (4, 5), (5, 7), (6, 11)) t(k, m)),
req0 as (
  select p_partkey, p_brand, p_name, p_type, k, nullif(cast((p_partkey * m + p_size) % 6 as int), 0) as rr,
    (p_partkey + k) % 3 = 0 as any_row,
    p_partkey % 13 = 0 and k = 1 as scored,
    case when p_type in ('PROMO', 'LARGE') then nullif((k * 2) % 6, 0) end as gr
  from part, subj),
req as (
  select p_partkey, p_brand, p_name, p_type, k, scored,
    case when rr is not null or scored then rr else gr end as r,
    case when rr is not null then any_row else false end as is_any
  from req0),
anyg as (
  select p_partkey, r, min(k) as ord, count(*) as n, list(k order by k) as ks
  from req where is_any and r is not null group by 1, 2 having count(*) >= 2),
maths as (
  select a.p_partkey from req a join req b on a.p_partkey = b.p_partkey and a.k = 3 and b.k = 4
  where a.r = b.r and not (a.is_any and b.is_any)),
grp as (
  select p_partkey, ord, unnest(ks) as k from anyg
  union all select p_partkey, 99, unnest([3, 4]) from maths)
"""


def eval_sql(user: str, pairs: str) -> str:
    """CTEs of E2 and E3 for rows ``pairs`` (id columns incl. p_partkey) with user rank expression ``user``."""
    return f"""
ur as (select x.*, k, {user} as u from {pairs} x, subj),
gx as (
  select ur.*, grp.ord, req.r from ur join grp on ur.p_partkey = grp.p_partkey and ur.k = grp.k
  join req on req.p_partkey = ur.p_partkey and req.k = ur.k),
gs as (
  select pid, ord, min(case when u >= r then u - r end) as best, bool_or(u is not null) as given,
    arg_min(struct_pack(k := k, r := r, u := u, d := greatest(0, r - u)), greatest(0, r - u) * 10 + k)
      filter (u is not null) as pick
  from gx group by 1, 2),
gsum as (
  select pid, bool_or(best is null) as bad, arg_min(given, ord) filter (best is null) as given, sum(best) as fit,
    bool_or(pick is null) as no_option, max(pick.d) as gmax, count(*) filter (pick.d > 0) as gn,
    string_agg(pick.k || ':' || pick.d, ',' order by ord) filter (pick.d > 0) as gtext,
    sum(case when pick.k in (3, 4) then 3 else 2 end + 2) filter (pick.d > 0) as glen
  from gs group by 1),
rest as (
  select ur.pid, ur.k, ur.u, req.r from ur join req on ur.p_partkey = req.p_partkey and ur.k = req.k
  where req.r is not null
    and not exists (select 1 from grp where grp.p_partkey = ur.p_partkey and grp.k = ur.k)),
asum as (
  select pid, bool_or(u is null or u < r) as bad, arg_min(u is null, k) filter (u is null or u < r) as missing,
    sum(u - r) as fit, min(k) filter (u is null) as first_missing,
    max(greatest(0, r - u)) as amax, count(*) filter (r > u) as an,
    string_agg(k || ':' || (r - u), ',' order by k) filter (r > u) as atext,
    sum(case when k in (3, 4) then 3 else 2 end) filter (r > u) as alen
  from rest group by 1),
info as (
  select p_partkey, bool_or(scored) as scored, bool_or(r is not null or scored) as has from req group by 1),
verdict as (
  select x.*, 
    case when not has or scored then 'unknown'
         when coalesce(g.bad, false) then case when g.given then 'fail' else 'unknown' end
         when coalesce(a.bad, false) then case when a.missing then 'unknown' else 'fail' end
         else 'pass' end as status,
    cast(coalesce(g.fit, 0) + coalesce(a.fit, 0) as integer) as fit0,
    case when not has or scored or coalesce(no_option, false) or first_missing is not null then 'unknown'
         when coalesce(gn, 0) + coalesce(an, 0) = 0 then 'pass' else 'fail' end as gap_status,
    cast(greatest(coalesce(gmax, 0), coalesce(amax, 0)) as integer) as gap0,
    concat_ws(',', gtext, atext) as gap_text,
    cast(coalesce(gn, 0) + coalesce(an, 0) as integer) as gap_n, coalesce(glen, 0) + coalesce(alen, 0) as label_len
  from {pairs} x join info using (p_partkey) left join gsum g using (pid) left join asum a using (pid))
"""


EVAL = f"with {_REQS}, one as (select p_partkey, p_partkey as pid from part), {eval_sql(user_case(), 'one')}"


@query(
    "eval_rows",
    EVAL + " select p_partkey, status, case when status = 'pass' then fit0 end as fit from verdict",
)
def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row against one candidate; a pure projection of the scan."""
    rows = evaluate.evaluate_rows(part_rows(spark, sf_dir), PROFILE, groups=packed.ANY_OF, include_unknown=True)
    return rows.select("p_partkey", "match.status", "match.fit")


@query(
    "gap_rows",
    EVAL
    + """ select p_partkey, gap_status, case when gap_status <> 'unknown' then gap0 end as max_deficit,
  case when gap_status = 'unknown' then '' else gap_text end as details from verdict""",
)
def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3, SF26: how far each row is from being met."""
    rows = evaluate.gap_rows(part_rows(spark, sf_dir), PROFILE, groups=packed.ANY_OF)
    index = {k: str(i) for i, k in enumerate(KEYS, 1)}
    from ..functions.expr import lookup

    shown = F.transform("gap.details", lambda d: F.concat(lookup(d["key"], index), F.lit(":"), d["deficit"].cast("string")))
    return rows.select(
        "p_partkey",
        F.col("gap.status").alias("gap_status"),
        F.col("gap.max_deficit").alias("max_deficit"),
        F.array_join(shown, ",").alias("details"),
    )


@query(
    "row_keep_rule",
    EVAL
    + """ select p_partkey, status in ('pass', 'unknown') as kept_unknown, status in ('pass', 'fail') as kept_fail,
  true as kept_all from verdict""",
)
def row_keep_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keep rule in three settings."""
    rows = evaluate.evaluate_rows(part_rows(spark, sf_dir), PROFILE, groups=packed.ANY_OF, include_unknown=True)
    s = F.col("match.status")
    return rows.select(
        "p_partkey",
        filters.keep_row(s, True, True, False).alias("kept_unknown"),
        filters.keep_row(s, True, False, True).alias("kept_fail"),
        filters.keep_row(s, False, False, False).alias("kept_all"),
    )


@query(
    "match_totals",
    EVAL
    + """ select count(*) as total_rows, count(*) filter (status = 'pass') as stat_pass,
  count(*) filter (status = 'unknown') as stat_unknown, count(*) filter (status = 'fail') as stat_fail from verdict""",
)
def match_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    rows = evaluate.evaluate_rows(part_rows(spark, sf_dir), PROFILE, groups=packed.ANY_OF, include_unknown=True)
    return stats.match_totals(rows, F.col("match.status"))


_APPLICATION_USER = "nullif(cast((o_custkey * m) % 6 as int), 0)"


@query(
    "eval_applications",
    f"""with {_REQS},
app as (
  select o_custkey, l_partkey as p_partkey, count(*) as n, o_custkey * 1000000000 + l_partkey as pid
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
{eval_sql(_APPLICATION_USER, 'app')}
select o_custkey, cast(min(fit0) filter (status = 'pass') as integer) as best_fit,
  cast(max(case status when 'pass' then 3 when 'unknown' then 2 else 1 end) as integer) as status_rank,
  cast(sum(n) as bigint) as applications, count(*) as row_span
from verdict group by 1""",
)
def eval_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many candidates against the rows they applied to.

    Applications are folded to distinct (candidate, row) pairs before the requirement
    join, so repeated applications of one candidate are evaluated once.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_partkey")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Requirement rows are packed once per row, not once per application.
    rows = packed.pack(part_rows(spark, sf_dir), groups=packed.ANY_OF).select("p_partkey", "_packed")
    joined = pairs.join(rows, F.col("l_partkey") == F.col("p_partkey"))
    ranks = " | ".join(f"shiftleft(cast((o_custkey * {m}) % 6 as int), {3 * k})" for k, m in enumerate(FACTORS))
    done = packed.match(joined, ranks, packed.slots_of(packed.ANY_OF), include_unknown=True)
    s = F.col("match.status")
    return done.groupBy("o_custkey").agg(
        F.min(F.when(s == "pass", F.col("match.fit"))).alias("best_fit"),
        F.max(F.when(s == "pass", 3).when(s == "unknown", 2).otherwise(1)).alias("status_rank"),
        F.sum("n").alias("applications"),
        F.count(F.lit(1)).alias("row_span"),
    )


@query(
    "choice_groups",
    f"""with {_REQS}
select p_partkey, cast(count(*) as integer) as n_groups,
  string_agg(list_aggregate(list_transform(ks, lambda x: cast(x as varchar)), 'string_agg', '+'), '|' order by ord) as groups
from anyg group by 1""",
)
def choice_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, U8."""
    from ..functions.expr import lookup

    index = {k: str(i) for i, k in enumerate(KEYS, 1)}
    rows = part_rows(spark, sf_dir)
    rows = rows.withColumn("choice_groups", evaluate.merge_groups(evaluate.any_of_groups(F.col("reqs")))).filter(F.size("choice_groups") > 0)
    shown = F.transform("choice_groups", lambda g: F.array_join(F.transform(g, lambda k: lookup(k, index)), "+"))
    return rows.select("p_partkey", F.size("choice_groups").alias("n_groups"), F.array_join(shown, "|").alias("groups"))


@query(
    "std_map_test",
    """
with r as (
  select p_partkey, p_size % 6 as a, p_size % 7 as b, p_partkey % 5 as c, p_partkey % 4 as d from part),
t as (
  select p_partkey,
    case a when 0 then 'ok' else case when 3 >= a then 'ok' else 'fail' end end as t1,
    case when b = 0 then 'ok' else case when 0 >= b + 8 then 'ok' else 'fail' end end as t2,
    case c when 0 then 'ok' when 1 then 'open' when 2 then 'fail' else 'ok' end as t3,
    case d when 0 then 'open' else 'ok' end as t4
  from r)
select p_partkey,
  case when t1 = 'fail' or t2 = 'fail' or t3 = 'fail' or t4 = 'fail' then 'fail'
       when t3 = 'open' or t4 = 'open' then 'unknown' else 'pass' end as status,
  case when t1 = 'fail' then '國文' when t2 = 'fail' then '英文' when t3 = 'fail' then '自然' end as failed
from t
""",
)
def std_map_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5, E6, SF3, SF8: ordered requirement lists; blank scores count as 0, blank standards fail (Q5)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    a, b, c_, d = F.col("p_size") % 6, F.col("p_size") % 7, F.col("p_partkey") % 5, F.col("p_partkey") % 4

    def pick(values, i):
        return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))

    # 國文 by rank word, 英文 by level, 自然 readable or not, 英聽 as an unreadable level.
    first = pick(["", "底標", "後標", "均標", "前標", "頂標"], a)
    second = F.when(b == 0, "--").otherwise(F.concat((b + 8).cast("string"), F.lit("級")))
    third = pick(["-", "看成績", "頂標", "底標", "均標"], c_)
    fourth = pick(["A級", "", "--", "-"], d)
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("subject"), v.alias("standard"))
            for n, v in (("國文", first), ("英文", second), ("其他", F.lit("頂標")), ("自然", third), ("英聽", fourth))
        ]
    )
    stds = evaluate.profile_map({"chinese": "均标", "english": "顶标", "science": "前标"})
    scores = evaluate.profile_map({"chinese": "10", "english": "", "listen": "B"})
    test = evaluate.requirement_test(entries, stds, scores)
    failed = F.when(test["status"] == "fail", F.substring_index(test["reason"], "：", 1))
    return part.select("p_partkey", test["status"].alias("status"), failed.alias("failed"))


@query(
    "ordinal_scalars",
    """
with o as (
  select o_orderkey, cast(substr(o_orderpriority, 1, 1) as int) as p, o_orderstatus as st, o_totalprice as price from orders),
w as (select *, 6 - p as r, ['底标', '后标', '均标', '前标', '顶标'][6 - p] as wd from o)
select o_orderkey, r as rank, st = 'F' as is_any, wd as base,
  case st when 'F' then wd || '以上' when 'O' then wd else '' end as normal,
  case st when 'F' then null when 'O' then wd else null end as strict,
  wd as word_back,
  case st when 'F' then '任一' || wd || '以上' || '(' || p || '级)' when 'O' then wd else '(' || p || '级)' end as shown,
  case st when 'F' then 'math_a' when 'O' then 'listen' else '' end as subject,
  case st when 'F' then true when 'O' then true else false end as has_choice,
  case when floor(price / 1000 * 10 + 0.5) / 10 = floor(floor(price / 1000 * 10 + 0.5) / 10)
       then cast(cast(floor(price / 1000 * 10 + 0.5) / 10 as bigint) as varchar)
       else cast(floor(price / 1000 * 10 + 0.5) / 10 as varchar) end || '%' as pct,
  case st when 'F' then 4 when 'O' then 1 else 1 end as tier, case st when 'F' then 3 when 'O' then 0 else 2 end as conf
from w
""",
)
def ordinal_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF1, SF3-SF5, SF7, SF8, SF26."""
    from ..functions import text as T

    o = table(spark, sf_dir, "orders")
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    st = F.col("o_orderstatus")
    base = word(6 - p)
    rows = o.select("o_orderkey", p.alias("p"), st.alias("st"), base.alias("wd"), F.col("o_totalprice").alias("price"))
    st, wd = F.col("st"), F.col("wd")
    full = F.when(st == "F", F.concat(F.lit(" 任一"), wd, F.lit("以上"))).when(st == "O", F.concat(wd, F.lit("级以上"))).otherwise(wd)
    parsed = standards.parse_standard(full)
    trad = F.translate(wd, "顶后标", "頂後標")
    raw = F.when(st == "F", F.concat(wd, F.lit("以上"))).when(st == "O", trad).otherwise(F.lit("--"))
    req = F.struct(
        F.when(st == "F", F.concat(F.lit("任一"), wd, F.lit("以上"))).when(st == "O", wd).otherwise("").alias("standard"),
        F.when(st == "O", 0).otherwise(F.col("p")).alias("min_score"),
    )
    name = F.when(st == "F", "數學A").when(st == "O", "英聽").otherwise("體育")
    choice = F.when(st == "F", F.concat(wd, F.lit("任一科"))).when(st == "O", "三科择一").otherwise("全部")
    return rows.select(
        "o_orderkey",
        parsed["rank"].alias("rank"),
        parsed["any"].alias("is_any"),
        parsed["base"].alias("base"),
        standards.normalise_word(raw).alias("normal"),
        standards.normalise_word_strict(raw).alias("strict"),
        standards.rank_word(parsed["rank"]).alias("word_back"),
        standards.format_requirement(req).alias("shown"),
        standards.subject_key(name).alias("subject"),
        T.has_choice(choice).alias("has_choice"),
        standards.format_percent(F.col("price") / 1000).alias("pct"),
        standards.tier_rank(F.when(st == "F", "985").otherwise(F.lit(None))).alias("tier"),
        standards.confidence_rank(F.when(st == "F", "HIGH").when(st == "P", "medium").otherwise("?")).alias("conf"),
    )
