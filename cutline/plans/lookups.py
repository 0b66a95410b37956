"""Keep-best, ordered unions, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import merge_lists
from ..operators import dedupe, lookup, scans, sets, stats
from ..operators import labels as label_ops
from ..session import table
from . import query

# ---- W1 and its parts over events --------------------------------------------------------

_EVENT = """
ev as (
  select *, cast(json_extract(props, '$.k') as int) as k from events),
rec as (
  select event_id, user_id, event_type, value, k,
    case when event_type in ('view', 'purchase') then 'success' when event_type = 'error' then 'failed' else 'not_found' end
      as status,
    case k % 3 when 0 then 'high' when 1 then 'Medium' else 'none' end as confidence,
    case when event_type = 'signup' then 'Official' when event_type = 'click' then 'search' else 'root_scan' end as source,
    'https://' || case k % 5 when 0 then 'www.a.edu.cn' when 1 then 'zsb.b.com:8080' when 2 then 'www.zhihu.com'
      when 3 then 'x.gov.cn' else 'c.edu' end || '/p?q=' || k as url,
    cast(floor(value * 100) as bigint) as len
  from ev),
qual as (
  select *,
    case source when 'Official' then 150 when 'search' then 20 else 0 end
    + case k % 5 when 0 then 120 when 1 then 60 when 2 then -220 when 3 then 80 else 120 end
    + least(len // 200, 60) as quality,
    case confidence when 'high' then 3 when 'Medium' then 2 else 0 end as conf
  from rec)
"""


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_records_of(table(spark, sf_dir, "events"))


def event_records_of(ev: DataFrame) -> DataFrame:
    """Events as harvested result versions: state, confidence, source and length per version."""
    k = F.get_json_object("props", "$.k").cast("int")
    rec = ev.select("event_id", "user_id", "event_type", "value", k.alias("k"))
    k, kind = F.col("k"), F.col("event_type")
    host = F.get(F.array(*[F.lit(h) for h in ("www.a.edu.cn", "zsb.b.com:8080", "www.zhihu.com", "x.gov.cn", "c.edu")]), k % 5)
    return rec.select(
        "*",
        F.when(kind.isin("view", "purchase"), "success").when(kind == "error", "failed").otherwise("not_found").alias("status"),
        F.when(k % 3 == 0, "high").when(k % 3 == 1, "Medium").otherwise("none").alias("confidence"),
        F.when(kind == "signup", "Official").when(kind == "click", "search").otherwise("root_scan").alias("source"),
        F.concat(F.lit("https://"), host, F.lit("/p?q="), k.cast("string")).alias("url"),
        F.floor(F.col("value") * 100).alias("len"),
        (k % 2 == 0).alias("has_req"),
    )


def event_order(arrival: str = "event_id"):
    return dedupe.best_order(
        "status", F.col("has_req"), "confidence", "len", dedupe.source_quality("source", "url", "len"), arrival
    )


KEEP_BEST_SQL = f"""
with {_EVENT}
select user_id, event_id, status from (
  select *, row_number() over (partition by user_id order by
    case status when 'success' then 3 when 'not_found' then 2 else 1 end desc,
    case when status = 'success' then case when k % 2 = 0 then 1 else 0 end else quality end desc,
    case when status = 'success' then conf else 0 end desc, len desc, event_id) as rn
  from qual) where rn = 1
"""


@query("keep_best", KEEP_BEST_SQL)
def keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, SF4, SF14: best version per key; each task keeps one row per key before the shuffle."""
    return dedupe.keep_best(event_records(spark, sf_dir), ["user_id"], event_order()).select("user_id", "event_id", "status")


@query(
    "keep_best_lists",
    """
with v as (select o_custkey as k, row_number() over (partition by o_custkey order by cast(floor(o_totalprice / 1000) as int) desc, o_orderkey) as rn,
    o_orderkey % 2 as label, o_orderpriority as p, o_orderstatus as s from orders),
c as (select k, count(*) as n from v group by 1),
vals as (select k, rn * 10 as pl, p as val from v union all select k, rn * 10 + 1, s from v),
firsts as (select k, val, min(pl) as pl from vals group by 1, 2),
general as (select k, string_agg(val, '|' order by pl) as g from firsts group by 1),
w as (select * from v where rn = 1),
dvals as (select v.k, v.p as val, min(v.rn) as pl from v join w on v.k = w.k and v.label = w.label group by 1, 2),
dept as (select k, string_agg(val, '|' order by pl) as d from dvals group by 1)
select w.k as o_custkey, case when n = 1 then ' ' || w.p || '|' || w.s || '|' || w.s else g end as majors, d as dept_majors
from w join c using (k) join general using (k) join dept using (k)
""",
)
def keep_best_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 with J12: the winner's lists completed from the other versions; a lone record stays as it is."""
    none = F.struct(F.lit(None).cast("string").alias("standard"), F.lit(None).cast("int").alias("min_score"))
    subjects = F.struct(*[none.alias(s) for s in ("chinese", "english", "math_a", "math_b", "social", "science")])
    dept = F.struct(
        F.concat(F.lit(" d"), (F.col("o_orderkey") % 2).cast("string")).alias("department"),
        subjects.alias("subjects"),
        F.array("o_orderpriority").alias("majors"),
    )
    extraction = F.struct(
        F.lit("high").alias("confidence"),
        F.array(F.concat(F.lit(" "), "o_orderpriority"), "o_orderstatus", "o_orderstatus").alias("majors"),
        subjects.alias("general_requirements"),
        F.array(dept).alias("department_requirements"),
    )
    versions = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("school_id"),
        F.col("o_orderkey").alias("arrival"),
        F.lit("success").alias("status"),
        F.lit("official").alias("source"),
        F.lit("").alias("source_url"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("raw_text_length"),
        extraction.alias("extraction"),
    )
    best = dedupe.keep_best_results(versions)
    return best.select(
        F.col("school_id").alias("o_custkey"),
        F.array_join("extraction.majors", "|").alias("majors"),
        F.array_join(F.get("extraction.department_requirements", F.lit(0))["majors"], "|").alias("dept_majors"),
    )


@query(
    "source_quality",
    f"with {_EVENT} select event_id, cast(quality as integer) as quality from qual",
)
def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF14 per record."""
    rec = event_records(spark, sf_dir)
    return rec.select("event_id", dedupe.source_quality("source", "url", "len").alias("quality"))


@query(
    "best_attempt",
    f"""
with {_EVENT}
select user_id, k, event_id from (
  select *, row_number() over (partition by user_id, k order by
    case when k % 5 = 0 then 1 else 0 end desc,
    case when k % 5 in (0, 3, 4) then 1 else 0 end desc,
    case status when 'success' then 3 when 'not_found' then 2 else 1 end desc, event_id) as rn
  from qual) where rn = 1
""",
)
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same organisation, preferred source, then state; the first attempt wins ties."""
    from ..functions.standards import status_rank
    from ..functions.urls import domain_root, host, is_edu, is_gov

    h = host("url")
    rows = event_records(spark, sf_dir).withColumn("same_org", domain_root(h) == "a.edu.cn")
    rows = rows.withColumn("preferred", F.col("same_org") | is_edu(h) | is_gov(h))
    order = [
        F.col("same_org").cast("int").desc(),
        F.col("preferred").cast("int").desc(),
        status_rank("status").desc(),
        F.col("event_id").asc(),
    ]
    return dedupe.keep_best(rows, ["user_id", "k"], order).select("user_id", "k", "event_id")


@query(
    "ordered_unique",
    """
with v as (
  select user_id, event_type || '-' || (cast(json_extract(props, '$.k') as int) % 40) as v, min(event_id) as p
  from events group by 1, 2),
c as (select *, row_number() over (partition by user_id order by p, v) as rn from v)
select user_id, count(*) as n, string_agg(v, ',' order by rn) as items from c where rn <= 80 group by 1
""",
)
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrences in order, capped at 80 before collecting."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 40
    rows = ev.select("user_id", "event_id", F.concat("event_type", F.lit("-"), k.cast("string")).alias("v"))
    lists = dedupe.first_occurrence_lists(rows, ["user_id"], "v", ["event_id"], 80, "items")
    return lists.select("user_id", F.size("items").cast("bigint").alias("n"), F.array_join("items", ",").alias("items"))


@query(
    "list_caps",
    """
with w as (select p_partkey, string_split(case when list_contains(string_split(p_name, ' '), lower(p_type)) then p_name
  else p_name || ' ' || lower(p_type) end, ' ') as ws from part)
select p_partkey, cast(len(list_distinct(ws)) as integer) as n_all, ws[1] as first_word,
  array_to_string(ws[1:3], ' ') as capped from w
""",
)
def list_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two lists in order with a cap."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    more = F.concat(F.array(F.lower("p_type")), words)
    rows = part.select("p_partkey", merge_lists(words, more, 600).alias("m"))
    return rows.select(
        "p_partkey", F.size("m").alias("n_all"), F.get("m", F.lit(0)).alias("first_word"), F.array_join(F.slice("m", 1, 3), " ").alias("capped")
    )


@query(
    "donor_merge",
    """
with e as (
  select user_id, event_type as label, day(ts) <= 15 as first_half, event_id,
    'm' || (cast(json_extract(props, '$.k') as int) % 12) as v from events),
own as (select user_id, label, v, min(event_id) as p from e where first_half group by 1, 2, 3),
don as (select user_id, label, v, min(event_id) as p from e where not first_half group by 1, 2, 3),
rws as (select distinct user_id, label from own),
u as (
  select user_id, label, v, 0 as s, p from own
  union all
  select d.user_id, d.label, d.v, 1, d.p from don d join rws using (user_id, label)
    where not exists (select 1 from own o where o.user_id = d.user_id and o.label = d.label and o.v = d.v)),
r as (select *, row_number() over (partition by user_id, label order by s, p) as rn from u)
select user_id, label, string_agg(v, ',' order by rn) as merged from r where rn <= 200 group by 1, 2
""",
)
def donor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists per (record, label) completed from a donor record."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 12
    rows = ev.select(
        "user_id", F.col("event_type").alias("label"), (F.dayofmonth("ts") <= 15).alias("own"), "event_id",
        F.concat(F.lit("m"), k.cast("string")).alias("v"),
    )

    def lists(own: bool) -> DataFrame:
        side = rows.filter(F.col("own") == own)
        return dedupe.first_occurrence_lists(side, ["user_id", "label"], "v", ["event_id"], 200, "items")

    donors = lists(False).withColumn("pos", F.lit(0))
    merged = lookup.donor_lists(lists(True), donors, "user_id", "label", "pos", "items")
    return merged.select("user_id", "label", F.array_join("items", ",").alias("merged"))


# ---- lookups ------------------------------------------------------------------------------


@query(
    "left_lookup_default",
    """
with last as (
  select o_custkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
  from orders)
select c_custkey, coalesce(o_orderstatus, 'pending') as status,
  case when c_custkey % 3 = 0 then n_name when c_custkey % 3 = 1 then c_name else '' end as shown_name
from customer left join last on o_custkey = c_custkey and rn = 1
left join nation on n_nationkey = c_nationkey and c_custkey % 3 <> 2
""",
)
def left_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the latest record with a default, name with dimension fallback."""
    cust = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    latest = scans.top_per_key(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    results = latest.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("dim_key"), "n_name")
    key = F.col("c_custkey")
    rows = cust.select(
        "c_custkey",
        F.when(key % 3 == 1, F.col("c_name")).otherwise("").alias("shown_name"),
        F.when(key % 3 != 2, F.col("c_nationkey")).alias("dim_key"),
    )
    rows = lookup.with_status(rows, results, "c_custkey")
    return lookup.name_or_lookup(rows, nation, "dim_key", "shown_name", "n_name").select("c_custkey", "status", "shown_name")


_TIER = """case when sn < 4 then '985' when sn < 9 then '211' when sn < 12 then '双一流'
    when lang = 'fr' then '双一流' else '非双一流' end"""


@query(
    "label_sync",
    f"""
with d as (select doc_id, source, lang, cast(substr(source, 4) as int) as sn from documents)
select d.doc_id,
  case when l.doc_id is not null then case quality when 1 then '985' end else {_TIER} end as tier,
  case when l.doc_id is not null then case when toxic = 1 then 'online' else 'fallback_local' end else 'fallback_local' end as tier_source,
  case when l.doc_id is not null then coalesce(case when quality = 1 then true end, false) else sn % 2 = 0 end as taiwan_recognized
from d left join labels l using (doc_id)
""",
)
def label_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, J10, J11 parts: labels by key, computed fallback from reference sets (Q16)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels")
    n = F.substring("source", 4, 10).cast("int")
    names = docs.select(F.col("source").alias("name")).distinct().withColumn("n", F.substring("name", 4, 10).cast("int"))
    reference = names.filter("n < 12").select(
        "name",
        F.when(F.col("n") < 4, "985").when(F.col("n") < 9, "211").otherwise("双一流").alias("set_name"),
        F.when(F.col("n") < 4, 1).when(F.col("n") < 9, 2).otherwise(3).alias("precedence"),
    )
    typed = F.when(F.col("lang") == "fr", "双一流建设高校").otherwise("")
    rows = lookup.local_tier(docs, reference, "source", typed)
    rows = lookup.member_flag(rows, names.filter("n % 2 = 0").select("name"), "source", "listed")
    schools = labels.select(
        "doc_id",
        F.when(F.col("quality") == 1, "985").alias("tier"),
        F.when(F.col("toxic") == 1, "online").alias("tier_source"),
        F.when(F.col("quality") == 1, True).alias("taiwan_recognized"),
    )
    del n
    fallback = {"tier": F.col("local_tier"), "tier_source": F.lit("fallback_local"), "taiwan_recognized": F.col("listed")}
    return lookup.with_labels(rows, schools, "doc_id", fallback).select("doc_id", "tier", "tier_source", "taiwan_recognized")


@query(
    "tier_report",
    f"""
with d as (select case when sn < 4 then '985' when sn < 9 then '211' when sn < 12 then '双一流' else '非双一流' end as tier, lang = 'en' as rec
  from (select cast(substr(source, 4) as int) as sn, lang from documents))
select t.tier, (select count(*) from d where d.tier = t.tier) as n, (select count(*) from d where d.tier = t.tier and rec) as recognised
from (values ('985'), ('211'), ('双一流'), ('非双一流')) t(tier)
union all select 'total', count(*), count(*) filter (rec) from d
""",
)
def tier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    n = F.substring("source", 4, 10).cast("int")
    tier = F.when(n < 4, "985").when(n < 9, "211").when(n < 12, "双一流").otherwise("非双一流")
    schools = table(spark, sf_dir, "documents").select(tier.alias("tier"), (F.col("lang") == "en").alias("taiwan_recognized"))
    return label_ops.tier_report(schools)


@query(
    "skip_done",
    "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus <> 'P')",
)
def skip_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    done = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.not_done(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), done, "c_custkey")


@query(
    "known_only",
    "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)",
)
def known_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, P9."""
    dim = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return lookup.known_only(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), dim, "o_custkey")


@query(
    "catalog_fill",
    """
select l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  case when l_linenumber % 2 = 0 then 'line ' || l_linenumber else p_name end as p_name,
  p_brand as catalog_group, p_type as catalog_type
from lineitem left join part on p_partkey = l_partkey
""",
)
def catalog_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank names filled and catalogue columns attached."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        F.col("l_partkey").alias("p_partkey"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("line "), F.col("l_linenumber").cast("string")))
        .otherwise("  ")
        .alias("p_name"),
    )
    part = table(spark, sf_dir, "part")
    out = lookup.fill_from_catalog(rows, part, "p_partkey", "p_name", {"p_brand": "catalog_group", "p_type": "catalog_type"})
    return out.drop("p_partkey")


@query(
    "zip_lists",
    """
with l as (select conv_id, turn, string_split(text, ' ') as a, string_split(text, '. ') as b from conversations)
select conv_id, turn, cast(least(len(a), len(b)) as integer) as n_inner, cast(len(a) as integer) as n_left,
  a[1] || '=' || b[1] as first_pair, a[len(a)] || '=' || coalesce(case when len(b) >= len(a) then b[len(a)] end, 'none') as last_left
from l
""",
)
def zip_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairing by position, truncating and padding, inside each row."""
    conv = table(spark, sf_dir, "conversations")
    rows = conv.select("conv_id", "turn", F.split("text", " ").alias("a"), F.split("text", r"\. ").alias("b"))
    inner, left = lookup.zip_inner("a", "b"), lookup.zip_left("a", "b")
    rows = rows.select("conv_id", "turn", inner.alias("i"), left.alias("l"))
    last = F.element_at("l", -1)
    first_name, second_name = rows.schema["l"].dataType.elementType.fieldNames()
    return rows.select(
        "conv_id",
        "turn",
        F.size("i").alias("n_inner"),
        F.size("l").alias("n_left"),
        F.concat(F.get("i", F.lit(0))["a"], F.lit("="), F.get("i", F.lit(0))["b"]).alias("first_pair"),
        F.concat(last[first_name], F.lit("="), F.coalesce(last[second_name], F.lit("none"))).alias("last_left"),
    )


# ---- sets -----------------------------------------------------------------------------------


@query(
    "set_dimension",
    """
select k, src from (
  (select c_nationkey as k from customer union select s_nationkey from supplier) except
  (select n_nationkey from nation where n_regionkey = 3)
), (select 'set' as src)
""",
)
def set_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two key sets without the removed ones."""
    c_ = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    gone = table(spark, sf_dir, "nation").filter("n_regionkey = 3").select(F.col("n_nationkey").alias("k"))
    return sets.nested_set(c_, s, gone).withColumn("src", F.lit("set"))


@query(
    "year_union",
    """
with c as (select o_custkey, year(o_orderdate) as y from orders)
select o_custkey, string_agg(y, ',' order by y) as years from (
  select distinct o_custkey, y from c union select o_custkey, 1900 + cast(substr(o_orderpriority, 1, 1) as int) from orders)
group by 1
""",
)
def year_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted union of year lists, non-digits dropped. Values are distinct before they are collected."""
    orders = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate").cast("string")
    extra = (F.substring("o_orderpriority", 1, 1).cast("int") + 1900).cast("string")
    a = orders.groupBy("o_custkey").agg(F.collect_set(year).alias("a"), F.collect_set(extra).alias("b"))
    years = sets.merge_years("a", F.concat("b", F.array(F.lit("n/a"), F.lit(" 12x "))))
    return a.select("o_custkey", F.array_join(F.transform(years, lambda y: y.cast("string")), ",").alias("years"))


@query(
    "append_sources",
    """
select n_name as name, 'nation' as src, cast(n_regionkey as integer) as region from nation
union all select r_name, 'region', null from region
""",
)
def append_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: rows of several sources, missing columns null."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("src"), F.col("n_regionkey").alias("region"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("src"))
    return sets.append_sources([n, r])


@query(
    "union_by_url",
    """
with p as (select l_orderkey, l_linenumber, l_partkey % 50 as url from lineitem)
select l_orderkey, url, min(l_linenumber) as first_pos from p group by 1, 2
""",
)
def union_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link once per record at its first place."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("url"))
    return sets.union_by_url(li, ["l_orderkey"], "url", ["l_linenumber"]).select(
        "l_orderkey", "url", F.col("_first.o0").alias("first_pos")
    )


@query(
    "first_group_wins",
    """
select l_partkey, l_suppkey from (
  select l_partkey, l_suppkey, row_number() over (partition by l_partkey order by l_suppkey) as rn from lineitem) where rn = 1
""",
)
def first_group_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return stats.first_group_wins(li, "l_partkey", "l_suppkey")
