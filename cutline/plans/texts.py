"""Documents, pages and conversations: text rules, links, containment, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T, urls
from ..functions.expr import array_of, count_words
from ..operators import filters, labels, majors, matching, pages, scans, textrules
from ..operators.textrules import RuleVocabulary
from ..session import spread_table, table
from . import SQL, query

# ---- keywords and evidence ----------------------------------------------------------------

WORDS = ["The", "über", "ción", "est", "nicht", "zzz"]


@query(
    "keyword_hits",
    """
select doc_id, contains(lower(text), 'the') or contains(text, 'ción') as hit,
  cast(contains(text, 'The') as int) + cast(contains(text, 'über') as int) + cast(contains(text, 'ción') as int)
    + cast(contains(text, 'est') as int) + cast(contains(text, 'nicht') as int) + cast(contains(text, 'zzz') as int) as n_words,
  contains(lower(lang), 'de') or contains(lower(source), 'src1') as target
from documents
""",
)
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E14, J15, SF13 over whole texts."""
    docs = spread_table(spark, sf_dir, "documents")
    groups = {"a": ["DE", "src1"], "b": ["x"]}
    return docs.select(
        "doc_id",
        T.keyword_hit("text", ["The", "ción", " "]).alias("hit"),
        count_words("text", WORDS).alias("n_words"),
        matching.target_hit(F.array("lang"), F.array("source"), matching.group_keywords(groups, ["a"], ["DE"])).alias("target"),
    )


@query(
    "evidence_gate",
    """
with t as (
  select d.doc_id, source, n_chars, regexp_replace(text, '\\s+', '', 'g') as t, length(text) as len, text,
    coalesce(quality, 0) = 1 as good from documents d left join labels l using (doc_id)),
s as (
  select *, cast(contains(t, 'The') as int) + cast(contains(t, 'and') as int) + cast(contains(t, 'que') as int)
      + cast(contains(t, 'die') as int) + cast(contains(t, 'los') as int) as hits,
    source = 'src1' as same_org, source in ('src1', 'src2') as edu, contains(text, 'of the') as name_hit from t)
select doc_id, len >= 300 or (length(t) >= 30 and hits >= 2) as keep, good and hits >= 3 as review,
  cast(len + hits * 650 + case when same_org then 1800 else 0 end + case when edu then 1000 else 0 end
    + case when good then 600 else 0 end + case when name_hit then 700 + 900 else 0 end as integer) as score,
  len > 0 and (hits > 0 or (same_org and name_hit)) and (name_hit or same_org or hits >= 2) as usable,
  same_org or edu or name_hit as coherent_own, same_org or edu or good or name_hit as coherent
from s
""",
)
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, P16, X17, X27."""
    signals = ["The", "and", "que", "die", "los"]
    docs = spread_table(spark, sf_dir, "documents")
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(quality, "doc_id", "left").withColumn("good", F.coalesce(F.col("quality") == 1, F.lit(False)))
    hits = count_words(F.regexp_replace("text", r"(?U)\s+", ""), signals)
    rows = rows.withColumn("hits", hits)
    same, edu, name = F.col("source") == "src1", F.col("source").isin("src1", "src2"), F.col("text").contains("of the")
    no = F.lit(False)
    return rows.select(
        "doc_id",
        filters.keep_page("text", 300, words=signals).alias("keep"),
        textrules.review_flag(F.col("good"), no, "text", signals).alias("review"),
        textrules.search_score(F.length("text"), F.col("hits"), same, edu, F.col("good"), no, name, name).alias("score"),
        textrules.usable_hit(F.length("text"), F.col("hits"), same, name).alias("usable"),
        filters.coherent_source(same, edu, F.col("good"), no, name, F.lit(True)).alias("coherent_own"),
        filters.coherent_source(same, edu, F.col("good"), no, name, F.lit(False)).alias("coherent"),
    )


@query(
    "custom_keywords",
    """
with w as (
  select conv_id, turn, unnest(string_split_regex(trim(text, E' \\t\\n\\r'), '\\s+')) as w, generate_subscripts(string_split_regex(trim(text, E' \\t\\n\\r'), '\\s+'), 1) as i
  from conversations),
c as (select *, trim(regexp_replace(w, '[,;/\\\\|]+', '', 'g')) as k from w),
f as (select conv_id, turn, lower(k) as lk, arg_min(k, i) as k, min(i) as i from c where k <> '' group by 1, 2, 3)
select conv_id, turn, cast(count(*) as integer) as n, string_agg(k, ' ' order by i) as keywords from f group by 1, 2
""",
)
def custom_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF30: words of every turn, first of each case-folded form."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.custom_keywords("text").alias("k"))
    return conv.filter(F.size("k") > 0).select("conv_id", "turn", F.size("k").alias("n"), F.array_join("k", " ").alias("keywords"))


# ---- containment and domains ---------------------------------------------------------------

_NORM = "regexp_replace(replace(replace(replace({x}, '（', '('), '）', ')'), '·', ''), '\\s+', '', 'g')"


@query(
    "contains_join",
    f"""
with a as (select item_id, {_NORM.format(x='text')} as n from benchmark),
b as (select item_id, n, regexp_replace(n, '\\([^)]*\\)', '', 'g') as base from a),
d as (select doc_id, {_NORM.format(x='text')} as t from documents)
select doc_id, item_id from d join b on (length(n) >= 4 and contains(t, n)) or (length(base) >= 4 and contains(t, base))
""",
)
def contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, SF15, SF16: which names occur in which texts; the strategy follows the checked size of the names."""
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", T.match_text("text").alias("t"))
    names = table(spark, sf_dir, "benchmark").select("item_id", "text")
    aliases = names.select("item_id", F.explode(T.name_aliases("text")).alias("alias"))
    return matching.contains_join(docs, "doc_id", "t", aliases, "item_id", "alias")


@query("contains_join_grams", SQL["contains_join"])
def contains_join_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 by the way that names beyond the bound take: grams, whatever their number."""
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", T.match_text("text").alias("t"))
    aliases = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.name_aliases("text")).alias("alias"))
    return matching.contains_join(docs, "doc_id", "t", aliases, "item_id", "alias", max_aliases=0)


@query(
    "domain_join",
    """
with h as (
  select page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) as host from pages),
d as (select distinct regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') as dom
      from pages where url like 'https://www.%' or url like 'https://blog.%')
select page_id, host, exists (select 1 from d where host = dom or host like '%.' || dom or dom like '%.' || host) as matched
from h
""",
)
def domain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, SF17: hosts equal to, below or above an authority domain, by two equi-joins."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", urls.host("url").alias("host"))
    domains = p.filter(F.col("url").startswith("https://www.") | F.col("url").startswith("https://blog.")).select(
        urls.host("url", drop_www=True).alias("domain")
    )
    good = matching.domain_matches(p, "host", domains, "domain").withColumn("matched", F.lit(True))
    return p.join(good, "host", "left").select("page_id", "host", F.coalesce("matched", F.lit(False)).alias("matched"))


# ---- pages -----------------------------------------------------------------------------------

_NOISE = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in pages.NOISE_TAGS)


@query(
    "page_text",
    f"""
with c as (select page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', chr(10), 'g'), '(?is){_NOISE}', chr(10), 'g') as h from pages),
r as (select page_id, coalesce(nullif(regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1), ''), h) as h from c),
p as (select page_id, regexp_replace(h, '(?s)<[^>]*>', chr(10), 'g') as h from r),
e as (select page_id, replace(replace(replace(replace(h, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as h from p)
select page_id, array_to_string(list_filter(list_transform(string_split_regex(h, '[\\n\\r]'), lambda x: trim(x, E' \\t\\n\\r')), lambda x: x <> ''), chr(10)) as main_text
from e
""",
)
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, JVM-side."""
    return pages.page_text(spread_table(spark, sf_dir, "pages"), "html", "main_text").select("page_id", "main_text")


_LINKS = """
raw as (
  select page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b([^>]*)>(.*?)</a\\s*>', 1)) as attrs,
    unnest(regexp_extract_all(html, '(?is)<a\\b([^>]*)>(.*?)</a\\s*>', 2)) as inner_html,
    generate_subscripts(regexp_extract_all(html, '(?is)<a\\b([^>]*)>', 1), 1) - 1 as pos
  from pages),
lk0 as (
  select page_id, pos, url, trim(regexp_extract(attrs, '(?is)(?:^|\\s)href\\s*=\\s*"([^"]*)"', 1)) as href,
    trim(replace(replace(replace(replace(regexp_replace(inner_html, '(?s)<[^>]*>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) as txt
  from raw),
lk as (
  select page_id, pos, href, txt,
    case when href like '/%' then regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href else href end as link_url
  from lk0 where href <> ''),
first as (
  select * from (select *, row_number() over (partition by page_id, link_url order by pos) as rn from lk) where rn = 1)
"""
LINK_RULES = [
    ("combo", ["The", "la"], 4),
    ("text", ["de", "und", "y"], 3),
    ("attachment", ["in", ".pdf"], 2),
    ("href", ["the,", "est"], -5),
]


@query(
    "page_links_scored",
    f"""
with {_LINKS},
s as (
  select *, case when contains(txt || ' ' || href, 'The') or contains(txt || ' ' || href, 'la') then 4 else 0 end
    + case when contains(txt, 'de') or contains(txt, 'und') or contains(txt, 'y') then 3 else 0 end
    + case when contains(lower(href), 'in') or contains(lower(href), '.pdf') then 2 else 0 end
    + case when contains(lower(href), 'the,') or contains(lower(href), 'est') then -5 else 0 end
    + case when contains(txt, 'o') then 2 else 0 end as score
  from first)
select page_id, link_url, cast(score as integer) as score from (
  select *, row_number() over (partition by page_id order by score desc, pos) as rk from s where score >= 3) where rk <= 3
""",
)
def page_links_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3, T3, SF20: links by additive score, best three of each page."""
    links = pages.anchors(spread_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    scored = pages.scored_links(links, "page_id", LINK_RULES, F.col("link_text").contains("o"), threshold=3, top=3)
    return scored.select("page_id", "link_url", "score")


@query(
    "page_attachments",
    f"""
with {_LINKS},
k as (select * from lk where contains(lower(href), '.doc') or contains(lower(href), 'th') or contains(txt || href, 'La'))
select page_id, min(pos) as pos, link_url from k group by 1, 3
""",
)
def page_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachment or keyword links, each URL once per page."""
    links = pages.anchors(spread_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    kept = pages.attachment_links(links, "page_id", ["La"], [".doc"], ["th"])
    return kept.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link_url")


@query(
    "authority_domains",
    """
with u as (select unnest(regexp_extract_all(html || ' ' || url, '(https?://[^\\s\\)）]+)', 1)) as u from pages)
select distinct regexp_replace(split_part(lower(regexp_extract(u, '^https?://([^/?#]*)', 1)), ':', 1), '^www\\.', '') as domain from u
where lower(regexp_extract(u, '^https?://([^/?#]*)', 1)) <> ''
""",
)
def authority_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X25."""
    p = spread_table(spark, sf_dir, "pages")
    return pages.authority_domains(p, F.concat("html", F.lit(" "), "url"))


@query(
    "url_filters",
    """
with b as (
  select page_id, url, md5(url) as id, regexp_extract(url, '^https?://([^/?#]*)', 1) as host, page_id % 4 as k from pages)
select page_id,
  case k when 0 then url when 1 then 'https://' || regexp_replace(url, '^https?://', '') else url end as clean,
  regexp_extract(host, '([^.]+\\.[^.]+)$', 1) as root,
  case k when 0 then id when 1 then id when 2 then id else '' end as content_id,
  case when k = 3 then 112 else 0 end as year,
  case when k = 2 then url else 'http://o.cn/z' end as fetch,
  case when k = 0 then 'http://a/x.png' else 'http://a/x.png,http://b/y.JPG' end as images,
  case when k = 1 then 'ColQry_115apply_z' else 'ColQry_115x' end as sys_dir
from b
""",
)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14, SF17, SF21, SF32, SF33."""
    p = table(spark, sf_dir, "pages").withColumn("k", F.col("page_id") % 4).withColumn("id", F.md5("url"))
    k, url = F.col("k"), F.col("url")
    mixed = (
        F.when(k == 0, F.concat(F.lit(" 官网（"), url, F.lit(' "')))
        .when(k == 1, F.concat(F.lit("//"), F.regexp_replace(url, "^https?://", ""), F.lit("；")))
        .otherwise(F.concat(url, F.lit("。")))
    )
    page = F.when(k == 1, F.concat(F.lit("contentId = $.getAddrUrl('id')||'"), F.col("id"), F.lit("';"))).when(
        k == 2, F.concat(F.lit('<a href="/v?id='), F.col("id"), F.lit('">'))
    ).otherwise("<p>")
    with_id = F.when(k == 0, F.concat(F.lit("https://x.cn/p?a=1&contentId="), F.col("id"))).otherwise("https://x.cn/p?id=12")
    report = F.when(k == 3, "https://x.cn/apply_his_report/112/a.htm").otherwise("https://x.cn/112/")
    source = F.when(k == 2, F.concat(F.lit(" "), url)).otherwise("  ")
    images = F.when(k == 0, array_of(["http://a/x.png", "http://a/logo.png", "http://a/x.gif"])).otherwise(
        array_of(["http://a/x.png", "http://b/y.JPG", "http://b/icon.jpg"])
    )
    query_page = F.when(k == 1, "./system/ColQry_115apply_z/QrybyStu").otherwise("./system/ColQry_115x/QrybyStu")
    return p.select(
        "page_id",
        urls.clean_url(mixed).alias("clean"),
        urls.domain_root(urls.host(url)).alias("root"),
        urls.content_id(with_id, page).alias("content_id"),
        urls.path_year(report).alias("year"),
        urls.fetch_url(source, F.lit("http://o.cn/z ")).alias("fetch"),
        F.array_join(urls.image_candidates(images), ",").alias("images"),
        urls.system_dir(query_page, 115, "apply").alias("sys_dir"),
    )


@query("url_unwrap", "select page_id, url as target, case when page_id % 3 = 0 then 'https://x.org/ck/a?u=1' else url end as second from pages")
def url_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF19: redirect links built from every page URL and taken apart again."""
    p = table(spark, sf_dir, "pages")
    b64 = F.rtrim(F.translate(F.base64(F.encode("url", "utf-8")), "+/\r\n", "-_"))
    b64 = F.regexp_replace(b64, "=+$", "")
    head = F.lit("https://www.bing.com/ck/a?!&p=1&u=")
    wrapped = F.concat(head, F.when(F.col("page_id") % 2 == 0, "a1").otherwise("a"), b64, F.lit("&ntb=1"))
    plain = F.concat(F.lit("https://www.bing.com/ck/a?r="), F.url_encode("url"))
    second = F.when(F.col("page_id") % 3 == 0, "https://x.org/ck/a?u=1").otherwise(plain)
    return p.select("page_id", urls.unwrap_redirect(wrapped).alias("target"), urls.unwrap_redirect(second).alias("second"))


# ---- rules -----------------------------------------------------------------------------------


@query(
    "json_repair",
    """
select event_id, case when k % 6 = 4 then null else k end as k, case when k % 6 in (2, 5) then 1 end as extra, k % 6 <> 4 as readable
from (select event_id, cast(json_extract(props, '$.k') as integer) as k from events)
""",
)
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced, wordy, comma-damaged and broken texts (Q15)."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.regexp_replace("props", r"\}$", "")
    raw = (
        F.when(k % 6 == 0, F.col("props"))
        .when(k % 6 == 1, F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```\nbye }")))
        .when(k % 6 == 2, F.concat(body, F.lit(', "o": {"a": 1}\n "x": 1}')))
        .when(k % 6 == 3, F.concat(F.lit("answer "), body, F.lit(",} ok")))
        .when(k % 6 == 4, F.concat(body, F.lit(', "o": [}')))
        .otherwise(F.concat(body, F.lit(', "o": [1,2]\n"x": 1, }')))
    )
    fixed = ev.select("event_id", textrules.repaired_json(raw).alias("j"))
    fields = F.from_json("j", "k int, x int")
    return fixed.select("event_id", fields["k"].alias("k"), fields["x"].alias("extra"), F.col("j").isNotNull().alias("readable"))


LATIN = {"the": "chinese", "and": "english", "of": "math_a", "in": "math_b", "that": "social", "with": "science"}
LATIN_STANDARDS = ["ing", "ed", "ly", "st", "on"]
LATIN_CHOICE = ["ion", "able"]


def _latin_detect(value: Column) -> Column:
    return F.array_compact(F.array(*[F.when(value.contains(w), F.lit(k)) for w, k in LATIN.items()]))


def _latin_standard(value: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for s in LATIN_STANDARDS:
        out = out.when(value.contains(s), F.lit(s))
    return out


LATIN_VOCABULARY = RuleVocabulary(
    subjects=LATIN,
    standards=LATIN_STANDARDS,
    joins="[,.]?",
    reach="er",
    any_prefix="*",
    choice_subjects=list(LATIN),
    choice_words=LATIN_CHOICE,
    stops=".;",
    unit="",
    unit_full="",
    pair_pattern=None,
    detect=_latin_detect,
    detect_standard=_latin_standard,
    has_choice=lambda v: v.contains("ion") | v.contains("able"),
)

_S = "the|and|of|in|that|with"
_STD = "ing|ed|ly|st|on"


def _rule_sql() -> str:
    std, fold, score = [], [], []
    for word, key in LATIN.items():
        std.append(
            f"coalesce(regexp_extract(list_filter(ph, lambda p: contains(p, '{word}'))[-1], '({_STD})$', 1), '') as s_{key}"
        )
        raised = (
            f"case when contains(p, '{word}') and (a = '' or a = regexp_extract(p, '({_STD})$', 1)) "
            f"then '*' || regexp_extract(p, '({_STD})$', 1) else a end"
        )
        fold.append(
            f"case when len(cm) > 0 then list_reduce(list_concat([s_{key}], cm), lambda a, p: {raised}) "
            f"when loose <> '' and ch and contains(t, '{word}') and (s_{key} = '' or s_{key} = loose) then '*' || loose "
            f"else s_{key} end as f_{key}"
        )
        score.append(
            f"list_filter(list_zip(n1 || n2, v1 || v2), lambda z: z[1] = '{word}' and cast(z[2] as int) between 1 and 15)[-1][2] as m_{key}"
        )
    keys = list(LATIN.values())
    detect = "case " + " ".join(f"when contains(t, '{s}') then '{s}'" for s in LATIN_STANDARDS) + " end"
    first = "coalesce(" + ", ".join(f"nullif(s_{k}, '')" for k in keys) + ")"
    shown = " || '|' || ".join(f"f_{k} || coalesce('(' || cast(cast(m_{k} as int) as varchar) || ')', '')" for k in keys)
    return f"""
with t as (select doc_id, regexp_replace(text, '\\s+', '', 'g') as t from documents),
a as (
  select *, regexp_extract_all(t, '(?:{_S})(?:[,.]?(?:{_S}))*er(?:{_STD})', 0) as ph,
    regexp_extract_all(t, '(?:{_S})[^.;]{{0,40}}?(?:ion|able)[^.;]{{0,20}}?(?:{_STD})', 0) as cm,
    regexp_extract_all(t, '({_S})[:：]?([0-9]{{1,2}})', 1) as n1, regexp_extract_all(t, '({_S})[:：]?([0-9]{{1,2}})', 2) as v1,
    regexp_extract_all(t, '({_S}).*?([0-9]{{1,2}})', 1) as n2, regexp_extract_all(t, '({_S}).*?([0-9]{{1,2}})', 2) as v2,
    contains(t, 'ion') or contains(t, 'able') as ch
  from t),
b as (select *, {', '.join(std)} from a),
c as (select *, coalesce({detect}, {first}, '') as loose from b),
d as (select doc_id, {', '.join(fold)}, {', '.join(score)} from c)
select doc_id, {shown} as subjects from d
"""


@query("text_rules", _rule_sql())
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13-X15, SF2, SF6: the rule chain over whole documents with a Latin vocabulary."""
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("none", textrules.empty_subjects())
    out = textrules.rule_subjects(docs, "none", "text", "subjects", LATIN_VOCABULARY)
    parts = []
    for key in LATIN.values():
        s = F.col("subjects")[key]
        score = F.coalesce(F.concat(F.lit("("), s["min_score"].cast("string"), F.lit(")")), F.lit(""))
        parts.append(F.concat(F.coalesce(s["standard"], F.lit("")), score))
    return out.select("doc_id", F.concat_ws("|", *parts).alias("subjects"))


@query(
    "context_groups",
    """
select doc_id, case doc_id % 5 when 0 then 'chinese+english' when 1 then 'math_a+math_b' when 2 then 'chinese+english+math_a+math_b'
  when 3 then 'chinese|social+science' else '' end as groups from documents
""",
)
def context_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X20, SF6, SF7, U8: any-of groups in whole texts that carry a requirement sentence."""
    tails = [
        "。国文、英文 任一科达均标；英文或国文择一。",
        "（数学A/B 其一）",
        "四科中任意两科",
        "国文任一；社会、自然择一；自然或社会之一",
        "国文与英文均需达标",
    ]
    docs = spread_table(spark, sf_dir, "documents")
    tail = F.get(array_of(tails), (F.col("doc_id") % 5).cast("int"))
    groups = docs.select("doc_id", T.context_groups(F.concat("text", tail)).alias("g"))
    shown = F.array_join(F.transform("g", lambda g: F.array_join(g, "+")), "|")
    return groups.select("doc_id", shown.alias("groups"))


@query(
    "token_lists",
    """
with s as (select doc_id, translate(trim(text, E' \\t\\n\\r'), '，,/\\；;|｜', '、、、、、、、、') as s from documents),
l as (select doc_id, string_split(regexp_replace(s, '^\\(?[一二三四五六七八九十0-9]+\\)?[、.．]\\s*', ''), '、') as l from s),
u as (select doc_id, trim(unnest(l), E' \\t\\n\\r') as tok, generate_subscripts(l, 1) as i from l),
f as (select doc_id, tok, min(i) as i from u where tok <> '' group by 1, 2),
r as (select *, row_number() over (partition by doc_id order by i) as rn from f)
select doc_id, count(*) as n_tokens, cast(sum(length(tok)) as bigint) as chars, max(tok) filter (rn = 1) as first_token
from r group by 1
""",
)
def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF9, W8: list tokens of whole documents, first occurrences."""
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", T.split_tokens("text").alias("toks"))
    rows = docs.withColumn("toks", F.array_distinct("toks")).filter(F.size("toks") > 0)
    total = F.aggregate("toks", F.lit(0).cast("bigint"), lambda a, t: a + F.length(t))
    return rows.select(
        "doc_id", F.size("toks").cast("bigint").alias("n_tokens"), total.alias("chars"), F.get("toks", F.lit(0)).alias("first_token")
    )


_LINES = """list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)),
    lambda x: trim(x, E' \\t\\n\\r')), lambda x: x <> '')"""


@query(
    "major_lists",
    f"""
with l as (
  select doc_id, length(text) as chars, len({_LINES}) as n, unnest({_LINES}) as line, generate_subscripts({_LINES}, 1) - 1 as pos
  from documents),
m as (select *, contains(line, 'the') as h, bool_or(contains(line, 'the')) over (partition by doc_id) as a from l),
p as (
  select *, max(case when h then pos end) over (partition by doc_id order by pos) as last,
    max(case when h then pos end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as prev,
    min(case when h then pos end) over (partition by doc_id order by pos rows between 1 following and unbounded following) as nxt
  from m where a or chars < 1500),
w as (
  select *, sum(case when h and (prev is null or pos > least(prev + 220, n) + 10) then 1 else 0 end)
      over (partition by doc_id order by pos) as win from p),
f as (
  select *, contains(line, 'with') as hd, string_split(line, ' ') as toks from w
  where case when a then last is not null and (pos < least(last + 220, n) or coalesce(nxt <= least(last + 220, n) + 10, false))
        else pos < 220 end),
g as (
  select *, min(case when hd or len(list_filter(toks, lambda t: not regexp_full_match(t, '[0-9]+'))) > 0 then pos end)
      over (partition by doc_id, win) as hit from f),
k as (
  select *, min(case when contains(line, 'and') and regexp_matches(line, '^[A-M]') and pos > hit then pos end)
      over (partition by doc_id, win) as cut from g),
t as (
  select doc_id, win, pos, hd, unnest(case when hd then [''] else toks end) as raw,
    generate_subscripts(case when hd then [''] else toks end, 1) as tp
  from k where cut is null or pos < cut),
c as (select *, regexp_replace(raw, '[.,;]+$', '') as name, hd or regexp_full_match(raw, '[0-9]+') as brk from t),
e as (
  select *, not brk and length(name) >= 9 as ok, not brk and length(name) = 2 as frag,
    row_number() over (partition by doc_id, win order by pos, tp) as seq from c),
i as (select *, sum(case when frag then 0 else 1 end) over (partition by doc_id, win order by seq) as isl from e),
r as (select *, seq - min(seq) over (partition by doc_id, win, isl) as off from i where frag),
j as (
  select doc_id, win, min(seq) as seq, regexp_replace(string_agg(name, '' order by seq), '[.,;]+$', '') as name
  from r group by doc_id, win, isl, off // 6 having count(*) >= 2),
v as (select doc_id, win, seq, name from e where ok union all select doc_id, win, seq, name from j where length(name) >= 9),
u as (select doc_id, name, min(win * 100000000 + seq) as o from v group by 1, 2),
x as (select *, row_number() over (partition by doc_id order by o) as rn from u)
select doc_id, cast(count(*) as integer) as n, string_agg(name, ',' order by rn) as majors from x where rn <= 400 group by 1
""",
)
def major_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8 over whole documents with a Latin vocabulary: windows after hint lines, section
    stops, fragment joining, ordered unique names with a cap."""
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", "text")
    lists = latin_majors(docs)
    return lists.select("doc_id", F.size("majors").alias("n"), F.array_join("majors", ",").alias("majors"))


def latin_majors(docs: DataFrame) -> DataFrame:
    return majors.majors_from_text(
        docs,
        "doc_id",
        "text",
        hints=["the"],
        stops=["and"],
        headers=["with"],
        heading=r"^[A-M]",
        number_token=r"^[0-9]+$",
        sentence=None,
        tokens=lambda line: F.split(line, " "),
        normalise=lambda t: F.regexp_replace(t, "[.,;]+$", ""),
        plausible=lambda s: F.length(s) >= 9,
        fragment=lambda s: F.length(s) == 2,
    )


@query(
    "section_cut",
    """
with l as (select doc_id, string_split(text, chr(10)) as ls from documents),
h as (select *, list_position(list_transform(ls, lambda x: contains(x, 'the')), true) as h from l),
c as (
  select *, list_position(list_transform(ls, lambda x, i: i > h and length(x) < 200 and contains(x, 'ed')), true) as cut from h)
select doc_id, cast(len(case when cut > 0 then ls[1:cut - 1] else ls end) as integer) as kept,
  cast(coalesce(list_sum(list_transform(case when cut > 0 then ls[1:cut - 1] else ls end, lambda x: length(x))), 0) as bigint) as chars
from c
""",
)
def section_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W14 inside every document: lines up to the first stop line after a hit line."""
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    kept = scans.cut_lines(
        F.col("ls"), lambda x: x.contains("the"), lambda x: (F.length(x) < 200) & x.contains("ed")
    )
    rows = docs.select("doc_id", kept.alias("k"))
    chars = F.aggregate("k", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return rows.select("doc_id", F.size("k").alias("kept"), chars.alias("chars"))


@query(
    "first_urls",
    """
select page_id, case when page_id % 2 = 0 then url else 'none' end as first_url from pages
""",
)
def first_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF18."""
    p = table(spark, sf_dir, "pages")
    mixed = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" 见 "), "url", F.lit("）. ").substr(2, 1), F.lit("; more"))).otherwise(" none ")
    return p.select("page_id", T.first_url(mixed).alias("first_url"))


# ---- label sync --------------------------------------------------------------------------------


@query(
    "label_sync_full",
    f"""
with school as (
  select b.item_id, text as name, url, case when item_id % 4 = 0 then '双一流建设' else '' end as type
  from benchmark b left join pages on page_id = item_id),
n as (select item_id, {_NORM.format(x='name')} as n from school),
d as (select case lang when 'en' then 'en' when 'de' then 'de' else 'other' end as lang, {_NORM.format(x='text')} as t from documents),
m as (
  select distinct item_id, lang from n join d
    on contains(t, n) or (length(regexp_replace(n, '\\([^)]*\\)', '', 'g')) >= 4 and contains(t, regexp_replace(n, '\\([^)]*\\)', '', 'g')))),
f as (select item_id, bool_or(lang = 'en') as i985, bool_or(lang = 'de') as i211, bool_or(lang = 'other') as isyl from m group by 1),
h as (select item_id, nullif(regexp_replace(split_part(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), ':', 1), '^www\\.', ''), '') as host from school),
dom as (select distinct regexp_replace(split_part(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), ':', 1), '^www\\.', '') as d
        from pages),
x as (
  select s.item_id, coalesce(i985, false) as a, coalesce(i211, false) as b, coalesce(isyl, false) as c,
    s.item_id % 7 = 0 as loc, s.type like '%双一流%' as typed, s.item_id % 5 = 0 as listed,
    host is not null and exists (select 1 from dom where host = d or host like '%.' || d or d like '%.' || host) as bydom
  from school s left join f using (item_id) left join h using (item_id))
select item_id, case when a then '985' when b then '211' when c then '双一流' when loc then '211' when typed then '双一流' else '非双一流' end as tier,
  case when a then 'online_moe_985' when b then 'online_moe_211' when c then 'online_moe_shuangyiliu' else 'fallback_local' end as tier_source,
  bydom or listed as taiwan_recognized,
  case when not bydom and listed then 'fallback_local' else 'online_tw_moe_domain' end as taiwan_source
from x
""",
)
def label_sync_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authority texts and domains to labels of every institution."""
    docs = spread_table(spark, sf_dir, "documents")
    bench = table(spark, sf_dir, "benchmark")
    p = spread_table(spark, sf_dir, "pages")
    schools = bench.join(p.select(F.col("page_id").alias("item_id"), "url"), "item_id", "left").select(
        "item_id",
        F.col("text").alias("name"),
        F.when(F.col("item_id") % 4 == 0, "双一流建设").otherwise("").alias("type"),
        F.col("url").alias("zsjz_url"),
    )
    set_name = F.when(F.col("lang") == "en", "985").when(F.col("lang") == "de", "211").otherwise("双一流")
    texts = docs.select(set_name.alias("set_name"), "text")
    matched = labels.authority_sets(schools, "name", texts, "set_name", "text")
    reference = schools.filter("item_id % 7 = 0").select("name", F.lit("211").alias("set_name"), F.lit(2).alias("precedence"))
    recognised = schools.filter("item_id % 5 = 0").select("name")
    domain_texts = p.select("url")
    out = labels.label_schools(schools, matched, domain_texts, "url", reference, recognised)
    return out.select("item_id", "tier", "tier_source", "taiwan_recognized", "taiwan_source")


