"""Stored records of any shape, built from the events, and their normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid, text as text_rules, vocab as V
from ..operators import pages, refsets, textrules
from ..session import dealt, spread_table, table
from . import query

# Subject words by event type and standards by the cents of the value; the table's values pick every word.
TYPES = ["view", "click", "signup", "error", "purchase"]
WORDS = ["国文", "英文", "数学A", "社会", "自然"]
WORD_KEYS = ["chinese", "english", "math_a", "social", "science"]
STANDARDS = ["顶标", "前标", "均标", "后标", "底标"]


def _list_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _subject_sql(prefix: str, cases: list[tuple[str, str]]) -> str:
    """One text ``key=standard:score`` for the subjects that have a standard, in the order of the keys."""
    parts = []
    for key in V.SUBJECT_KEYS:
        picked = " ".join(f"when {test.format(key=key)} then {value}" for test, value in cases)
        parts.append(f"'{key}=' || case {picked} end")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x is not null), ' ') as {prefix}"


# What each form says, without the operator's steps: f is the form of the first department, r that of the record.
_SQL = f"""
with e as (
  select event_id, cast(json_extract_string(props, '$.k') as integer) as k, cast(round(value * 100) as bigint) as cents,
    list_position({_list_sql(TYPES)}, event_type) - 1 as a
  from events
), i as (
  select *, (a + 1 + k % 4) % 5 as b, cents % 5 as s, (cents % 5 + 1 + k % 4) % 5 as t, k % 9 as f, cents // 5 % 8 as r from e
), w as (
  select event_id, k, f, r, least(s, t) as m, s, t,
    {_list_sql(WORD_KEYS)}[a + 1] as a, {_list_sql(WORD_KEYS)}[b + 1] as b,
    {_list_sql(STANDARDS)}[s + 1] as sw, {_list_sql(STANDARDS)}[t + 1] as tw, {_list_sql(STANDARDS)}[least(s, t) + 1] as mw
  from i
), d as (
  select *, {_subject_sql("shaped", [
      ("f = 0 and a = '{key}'", "sw || ':' || k"),
      ("f = 1 and '{key}' in (a, b)", "sw || ':'"),
      ("f = 2 and '{key}' in (a, b)", "'任一' || sw || ':'"),
      ("f = 4 and '{key}' in (a, b)", "'任一' || sw || ':'"),
      ("f = 6 and b = '{key}'", "tw || ':'"),
      ("f = 7 and b = '{key}'", "tw || ':'"),
      ("f = 7 and a = '{key}'", "mw || ':'"),
      ("f = 8 and a = '{key}'", "tw || ':'"),
      ("f = 8 and b = '{key}'", "'任一' || sw || ':'"),
  ])}, {_subject_sql("whole", [
      ("r in (0, 6) and a = '{key}'", "sw || ':' || k"),
      ("r = 7 and a = '{key}'", "'任一' || sw || ':'"),
      ("r = 7 and b = '{key}'", "'任一' || sw || ':'"),
  ])}
  from w
)
select event_id, case when r in (3, 4) then '提取结构异常' end as error, case when r in (3, 4) then 'low' else 'high' end as confidence,
  whole as general, cast(case when r in (3, 4, 5) then 0 when f = 6 then 1 else 2 end as integer) as departments,
  case when r not in (3, 4, 5) then shaped end as first_subjects,
  case when r in (3, 4, 5) then null when f = 1 then sw when f = 2 then '任一科' || sw || '即可' when f = 5 then 'n' || k
    when f = 8 then case a when 'chinese' then '国文' when 'english' then '英文' when 'math_a' then '数学A' when 'social' then '社会' else '自然' end
      || '、' || case b when 'chinese' then '国文' when 'english' then '英文' when 'math_a' then '数学A' when 'social' then '社会' else '自然' end
      || '任一科达到' || sw
    when f = 7 then sw end as first_notes
from d
"""


def _obj(**fields: Column) -> Column:
    """JSON object of fields that are JSON texts already."""
    parts: list[Column] = []
    for name, value in fields.items():
        parts += [F.lit((", " if parts else "") + f'"{name}": '), value]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _quoted(*parts: Column | str) -> Column:
    return F.concat(F.lit('"'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit('"'))


def _subjects(key: Column, standard: Column, score: Column) -> Column:
    return F.concat(F.lit('{"'), key, F.lit('": {"standard": "'), standard, F.lit('", "min_score": '), score, F.lit("}}"))


def _one_of(index: Column, words: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), index.cast("int") + 1)


def raw_records(events: DataFrame) -> DataFrame:
    """One stored record per event as text: nine forms of a department, eight of a record, most of them damaged."""
    k = F.get_json_object("props", "$.k").cast("int")
    cents = F.round(F.col("value") * 100).cast("bigint")
    a = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")) - 1
    e = events.select("event_id", k.alias("k"), cents.alias("c"), a.alias("a"))
    e = e.select("*", ((F.col("a") + 1 + F.col("k") % 4) % 5).alias("b"), (F.col("c") % 5).alias("s"))
    e = e.withColumn("t", (F.col("s") + 1 + F.col("k") % 4) % 5)
    wa, wb = _one_of(F.col("a"), WORDS), _one_of(F.col("b"), WORDS)
    ka, kb = _one_of(F.col("a"), WORD_KEYS), _one_of(F.col("b"), WORD_KEYS)
    sw, tw = _one_of(F.col("s"), STANDARDS), _one_of(F.col("t"), STANDARDS)
    score, null = F.col("k").cast("string"), F.lit("null")
    any_of = _quoted(wa, "、", wb, "任一科达到", sw)
    named = _quoted(wa, "、", wb)
    first = [
        _obj(subjects=F.concat(F.lit('{"'), ka, F.lit('": {"standard": "'), sw, F.lit('", "min_score": '), score, F.lit('}, "'), kb, F.lit('": "x"}'))),
        _obj(subjects=named, level=_quoted(sw)),
        _obj(subjects=named, level=null, notes=_quoted("任一科", sw, "即可")),
        _obj(department=_quoted("d"), requirement=_quoted(wa, "达", sw)),
        _obj(subjects=null, requirement=any_of),
        _obj(subjects=F.lit("[1]"), notes=_quoted("n", score)),
        _quoted(wa, "、", wb),
        _obj(subjects=_quoted(wa), level=_quoted(sw), other_requirement=_quoted(wb, tw)),
        _obj(subjects=_subjects(ka, tw, null), notes=any_of),
    ]
    dept = F.element_at(F.array(*first), F.col("k") % 9 + 1)
    depts = F.concat(F.lit("["), dept, F.lit(", "), _obj(subjects=_subjects(kb, tw, null)), F.lit("]"))
    general, top = _subjects(ka, sw, score), {"found": F.lit("true"), "confidence": _quoted("high")}
    whole = _obj(**top, general_requirements=general, department_requirements=depts)

    records = [
        whole,
        _obj(**top, general_requirements=F.lit("[]"), department_requirements=depts),
        _obj(**top, general_requirements=_quoted(wa, sw), department_requirements=depts),
        F.concat(F.lit("["), _quoted(wa), F.lit(", "), _quoted(sw), F.lit("]")),
        F.concat(F.lit('{"'), wa, F.lit('": [}')),
        _obj(**top, department_requirements=_subjects(ka, sw, score)),
        F.concat(F.lit("answer:\n```json\n"), F.regexp_replace(whole, r"\}$", ",}"), F.lit("\n```")),
        _obj(**top, general_requirements=_subjects(ka, sw, null), other_conditions=F.concat(F.lit("[3, "), any_of, F.lit("]")), department_requirements=depts),
    ]
    which = (F.floor(F.col("c") / 5) % 8).cast("int") + 1
    return e.select("event_id", F.element_at(F.array(*records), which).alias("raw"))


def _written(subjects: Column) -> Column:
    one = [
        F.when(subjects[k]["standard"].isNotNull(), F.concat(F.lit(f"{k}="), subjects[k]["standard"], F.lit(":"), F.coalesce(subjects[k]["min_score"].cast("string"), F.lit(""))))
        for k in V.SUBJECT_KEYS
    ]
    return F.concat_ws(" ", *one)


@query("record_normalise", _SQL)
def record_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every shape, read as VARIANT, and what their requirements say."""
    done = textrules.parse_record(raw_records(dealt(table(spark, sf_dir, "events"), "event_id")), "raw", "x")
    depts = F.col("x.department_requirements")
    first = F.get(depts, F.lit(0))
    return done.select(
        "event_id",
        F.col("x.error").alias("error"),
        F.col("x.confidence").alias("confidence"),
        _written(F.col("x.general_requirements")).alias("general"),
        F.size(depts).alias("departments"),
        F.when(F.size(depts) > 0, _written(first["subjects"])).alias("first_subjects"),
        first["notes"].alias("first_notes"),
    )


_GROUPS_SQL = """
with k as (
  select distinct w as keyword, 'g' || length(w) as group_name
  from (select unnest(regexp_split_to_array(text, '[^\\p{L}]+')) as w from benchmark) where length(w) >= 9
), h as (
  select doc_id, group_name, case when case when regexp_full_match(keyword, '[A-Za-z0-9+_.-]+')
      then contains(lower(split_part(text, chr(10), 1)), lower(keyword)) else contains(split_part(text, chr(10), 1), keyword) end then 1 else 2 end as p
  from documents join k on case when regexp_full_match(keyword, '[A-Za-z0-9+_.-]+') then contains(lower(text), lower(keyword)) else contains(text, keyword) end
)
"""


def _document_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines stand for majors, whole texts for labels; words of the benchmark items are the keywords."""
    docs = spread_table(spark, sf_dir, "documents")
    first = docs.select("doc_id", F.substring_index("text", "\n", 1).alias("v"), F.lit(1).alias("precedence"))
    whole = docs.select("doc_id", F.col("text").alias("v"), F.lit(2).alias("precedence"))
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("keyword"))
    long = words.filter(F.length("keyword") >= 9)
    groups = long.select(F.concat(F.lit("g"), F.length("keyword").cast("string")).alias("group_name"), "keyword")
    # No bound on the automaton: the way that a table of any size takes.
    return refsets.group_hits(first.unionByName(whole), "doc_id", "v", "precedence", groups, max_aliases=0)


@query("keyword_groups", _GROUPS_SQL + "select doc_id, group_name, cast(min(p) as integer) as precedence from h group by all")
def keyword_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a table of keywords that each document hits, in its first line or elsewhere."""
    return _document_groups(spark, sf_dir)


@query(
    "keyword_targets",
    _GROUPS_SQL
    + """, b as (select doc_id, group_name, min(p) as p from h group by all)
select d.doc_id, any_value(g.group_name) as target
from documents d left join (select doc_id, group_name, row_number() over (partition by doc_id order by p, group_name) as n from b) g
  on g.doc_id = d.doc_id and n = 1
group by d.doc_id
""",
)
def keyword_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of smallest precedence per document."""
    docs = spread_table(spark, sf_dir, "documents").select("doc_id")
    return refsets.targets(docs, "doc_id", _document_groups(spark, sf_dir), "precedence")


def programme_pages(parts: DataFrame) -> DataFrame:
    """A programme page per part: a layout table around a table with spans, cells left open in a third of the pages."""

    def joined(*pieces: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])

    key, size = F.col("p_partkey"), F.col("p_size")
    end = F.when(key % 3 == 0, "").otherwise("</td>")
    rows = (size % 3 + 1).cast("string")
    filler = F.repeat(F.lit("<tr><td>國文</td></tr>"), (size % 3).cast("int"))
    words = F.split("p_name", " ")
    standard = [_one_of((size + i) % 5, STANDARDS) for i in range(3)]
    details = joined(
        "<table><tr><td colspan=2>校系代碼", end, "<td>", F.lpad((key % 100000).cast("string"), 5, "0"), end, "</tr>",
        "<tr><td rowspan=2>學群類別", end, "<td rowspan=2>", F.col("p_type"), " <b>", size.cast("string"), "</b>", end, "<td>x", end, "</tr><tr><td>y", end, "</tr>",
        "<tr><td rowspan=", rows, ">國文<br>英文<br>數學A", end, "<td rowspan=", rows, ">", standard[0], "<br>", standard[1], "<br>", standard[2], end,
        "<td>1、", F.get(words, F.lit(0)), "<br>2、<i>", F.get(words, F.lit(1)), "</i>", end, "</tr>", filler,
        "<tr><td rowspan=2>年度", end, "<td colspan=2>名額", end, "</tr><tr><td>一般", end, "<td>外加", end, "</tr>",
        "<tr><td>115", end, "<td><table><tr><td>甲<td>乙</table>", size.cast("string"), end, "<td>", F.col("p_brand"), end, "</tr></table>",
    )
    head = joined('<div class="colname">', F.col("p_brand"), '</div><p class="gsdname">', F.col("p_name"), "</p>")
    return parts.select("p_partkey", joined(head, "<table><tr><td>選單", end, "<td>", details, end, "</tr></table>").alias("html"))


@query(
    "programme_details",
    f"""
with p as (select *, {_list_sql(STANDARDS)} as w from part)
select p_partkey, lpad(cast(p_partkey % 100000 as varchar), 5, '0') as program_code, p_brand as school_name, p_name as program_name,
  p_type || ' ' || p_size as group_name,
  '國文=' || w[p_size % 5 + 1] || ' 英文=' || w[(p_size + 1) % 5 + 1] || ' 數學A=' || w[(p_size + 2) % 5 + 1] as requirements,
  replace(p_name, ' ', '|') as ties
from p
""",
)
def programme_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programme pages read by the places of their cells."""
    rows = pages.star_details(programme_pages(dealt(table(spark, sf_dir, "part"), "p_partkey")), "p_partkey", "html")
    pairs = F.transform("requirements", lambda r: F.concat(r["subject"], F.lit("="), r["standard"]))
    return rows.select(
        "p_partkey", "program_code", "school_name", "program_name", "group_name",
        F.array_join(pairs, " ").alias("requirements"), F.array_join("tie_break_items", "|").alias("ties"),
    )


@query(
    "page_grids",
    "select p_partkey, p_size as general, p_brand as extra, '115' as year, cast(20 + p_size % 3 as integer) as cells, 3 as tables from part",
)
def page_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values under their headings, over spans, beside a table inside a cell."""
    read = programme_pages(dealt(table(spark, sf_dir, "part"), "p_partkey")).withColumn("c", grid.grid_cells("html"))
    under = {n: grid.below(F.col("c"), grid.first_cell(F.col("c"), lambda x: x == w)) for n, w in (("general", "一般"), ("extra", "外加"), ("year", "年度"))}
    tables = F.size(F.array_distinct(F.transform("c", lambda x: x["grid"])))
    return read.select(
        "p_partkey", under["general"]["text"].cast("int").alias("general"), under["extra"]["text"].alias("extra"), under["year"]["text"].alias("year"),
        F.size("c").alias("cells"), tables.alias("tables"),
    )


# Parts of names by the words of ``p_name``, and endings by ``p_size``.
HEADS = {"small": "130203", "blue": "应用", "new": "管理学院", "cold": "", "red": "某某", "large": "国际", "hot": "2", "old": "报名"}
STEMS = {"ring": "法学", "bolt": "护理", "anvil": "葡萄牙语", "widget": "数据应用", "plate": "国文", "rod": "音乐", "gear": "AI", "gizmo": "计算机"}
ENDINGS = ["", "（方向）", "5元"]


def _case_sql(value: str, words: dict[str, str]) -> str:
    return f"case {value} " + " ".join(f"when '{k}' then '{v}'" for k, v in words.items()) + " end"


def _any(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _ends(column: str, words) -> str:
    return "(" + " or ".join(f"ends_with({column}, '{w}')" for w in words) + ")"


def _in(column: str, words) -> str:
    return f"{column} in (" + ", ".join(f"'{w}'" for w in words) + ")"


@query(
    "name_verdicts",
    f"""
with r as (
  select p_partkey, {_case_sql("split_part(p_name, ' ', 1)", HEADS)} || {_case_sql("split_part(p_name, ' ', 2)", STEMS)}
    || {_list_sql(ENDINGS)}[p_size % 3 + 1] as raw from part
), u as (
  select p_partkey, regexp_replace(replace(replace(raw, '（', '('), '）', ')'), '^[0-9]{{4,12}}', '') as s from r
), n as (
  select p_partkey, case when contains(s, '学院') and length(split_part(s, '学院', -1)) between 2 and 40 then split_part(s, '学院', -1) else s end as name from u
), b as (
  select *, split_part(name, '(', 1) as base, length(name) - length(regexp_replace(name, '[一-鿿]', '', 'g')) as han from n
), t as (
  select *, case
      when length(name) < 2 or length(name) > 60 then 'length' when han < 2 then 'script'
      when length(name) = 2 and not {_ends("name", ["学", "语"])} and not {_in("name", V.TWO_CHAR_MAJORS)} then 'fragment'
      when regexp_matches(name, '[0-9]') or contains(name, '元') then 'number' when {_any("name", V.MAJOR_STOP_WORDS)} then 'stop word'
      when {_any("name", V.SENTENCE_MARKS)} then 'sentence' when {_in("base", V.SUBJECT_BASES)} then 'subject'
      when ends_with(base, '语') and length(base) <= 6 then 'language' when {_ends("base", V.MAJOR_SUFFIXES)} then 'suffix'
      when ends_with(base, '应用') and {_any("base", V.APPLIED_WORDS)} then 'applied' else 'weak' end as rule
  from b
)
select p_partkey, name, rule, rule in ('language', 'suffix', 'applied') as kept from t
""",
)
def name_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF10, SF11: names put together from the words of each part, with the rule that decides each."""

    def mapped(index: int, words: dict[str, str]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), F.get(F.split("p_name", " "), F.lit(index)))

    raw = F.concat(mapped(0, HEADS), mapped(1, STEMS), _one_of(F.col("p_size") % 3, ENDINGS))
    v = table(spark, sf_dir, "part").select("p_partkey", text_rules.major_verdict(raw).alias("v"))
    return v.select("p_partkey", "v.name", "v.rule", "v.kept")


@query(
    "page_images",
    f"""
with i as (
  select page_id, unnest([
    regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/i/table' || page_id || '.png',
    regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || 'img/' || page_id % 4 || '.WEBP',
    'https://cdn.example.org/' || case when page_id % 3 = 0 then 'logo' else 'scan' end || '.jpg'
  ]) as u, unnest([1, 2, 3]) as n from pages
)
select page_id, coalesce(string_agg(u, ' ' order by n) filter (not {_any("lower(u)", V.IMAGE_STOP_WORDS)}), '') as images from i group by page_id
""",
)
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image links put around every whole page: absolute, relative, repeated, of other kinds and unwanted."""
    number = F.col("page_id").cast("string")
    before = F.concat(F.lit('<img src="/i/table'), number, F.lit('.png"><IMG alt=x SRC=\'img/'), (F.col("page_id") % 4).cast("string"), F.lit(".WEBP'>"))
    name = F.when(F.col("page_id") % 3 == 0, "logo").otherwise("scan")
    after = F.concat(F.lit('<img src="x.gif"><img data-id=1><img src=https://cdn.example.org/'), name, F.lit('.jpg ><img src="/i/table'), number, F.lit('.png">'))
    docs = spread_table(spark, sf_dir, "pages").select("page_id", "url", F.concat(before, F.coalesce("html", F.lit("")), after).alias("html"))
    found = pages.image_links(docs, "url", "html", "images")
    return found.select("page_id", F.array_join("images", " ").alias("images"))


@query(
    "dated_catalogue",
    """
select p_partkey, lpad(cast(p_partkey % 100000 as varchar), 5, '0') as program_code, substr(lpad(cast(p_partkey % 100000 as varchar), 5, '0'), 1, 3) as school_code,
  case when p_partkey % 4 = 3 then '' else p_brand end as school_name, case when p_partkey % 4 = 3 then '' else p_name end as program_name, p_size % 8 + 1 as star_group
from part
""",
)
def dated_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5, dated form: codes of this year's links with the bold entry before them; entries after the link do not count."""
    code = F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0")
    entry = F.concat(F.lit("<b>"), "p_brand", F.lit("<br>"), "p_name", F.lit(" ("), code, F.lit(")</b>"))
    link = F.concat(F.lit('<a href="./html/115_'), code, F.lit('.htm">x</a>'))
    old = F.concat(F.lit("<a href='./html/114_99999.htm'>x</a><strong>y<br>z ("), code, F.lit(")</strong>"))
    html = F.when(F.col("p_partkey") % 4 == 3, F.concat(old.substr(F.lit(1), F.lit(36)), link, entry)).otherwise(F.concat(old, entry, link, entry))
    part = dealt(table(spark, sf_dir, "part"), "p_partkey")
    df = part.select("p_partkey", (F.col("p_size") % 8 + 1).alias("star_group"), html.alias("html"))
    return pages.star_catalog_rows(df, "p_partkey", "html", "star_group", 115)
