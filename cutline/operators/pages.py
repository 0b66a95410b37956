"""Tables out of harvested pages.

Pages are parsed with regular expressions on the JVM, one page per cell. The subset:
elements close explicitly (an unclosed region runs to the end of the page), regions are
found by tag, class or id, and the rows of distribution tables hold no tables. Detail pages are
read as grids of cells, with spans and tables inside tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import grid, vocab as V
from ..functions.expr import blank_to_null, c, contains_any, let, strip, text
from ..functions.urls import host, image_candidates, resolve_url
from ..functions.values import code_token
from .scans import top_per_key

# Elements that carry no main text, and the content selectors in order.
NOISE_TAGS = ["script", "style", "nav", "header", "footer", "aside"]
CONTENT_SELECTORS = [
    "article", "main", ".content", ".article", "#content", ".main-content", ".news-content", ".detail",
]
# Named characters decoded without Python; the ampersand comes last.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&apos;": "'", "&nbsp;": "\xa0",
    "&copy;": "©", "&middot;": "·", "&amp;": "&",
}
COMMENT = r"(?s)<!--.*?-->"
ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"


def unescape(value: Column) -> Column:
    for entity, char in ENTITIES.items():
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


@F.pandas_udf(StringType())
def unescape_all(values: pd.Series) -> pd.Series:
    """Every HTML entity, in Arrow batches; only for pages with rare named characters."""
    import html

    return values.map(lambda v: None if v is None else html.unescape(v))


def _closed(tags: Sequence[str]) -> str:
    return "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in tags)


def remove_noise(html: Column | str, tags: Sequence[str] = tuple(NOISE_TAGS)) -> Column:
    return F.regexp_replace(F.regexp_replace(text(html), COMMENT, "\n"), _closed(tags), "\n")


def _element(html: Column, opening: str) -> Column:
    """Inside of the first element whose opening tag matches; null when there is none.

    The closing tag is found by counting nested tags of the same name. Each piece begins where the last one ended
    (``\\G``), so a long tail without such a tag is read once and not from each of its characters.
    """
    parts = F.struct(
        F.lower(F.regexp_extract(F.regexp_extract(html, opening, 0), r"<(\w+)", 1)).alias("name"),
        F.regexp_extract(html, opening + "(.*)$", 1).alias("rest"),
    )
    state = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("close"))

    def walk(acc: Column, piece: Column) -> Column:
        def moved(tag: Column) -> Column:
            depth = acc["depth"] + F.when(tag.startswith("</"), -1).otherwise(1)
            return F.struct(
                depth.cast("int").alias("depth"),
                (acc["n"] + F.length(piece)).cast("int").alias("n"),
                F.when(depth == 0, F.length(tag)).otherwise(0).cast("int").alias("close"),
            )

        tag = F.regexp_extract(piece, r"(?s)(</?\w+\b[^>]*>)$", 1)
        return F.when(acc["depth"] == 0, acc).otherwise(let(tag, moved))

    def inside(x: Column) -> Column:
        pieces = F.regexp_extract_all(
            x["rest"], F.concat(F.lit(r"(?is)\G(.*?</?"), x["name"], F.lit(r"\b[^>]*>)")), F.lit(1)
        )
        cut = let(
            F.aggregate(pieces, state, walk),
            lambda end: F.when(end["depth"] == 0, x["rest"].substr(F.lit(1), end["n"] - end["close"])).otherwise(x["rest"]),
        )
        return F.when(x["name"] != "", cut)

    return let(parts, inside)


def _opening(selector: str) -> str:
    if selector[0] == ".":
        return rf"""(?is)<\w+\b[^>]*\bclass\s*=\s*["']?(?:[^"'>]*\s)?{selector[1:]}(?=[\s"'>])[^>]*>"""
    if selector[0] == "#":
        return rf"""(?is)<\w+\b[^>]*\bid\s*=\s*["']?{selector[1:]}(?=[\s"'>])[^>]*>"""
    return rf"(?is)<{selector}\b[^>]*>"


def lines_of(fragment: Column, decode=unescape) -> Column:
    """Text of a fragment: tags break lines, lines stripped, blank ones gone."""
    plain = decode(F.regexp_replace(F.regexp_replace(fragment, COMMENT, "\n"), r"(?s)<[^>]*>", "\n"))
    return F.array_join(F.filter(F.transform(F.split(plain, r"[\n\r]"), strip), lambda x: x != ""), "\n")


def page_text(
    df: DataFrame, html: str, out: str, selectors: Sequence[str] = tuple(CONTENT_SELECTORS), decode=unescape
) -> DataFrame:
    """Main text of a page: first content region that exists, else the whole page."""
    step = df.withColumn("_clean", remove_noise(html))
    region = F.coalesce(*[_element(F.col("_clean"), _opening(s)) for s in selectors], F.col("_clean"))
    return step.withColumn("_region", region).withColumn(out, lines_of(F.col("_region"), decode)).drop("_clean", "_region")


def fragment_text(fragment: Column | str) -> Column:
    """X1, fragment form: scripts and styles dropped."""
    return lines_of(F.regexp_replace(text(fragment), _closed(["script", "style"]), "\n"))


def attribute(attrs: Column, name: str) -> Column:
    """Value of a tag attribute, decoded; empty when missing."""
    quoted = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return unescape(F.coalesce(*[blank_to_null(F.regexp_extract(attrs, quoted, i)) for i in (1, 2, 3)], F.lit("")))


def inner_text(inner: Column, sep: str = " ") -> Column:
    """Stripped text nodes of a fragment joined by ``sep``."""
    nodes = F.split(F.regexp_replace(inner, r"(?s)<[^>]*>", "\u0001"), "\u0001")
    return F.array_join(F.filter(F.transform(nodes, lambda x: strip(unescape(x))), lambda x: x != ""), sep)


def anchors(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """SF20: links of a page in order: (key, pos, href, link_url, link_text, link_label)."""
    found = F.arrays_zip(
        F.regexp_extract_all(text(html), F.lit(ANCHOR), F.lit(1)).alias("attrs"),
        F.regexp_extract_all(text(html), F.lit(ANCHOR), F.lit(2)).alias("inner"),
    )
    rows = df.select(key, F.col(url).alias("_base"), F.posexplode(found).alias("pos", "_a"))
    rows = rows.withColumn("href", strip(attribute(F.col("_a.attrs"), "href"))).filter("href <> ''")
    return rows.select(
        key,
        "pos",
        "href",
        resolve_url("_base", "href").alias("link_url"),
        inner_text(F.col("_a.inner"), " ").alias("link_text"),
        inner_text(F.col("_a.inner"), "").alias("link_label"),
    )


def first_links(rows: DataFrame, key: str) -> DataFrame:
    """W8 on the resolved URL."""
    return top_per_key(rows, [key, "link_url"], [F.col("pos").asc()], 1)


def attachment_links(
    rows: DataFrame, key: str, words: Sequence[str] = tuple(V.LINK_WORDS), suffixes=tuple(V.DOCUMENT_SUFFIXES), downloads=tuple(V.DOWNLOAD_WORDS)
) -> DataFrame:
    """Attachment or keyword links, each URL once per page."""
    lower = F.lower("href")
    attached = contains_any(lower, suffixes) | contains_any(lower, downloads)
    kept = rows.filter(attached | contains_any(F.concat("link_label", "href"), words))
    return first_links(kept, key)


def scored_links(
    rows: DataFrame,
    key: str,
    rules=tuple(V.LINK_SCORE),
    name_hit: Column | None = None,
    threshold: int = 6,
    top: int | None = None,
) -> DataFrame:
    """Links by additive keyword score; the first ``top`` of each page on request."""
    first = first_links(rows, key)
    fields = {
        "combo": F.concat_ws(" ", "link_text", "href"),
        "text": F.col("link_text"),
        "href": F.lower("href"),
        "attachment": F.lower("href"),
    }
    score = F.lit(0)
    for name, words, points in rules:
        score = score + F.when(contains_any(fields[name], words), points).otherwise(0)
    if name_hit is not None:
        score = score + F.when(name_hit, 2).otherwise(0)
    lower = F.lower("href")
    attached = contains_any(lower, V.LINK_SUFFIXES) | contains_any(lower, V.DOWNLOAD_WORDS)
    out = first.withColumn("score", score).withColumn("is_attachment", attached).filter(F.col("score") >= threshold)
    return top_per_key(out, [key], [F.col("score").desc(), F.col("pos").asc()], top) if top else out


def image_links(df: DataFrame, url: str, html: str, out: str, limit: int = 8) -> DataFrame:
    """Absolute image URLs worth reading, at most ``limit`` in page order."""
    attrs = F.regexp_extract_all(text(html), F.lit(r"(?is)<img\b([^>]*)>"), F.lit(1))
    urls = F.array_distinct(
        F.transform(
            F.filter(F.transform(attrs, lambda a: strip(attribute(a, "src"))), lambda s: s != ""),
            lambda s: resolve_url(F.col(url), s),
        )
    )
    return df.withColumn(out, image_candidates(urls, limit))


# ---- catalogue and detail pages ----------------------------------------------------

BOLD = r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)\s*>"


def catalog_rows(df: DataFrame, key: str, html: str, group: str) -> DataFrame:
    """(code, institution, programme, group) of bold catalogue entries; the first per page wins."""
    blocks = df.select(key, group, F.posexplode(F.regexp_extract_all(text(html), F.lit(BOLD), F.lit(1))).alias("pos", "_b"))
    rows = _named_block(blocks.withColumn("_lines", F.split(lines_of(F.col("_b")), "\n")))
    return top_per_key(rows, [key, "program_code"], [F.col("pos").asc()], 1).select(
        key, "program_code", "school_name", "program_name", group
    )


def _named_block(rows: DataFrame) -> DataFrame:
    return _names(rows).filter("program_code is not null")


def _names(rows: DataFrame) -> DataFrame:
    whole = F.array_join("_lines", "\n")
    rows = rows.withColumn("program_code", blank_to_null(F.regexp_extract(whole, r"\(([0-9]{5})\)", 1)))
    mark = F.concat(F.lit("("), F.col("program_code"), F.lit(")"))
    line = F.coalesce(F.get(F.filter("_lines", lambda x: x.contains(mark)), F.lit(0)), F.element_at("_lines", -1))
    return rows.withColumn("school_name", F.get("_lines", F.lit(0))).withColumn(
        "program_name", strip(F.replace(line, mark, F.lit("")))
    )


def star_catalog_rows(df: DataFrame, key: str, html: str, group: str, year: int) -> DataFrame:
    """X5, link form: codes of detail links with the nearest bold entry before them, without names if there is none; the last link wins."""
    part = rf"(?is)(<(?:b|strong)\b[^>]*>.*?</(?:b|strong)\s*>|<a\b[^>]*>)"
    seq = df.select(key, group, F.posexplode(F.regexp_extract_all(text(html), F.lit(part), F.lit(1))).alias("pos", "_b"))
    bold = F.lower("_b").rlike(r"^<(?:b|strong)\b")
    named = _names(seq.withColumn("_lines", F.when(bold, F.split(lines_of(F.col("_b")), "\n"))))
    link = blank_to_null(F.regexp_extract("_b", rf"/html/{int(year)}_(\d{{5}})\.htm", 1))
    names = F.struct("school_name", "program_name")
    marks = F.array_compact(F.array(  # a bold entry may hold a link, so a block gives up to two rows
        F.when(link.isNotNull(), F.struct(link.alias("program_code"), F.lit(True).alias("_link"), F.when(F.lit(False), names).alias("_entry"))),
        F.when(F.col("program_code").isNotNull(), F.struct("program_code", F.lit(False).alias("_link"), names.alias("_entry"))),
    ))
    rows = named.select(key, group, "pos", F.explode(marks).alias("_m")).select(key, group, "pos", "_m.*")
    before = Window.partitionBy(key, "program_code").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    links = rows.withColumn("_entry", F.last("_entry", ignorenulls=True).over(before)).filter("_link")
    last = top_per_key(links.select(key, group, "pos", "program_code", "_entry.*"), [key, "program_code"], [F.col("pos").desc()], 1)
    return last.select(
        key,
        "program_code",
        F.col("program_code").substr(1, 3).alias("school_code"),
        F.coalesce("school_name", F.lit("")).alias("school_name"),
        F.coalesce("program_name", F.lit("")).alias("program_name"),
        group,
    )


def cells_of(html: Column | str) -> Column:
    """Texts of all table cells in order, lines separated by newlines."""
    raw = F.regexp_extract_all(text(html), F.lit(r"(?is)<td\b[^>]*>(.*?)</td\s*>"), F.lit(1))
    return F.transform(raw, lambda x: lines_of(x))


def _by_class(html: Column, name: str) -> Column:
    return F.coalesce(F.replace(lines_of(_element(html, _opening("." + name))), F.lit("\n"), F.lit(" ")), F.lit(""))


def star_details(df: DataFrame, key: str, html: str) -> DataFrame:
    """Programme page: names, code, subject/standard pairs and ordered tie-break items.

    Cells are found by their place (see ``grid_cells``): the standards stand right of the subjects, the group right of
    its label. A layout table around everything is not mistaken for the cell it holds.
    """
    cells = F.col("_cells")
    step = (
        df.withColumn("_cells", grid.grid_cells(html))
        .withColumn("_at", grid.first_cell(cells, lambda x: x.contains("國文") & x.contains("英文") & x.contains("數學")))
        .withColumn(
            "_tie",
            grid.first_cell(cells, lambda x: x.contains("1、") & x.contains("2、") & ~x.contains("分發比序") & x.contains("\n")),
        )
        .withColumn("_std", grid.right_of(cells, F.col("_at")))
        .withColumn("_grp", grid.right_of(cells, grid.first_cell(cells, lambda x: x.contains("學群類別"))))
    )
    subjects, standards = grid.lines(F.col("_at")), grid.lines(F.col("_std"))
    n = F.least(F.size(subjects), F.size(standards))
    ties = F.filter(
        F.transform(grid.lines(F.col("_tie")), lambda x: strip(F.regexp_replace(x, "^[0-9]+、", ""))),
        lambda x: x != "",
    )
    return step.select(
        key,
        grid.one_line(grid.first_cell(cells, lambda x: x.rlike(r"^\d{5}$"))).alias("program_code"),
        _by_class(text(html), "colname").alias("school_name"),
        _by_class(text(html), "gsdname").alias("program_name"),
        grid.one_line(F.col("_grp")).alias("group_name"),
        F.arrays_zip(
            F.slice(subjects, F.lit(1), n).alias("subject"), F.slice(standards, F.lit(1), n).alias("standard")
        ).alias("requirements"),
        ties.alias("tie_break_items"),
    )


def apply_details(df: DataFrame, key: str, html: str) -> DataFrame:
    """Second-route page: stage-one triples (padded with nulls) and the last cell of the tie-break row."""
    cells, tie = F.col("_cells"), F.col("_tie")

    def subject_cell(x: Column) -> Column:
        named = F.split(x, "\n")
        return (
            F.array_contains(named, "國文")
            & F.array_contains(named, "英文")
            & (F.size(named) >= 3)
            & ~x.contains("篩選")
            & ~x.contains("檢定")
        )

    step = (
        df.withColumn("_cells", grid.grid_cells(html))
        .withColumn("_at", grid.first_cell(cells, subject_cell))
        .withColumn("_std", grid.right_of(cells, F.col("_at")))
        .withColumn("_mul", grid.right_of(cells, F.col("_std")))
        .withColumn("_tie", grid.first_cell(cells, lambda x: x.contains("同級分") & x.contains("超額篩選")))
    )
    triple = F.transform(
        grid.lines(F.col("_at")),
        lambda s, i: F.struct(
            s.alias("subject"),
            F.get(grid.lines(F.col("_std")), i).alias("standard"),
            F.get(grid.lines(F.col("_mul")), i).alias("multiplier"),
        ),
    )
    row = F.filter(cells, lambda x: (x["grid"] == tie["grid"]) & (x["row"] == tie["row"]))
    return step.select(
        key,
        grid.one_line(grid.first_cell(cells, lambda x: x.rlike(r"^\d{6}$"))).alias("program_code"),
        _by_class(text(html), "colname").alias("school_name"),
        _by_class(text(html), "gsdname").alias("program_name"),
        triple.alias("stage1"),
        grid.one_line(let(row, lambda r: F.get(r, F.size(r) - 1))).alias("tie_break"),
    )


def distribution_rows(df: DataFrame, key: str, html: str) -> DataFrame:
    """Keyed rows of a distribution table: six cells or more and a six-digit code; the last row wins."""
    table = F.regexp_extract(text(html), r"(?is)<table\b[^>]*>(.*?)</table\s*>", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    flat = df.select(key, F.posexplode(F.transform(rows, cells_of)).alias("pos", "_c"))

    def cell(i: int) -> Column:
        return F.replace(F.get("_c", F.lit(i)), F.lit("\n"), F.lit(" "))

    keyed = flat.filter((F.size("_c") >= 6) & F.get("_c", F.lit(0)).rlike(r"^\d{6}$")).select(
        key,
        "pos",
        cell(0).alias("apply_code"),
        cell(1).alias("dept_name"),
        cell(2).alias("quota_type"),
        cell(5).alias("min_distribution"),
    )
    return top_per_key(keyed, ["apply_code"], [F.col(key).desc(), F.col("pos").desc()], 1).drop("pos")


# ---- work lists and authority domains ------------------------------------------------


def report_files(rows: DataFrame, key: str, year: Column | str) -> DataFrame:
    """Report files of an index page: code and name from the link text, code from the URL as fallback."""
    pdf = rows.filter(F.lower("href").contains(".pdf"))
    label = r"^\((\d{3})\)\s*(.+?)\s*$"
    code = code_token(F.regexp_extract("link_text", label, 1), 3)
    named = F.regexp_extract("link_text", label, 2)
    out = pdf.select(
        key,
        "pos",
        c(year).cast("int").alias("year"),
        code.alias("_code"),
        F.when(named != "", strip(named)).otherwise(F.col("link_text")).alias("school_name"),
        F.col("link_url").alias("pdf_url"),
    )
    first = top_per_key(out, ["year", "_code", "pdf_url"], [F.col(key).asc(), F.col("pos").asc()], 1)
    fallback = F.regexp_extract("pdf_url", r"Standard_(\d{3})\.pdf", 1)
    return first.select(
        "year", F.when(F.col("_code") == "", fallback).otherwise(F.col("_code")).alias("school_code"), "school_name", "pdf_url"
    )


def report_images(rows: DataFrame, key: str) -> DataFrame:
    """S7, image form: institution codes of report links with the image next to them, first per page."""
    coded = rows.withColumn("school_code", blank_to_null(F.regexp_extract("href", r"report/(\d{3})\.htm", 1))).filter(
        "school_code is not null"
    )
    first = top_per_key(coded, [key, "school_code"], [F.col("pos").asc()], 1)
    folder = F.regexp_replace("link_url", r"report/\d{3}\.htm.*$", "report/pict/")
    return first.select(key, "school_code", F.concat(folder, F.col("school_code"), F.lit(".png")).alias("image_url"))


def text_domains(value: Column | str) -> Column:
    """Host names of all URLs in a text, gaps after the protocol closed."""
    fixed = F.regexp_replace(text(value), r"(https?://) ", "$1")
    urls = F.regexp_extract_all(fixed, F.lit(r"(https?://[^\s\)）]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(urls, lambda u: host(u, drop_www=True)), lambda h: h != ""))


def authority_domains(df: DataFrame, value: Column | str, name: str = "domain") -> DataFrame:
    """Distinct domains; distinct per text first, then folded map-side."""
    return df.select(F.explode(text_domains(value)).alias(name)).distinct()
