"""Harvested pages: main text, links, catalogues, details, distributions, word boxes."""

from pyspark.sql import functions as F

from cutline.operators import bands, dedupe, pages


def one(spark, html, url="http://x.cn/a/b.html"):
    return spark.createDataFrame([(1, url, html)], "id int, url string, html string")


def text_of(spark, html):
    return pages.page_text(one(spark, html), "html", "t").first()["t"]


def test_main_text_regions(spark):
    assert text_of(spark, "<body><nav>n</nav><article>A <b>b</b><!-- c --></article>z</body>") == "A\nb"
    nested = '<div class="side">s</div><div class="x content y"><div>1</div> 2 <div><div>3</div></div></div><div>tail</div>'
    assert text_of(spark, nested) == "1\n2\n3"
    assert text_of(spark, '<p>no</p><div id="content">yes &amp; &lt;b&gt;<br>more') == "yes & <b>\nmore"
    assert text_of(spark, "<script>var a='<p>';</script><p>all</p>\n<p>  </p><footer>f</footer>") == "all"


def test_all_entities(spark):
    df = one(spark, "x").select(pages.unescape_all(F.lit("&eacute;&hellip;&#x4e2d;")).alias("v"))
    assert df.first()["v"] == "é…中"


def test_links_and_scores(spark):
    html = (
        '<a href="/d/2026简章.pdf">2026年<b>台湾</b>学测招生简章</a><a href="/d/2026简章.pdf">again</a>'
        "<a href='news.html'>新闻</a><a href=\"javascript:void(0)\">2026台湾学测</a><a name=x>none</a>"
    )
    links = pages.anchors(one(spark, html), "id", "url", "html")
    assert [r["link_url"] for r in links.orderBy("pos").collect()][:3] == [
        "http://x.cn/d/2026简章.pdf", "http://x.cn/d/2026简章.pdf", "http://x.cn/a/news.html",
    ]
    got = {r["link_url"]: (r["score"], r["is_attachment"]) for r in pages.scored_links(links, "id").collect()}
    assert got == {"http://x.cn/d/2026简章.pdf": (4 + 4 + 4 + 3 + 2, True), "javascript:void(0)": (4 + 4 + 4 - 5, False)}
    files = pages.attachment_links(links, "id").collect()
    assert sorted(r["link_url"] for r in files) == ["http://x.cn/d/2026简章.pdf", "javascript:void(0)"]


def test_images(spark):
    html = '<img src="/i/table.png"><img src="logo.png"><IMG class=a SRC=\'t.webp\'><img src="/i/table.png"><img src="x.gif">'
    got = pages.image_links(one(spark, html), "url", "html", "im").first()["im"]
    assert got == ["http://x.cn/i/table.png", "http://x.cn/a/t.webp"]


def test_catalogues(spark):
    html = (
        '<b>甲大學<br>文學系 (00101)</b><a href="./html/115_00101.htm">看</a>'
        '<strong>甲大學<br>理學系 (00102)</strong><a href="./html/115_00102.htm">看</a><b>甲大學<br>重複 (00101)</b>'
    )
    df = one(spark, html).withColumn("g", F.lit(1))
    rows = {r["program_code"]: (r["school_name"], r["program_name"]) for r in pages.catalog_rows(df, "id", "html", "g").collect()}
    assert rows == {"00101": ("甲大學", "文學系"), "00102": ("甲大學", "理學系")}
    star = {r["program_code"]: (r["school_code"], r["program_name"]) for r in pages.star_catalog_rows(df, "id", "html", "g", 115).collect()}
    assert star == {"00101": ("001", "文學系"), "00102": ("001", "理學系")}
    late = '<a href="./html/115_00103.htm">看</a><b>甲大學<br>後來 (00103)</b>'
    row = pages.star_catalog_rows(one(spark, late).withColumn("g", F.lit(1)), "id", "html", "g", 115).first()
    assert (row["program_code"], row["school_name"], row["program_name"]) == ("00103", "", "")


def test_programme_details(spark):
    html = (
        '<span class="colname">甲大學</span><span class="gsdname">文學系</span><table><tr><td>00101</td></tr>'
        "<tr><td>學群類別</td><td>第一類</td></tr>"
        "<tr><td>國文<br>英文<br>數學A<br>英聽</td><td>均標<br>前標<br>--</td>"
        "<td>1、在校學業成績全校排名百分比<br>2、學測國文級分</td></tr></table>"
    )
    row = pages.star_details(one(spark, html), "id", "html").first()
    assert (row["program_code"], row["school_name"], row["program_name"], row["group_name"]) == ("00101", "甲大學", "文學系", "第一類")
    assert [(r["subject"], r["standard"]) for r in row["requirements"]] == [("國文", "均標"), ("英文", "前標"), ("數學A", "--")]
    assert row["tie_break_items"] == ["在校學業成績全校排名百分比", "學測國文級分"]


def test_second_route_details(spark):
    html = (
        "<table><tr><td>001012</td></tr><tr><td>國文<br>英文<br>自然</td><td>均標<br>前標</td><td>3<br>--<br>5</td></tr>"
        "<tr><td>同級分(分數)超額篩選方式</td><td>一、學測國文</td></tr></table>"
    )
    row = pages.apply_details(one(spark, html), "id", "html").first()
    assert row["program_code"] == "001012"
    assert [tuple(r) for r in row["stage1"]] == [("國文", "均標", "3"), ("英文", "前標", "--"), ("自然", None, "5")]
    assert row["tie_break"] == "一、學測國文"


def test_distribution_rows(spark):
    cell = "<td>{}</td>"
    row = lambda *v: "<tr>" + "".join(cell.format(x) for x in v) + "</tr>"
    html = "<table>" + row("code", "b", "c", "d", "e", "f") + row("001012", "系", "一般", "1", "2", "國12") + row("001", "x") + row(
        "001012", "系", "外加", "1", "2", "國13"
    ) + "</table>"
    got = pages.distribution_rows(one(spark, html), "id", "html").collect()
    assert [(r["apply_code"], r["quota_type"], r["min_distribution"]) for r in got] == [("001012", "外加", "國13")]


def test_report_files(spark):
    html = '<a href="p/Standard_001.pdf">(001) 甲大學 </a><a href="p/Standard_002.pdf">乙大學</a><a href="x.html">(003) 丙</a>'
    links = pages.anchors(one(spark, html), "id", "url", "html")
    got = sorted(tuple(r) for r in pages.report_files(links, "id", F.lit(113)).collect())
    assert got == [(113, "001", "甲大學", "http://x.cn/a/p/Standard_001.pdf"), (113, "002", "乙大學", "http://x.cn/a/p/Standard_002.pdf")]
    images = pages.anchors(one(spark, '<a href="report/001.htm">a</a><a href="report/001.htm">b</a>'), "id", "url", "html")
    assert [tuple(r) for r in pages.report_images(images, "id").collect()] == [(1, "001", "http://x.cn/a/report/pict/001.png")]


def box(text, x, y, w=10.0, h=10.0):
    return ("d", 1, text, float(x), float(y), float(w), float(h))


def test_sieve_rows(spark):
    words = [
        box("001012", 5, 100), box("001012", 2, 102), box("國", 101, 101), box("英12", 112, 103), box("自巧", 151, 99),
        box("*", 401, 100), box("999", 300, 160),
    ]
    df = spark.createDataFrame(words, "doc string, page int, text string, x double, y double, w double, h double")
    bounds = [100.0, 150.0, 200.0, 250.0, 300.0, 350.0, 400.0, 450.0]
    cols = spark.createDataFrame([("d", 1, bounds)], "doc string, page int, bounds array<double>")
    row = bands.sieve_rows(df, cols).first()
    assert row["apply_code"] == "001012" and row["oversubscribe"] is True
    assert [(o["order"], o["expr"], o["min_score"]) for o in row["min_orders"]] == [(1, "國英", 12), (2, "自", 15)]


def test_history_entries_and_best(spark):
    words = [
        ("d", 1, "00101", 50.0, 100.0), ("d", 1, "在校", 600.0, 90.0), ("d", 1, "學測", 600.0, 105.0), ("d", 1, "組", 620.0, 105.5),
        ("d", 1, "5%", 700.0, 90.5), ("d", 1, "12", 700.0, 105.2), ("d", 1, "9", 720.0, 105.2), ("d", 1, "--", 780.0, 90.0),
        ("d", 2, "00101", 50.0, 100.0), ("d", 2, "在校", 600.0, 100.0),
    ]
    df = spark.createDataFrame(words, "doc string, page int, text string, x0 double, y0 double")
    entries = bands.history_entries(df)
    rows = {r["page"]: r for r in entries.collect()}
    assert [v["num"] for v in rows[1]["round1"]] == [5.0, 12.0] and rows[1]["round2"] == [None, None]
    best = dedupe.keep_best(entries, ["program_code"], dedupe.history_order()).collect()
    assert [r["page"] for r in best] == [1]


def test_a_long_tail_is_read_once(spark):
    tail = "x < y " * 60_000
    assert text_of(spark, f"<article>a<article>b</article></article>{tail}") == "a\nb"
