"""Text rules on the domain's own vocabulary."""

import pytest
from pyspark.sql import functions as F

from cutline.functions import expr, standards, text as T, urls, values
from cutline.operators import bands, majors, textrules


def subjects(spark, text, start=None):
    df = spark.createDataFrame([(text,)], ["t"]).withColumn("s", textrules.empty_subjects())
    if start:
        df = df.withColumn("s", F.col("s").withField(start[0] + ".standard", F.lit(start[1])))
    row = textrules.rule_subjects(df, "s", "t", "out").first()["out"].asDict(recursive=True)
    return {k: (v["standard"], v["min_score"]) for k, v in row.items() if v["standard"] or v["min_score"]}


def test_listed_standards_last_phrase_wins(spark):
    assert subjects(spark, "语文、英语 达到 前标。英文达到均标") == {"chinese": ("前标", None), "english": ("均标", None)}


def test_any_of_standards(spark):
    got = subjects(spark, "语文、英文、数学A或B任一科达到均标")
    assert got == {k: ("任一均标", None) for k in ("chinese", "english", "math_a", "math_b")}


def test_any_of_keeps_other_standards(spark):
    got = subjects(spark, "国文达到前标；国文、英文任一科均标")
    assert got["chinese"] == ("前标", None) and got["english"] == ("任一均标", None)


def test_scores_and_range(spark):
    assert "english" not in subjects(spark, "国文：12级分，英文 16级分")
    got = subjects(spark, "国文12级分，自然 8 级分")
    assert got["chinese"][1] == 12 and got["science"][1] == 8


def test_wide_score_pattern_reaches_far(spark):
    assert subjects(spark, "社会科目需在全体考生中达到9级以上")["social"][1] == 9


def test_loose_context_uses_first_standard(spark):
    got = subjects(spark, "四科任意两科", ("chinese", "均标"))
    assert got["english"] == ("任一均标", None) and got["chinese"] == ("任一均标", None)


def test_detect_subjects_scripts(value):
    assert value(lambda: T.detect_subjects(F.lit("數學"), True)) == ["math_a", "math_b"]
    assert value(lambda: T.detect_subjects(F.lit("數學"), False)) == []
    assert value(lambda: T.detect_subjects(F.lit("数学A/B、国文"))) == ["math_a", "math_b", "chinese"]


def test_standard_word_order(value):
    assert value(lambda: standards.detect_standard(F.lit("底标或前標"))) == "前标"


@pytest.mark.parametrize(
    "raw,want",
    [("任一均标以上", (3, True, "均标")), ("任何一科前标", (4, True, "前标")), (" 顶标级以上 ", (5, False, "顶标")), ("良好", (None, False, "良好"))],
)
def test_parse_standard(value, raw, want):
    got = value(lambda: standards.parse_standard(F.lit(raw)))
    assert (got["rank"], got["any"], got["base"]) == want


def test_context_groups(value):
    got = value(lambda: T.context_groups(F.lit("国文、英文任一科；英文或国文择一；数学A/B其一")))
    assert got == [["chinese", "english"], ["math_a", "math_b"]]
    assert value(lambda: T.context_groups(F.lit("国文与英文"))) == []


@pytest.mark.parametrize(
    "name,want",
    [
        ("130203作曲与作曲技术理论", True), ("葡萄牙语", True), ("表演", True), ("音乐", False), ("绘制", False), ("数学", False),
        ("招生计划", False), ("管理学院行政管理", True), ("软件工程4名", False), ("大数据管理应用", True), ("学费", False),
    ],
)
def test_is_major(value, name, want):
    assert bool(value(lambda: T.is_major(F.lit(name)))) is want


def test_label_majors(value):
    assert value(lambda: T.label_majors(F.lit("中医学、针灸推拿学"))) == ["中医学", "针灸推拿学"]
    assert value(lambda: T.label_majors(F.lit("理工类专业"))) == []
    assert value(lambda: T.display_label_majors(F.lit("法学，音乐/法学"))) == ["法学", "音乐"]


def test_majors_from_text(spark):
    text = "\n".join(
        ["学校首页", "一、招生专业及计划", "计算机科学与技术、软件工程 4", "专业 学制", "计算", "机类", "四年制", "法学，法学", "三、申请方式", "临床医学"]
    )
    df = spark.createDataFrame([(1, text), (2, "无关内容")], "id int, t string")
    got = {r["id"]: r["majors"] for r in majors.majors_from_text(df, "id", "t").collect()}
    assert "计算机科学与技术" in got[1] and "法学" in got[1]
    assert "临床医学" not in got[1] and got[1].count("法学") == 1


def test_majors_sentence_supplement(spark):
    df = spark.createDataFrame([(1, "说明。招生专业：法学、护理学、临床医学。")], "id int, t string")
    assert majors.majors_from_text(df, "id", "t").first()["majors"] == ["法学", "护理学", "临床医学"]


def test_unicode_space(value):
    assert value(lambda: expr.strip(F.lit("　国 文　"))) == "国 文"
    assert value(lambda: expr.no_space(F.lit("国　 文"))) == "国文"


def test_code_token_needs_free_standing_digits(value):
    assert value(lambda: values.code_token(F.lit("代码 00101 号"), 5)) == "00101"
    assert value(lambda: values.code_token(F.lit("x00101"), 5)) == "x00101"


def test_deadline_rolls_over(value):
    assert str(value(lambda: values.deadline(F.lit("2026年2月31日")))) == "2026-03-03"
    assert value(lambda: values.deadline(F.lit("未定"))) is None


def test_percent_rounds_half_up(value):
    assert value(lambda: standards.format_percent(F.lit(-0.25))) == "-0.2%"
    assert value(lambda: standards.format_percent(F.lit(2.0))) == "2%"


@pytest.mark.parametrize(
    "raw,want", [("1234", ("123", 4)), ("國英12+", ("國英", 12)), ("國英巧", ("國英", 15)), ("12", None), ("—", None)]
)
def test_cell_parse(value, raw, want):
    got = value(lambda: bands.cell_parse(F.lit(raw)))
    assert (got and (got["expr"], got["min_score"])) == want


@pytest.mark.parametrize(
    "base,href,want",
    [
        ("http://a.cn/x/y.html", "../z.pdf", "http://a.cn/z.pdf"),
        ("http://a.cn/x/y.html", "./z", "http://a.cn/x/z"),
        ("http://a.cn", "z", "http://a.cn/z"),
        ("https://a.cn/x?q=1", "//b.cn/c", "https://b.cn/c"),
        ("http://a.cn/x/y", "/r", "http://a.cn/r"),
        ("http://a.cn/x/y?p=1", "?q=2", "http://a.cn/x/y?q=2"),
        ("http://a.cn/x", "mailto:a@b", "mailto:a@b"),
    ],
)
def test_resolve_url(value, base, href, want):
    assert value(lambda: urls.resolve_url(F.lit(base), F.lit(href))) == want


def test_domain_root(value):
    assert value(lambda: urls.domain_root(F.lit("zsb.pku.edu.cn:80"))) == "pku.edu.cn"
    assert value(lambda: urls.domain_root(F.lit("www.mit.edu"))) == "mit.edu"
    assert value(lambda: urls.domain_root(F.lit("localhost"))) == "localhost"


def test_numbers_take_plain_decimals_only(spark):
    rows = [("12.7",), (" -3 ",), ("1d",), ("nan",), ("99999999999",), ("",), ("5%",)]
    df = spark.createDataFrame(rows, ["v"]).select("v", values.to_int("v").alias("i"), values.percent("v").alias("p"))
    got = {r["v"]: (r["i"], r["p"]) for r in df.collect()}
    assert got == {
        "12.7": (12, 12.7), " -3 ": (-3, -3.0), "1d": (None, None), "nan": (None, None),
        "99999999999": (None, 99999999999.0), "": (None, None), "5%": (None, 5.0),
    }


def test_display_forms(value):
    req = F.create_map(F.lit("國文"), F.lit("均標"), F.lit("英文"), F.lit("--"), F.lit("自然"), F.lit("頂標"))
    assert value(lambda: standards.format_requirement_map(req)) == "國文 均標；自然 頂標"
    assert value(lambda: standards.format_requirement_map(F.create_map(F.lit("x"), F.lit("y")))) == "无明确检定"
    row = lambda a, b: F.struct(F.lit(a).alias("subject"), F.lit(b).alias("standard"))
    assert value(lambda: standards.format_stage_list(F.array(row("國文", " 均標"), row("英文", "-")))) == "國文 均標"


def test_the_rule_that_decides_a_name(spark):
    names = [
        "法学", "AI", "", None, "法", "护理", "音乐", "绘本", "www.法学.cn", "法学2", "五百元法学", "国文", "国文(一)", "葡萄牙语", "130203作曲与作曲技术理论",
        "数据应用", "某某应用", "管理学院行政管理", "计算机科学与技术(方向)", "报名材料", "我们学习。好", "某某某", "计算机", "计算机(一)", "很长" * 40, "法学?", "x）法学（y",
    ]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select("n", T.is_major("n").alias("want"), T.major_verdict("n").alias("v")).collect()
    assert [(r["n"], r["v"]["kept"]) for r in rows] == [(r["n"], r["want"]) for r in rows]
    rule = {r["n"]: r["v"]["rule"] for r in rows}
    want = {"AI": "script", "": "length", "法": "length", "绘本": "fragment", "法学2": "number", "国文(一)": "subject", "葡萄牙语": "language", "数据应用": "applied", "某某某": "weak"}
    assert {n: rule[n] for n in want} == want
    assert {r["v"]["kept"] for r in rows} == {True, False}
