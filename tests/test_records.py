"""Result records: parsing, normalising, rows, keep-best with donors, reports, labels."""

import json

from pyspark.sql import functions as F

from cutline.functions import vocab as V
from cutline.operators import dedupe, labels, lookup, majors, records, textrules
from cutline.sources.readers import RESULT

KEYS = V.SUBJECT_KEYS


def parse(spark, raw):
    return textrules.parse_record(spark.createDataFrame([(raw,)], ["raw"]), "raw").first()["extraction"].asDict(recursive=True)


def test_text_subjects_become_a_map(spark):
    raw = '```json\n{"found": true, "department_requirements": [{"department": "理工", "subjects": "数学A、自然", "level": "前标", "other_requirement": "国文均标"},], }\n```'
    got = parse(spark, raw)
    dept = got["department_requirements"][0]
    filled = {k: v["standard"] for k, v in dept["subjects"].items() if v["standard"]}
    assert filled == {"math_a": "前标", "science": "前标", "chinese": "均标"}
    assert dept["notes"] == "前标"


def test_context_choice_fills_general(spark):
    raw = json.dumps(
        {"found": True, "general_requirements": {"chinese": {"standard": "均标", "min_score": None}}, "notes": "国文、英文任一科均标即可"},
        ensure_ascii=False,
    )
    got = parse(spark, raw)["general_requirements"]
    assert (got["chinese"]["standard"], got["english"]["standard"], got["social"]["standard"]) == ("任一均标", "任一均标", None)


def test_kinds_decide_not_characters(spark):
    depts = [
        {"subjects": "{国文", "level": "均标"}, {"subjects": ["英文"], "notes": "x"}, "英文", None, 7,
        {"subjects": {"english": "前标", "social": {"standard": "后标", "min_score": "12"}}, "notes": 5, "majors": ["甲", 1, None]},
        {"subjects": None, "requirement": ["国文任一科均标"]},
    ]
    raw = {"found": "true", "year": "2026", "general_requirements": "国文", "other_conditions": ["a", {"b": 1}, None], "department_requirements": depts}
    got = parse(spark, json.dumps(raw, ensure_ascii=False))
    assert (got["found"], got["year"], got["other_conditions"], got["majors"]) == (True, 2026, ["a"], [])
    assert all(got["general_requirements"][k]["standard"] is None for k in KEYS)
    rows = [({k: tuple(v.values()) for k, v in d["subjects"].items() if v["standard"]}, d["notes"], d["majors"]) for d in got["department_requirements"]]
    assert rows == [({"chinese": ("均标", None)}, "均标", []), ({}, "x", []), ({"social": ("后标", 12)}, "5", ["甲"]), ({}, None, [])]


def test_a_list_is_no_record(spark):
    got = parse(spark, "[1, 2]")
    assert (got["found"], got["confidence"], got["error"], got["department_requirements"]) == (False, "low", "提取结构异常", [])


def test_unreadable_output(spark):
    got = parse(spark, "sorry, nothing")
    assert got["found"] is False and got["confidence"] == "low"


def result(spark, rows):
    return spark.read.schema("r " + RESULT).json(
        spark.sparkContext.parallelize([json.dumps({"r": r}, ensure_ascii=False) for r in rows])
    ).select("r.*")


def rec(sid, status="success", found=True, depts=(), majors_=(), conf="high", length=0, std="均标", **kw):
    ext = {
        "found": found, "confidence": conf, "majors": list(majors_),
        "general_requirements": {"chinese": {"standard": std, "min_score": None}},
        "department_requirements": [
            {"department": d, "subjects": {k: {"standard": None, "min_score": None} for k in KEYS}, "notes": n, "majors": list(m)}
            for d, n, m in depts
        ],
        "other_conditions": ["c1", "c2", "c3"], "application_deadline": "2026-03-01",
    }
    ext.update(kw.pop("ext", {}))
    return {"school_id": sid, "school_name": "n" + sid, "status": status, "raw_text_length": length, "extraction": ext, **kw}


def test_rows_inherit_and_export_does_not(spark):
    df = result(spark, [rec("1", depts=[("文", "n1", []), ("", None, [])]), rec("2"), rec("3", status="failed")])
    rows = {(r["school_id"], r["idx"]): r for r in records.evaluation_rows(df).collect()}
    assert sorted(rows) == [("1", 0), ("1", 1), ("2", 0)]
    assert rows[("1", 0)]["reqs"]["chinese"]["standard"] == "均标"
    assert rows[("1", 0)]["other_text"] == "c1；c2；n1" and rows[("1", 1)]["other_text"] == ""
    assert rows[("1", 1)]["label"] == rows[("2", 0)]["label"] == "全部"
    out = {(r["school_name"], r["label"]): r for r in records.export_rows(records.export_record(df)).collect()}
    assert out[("n1", "文")]["chinese"] == "-" and out[("n2", "全部")]["chinese"] == "均标"
    assert out[("n1", "文")]["other_conditions"] == "n1; c1; c2; c3" and ("n3", "全部") in out
    spans = {(r["school_id"], r["idx"]): r["row_span"] for r in records.detail_rows(df).collect()}
    assert spans == {("1", 0): 2, ("1", 1): 0, ("2", 0): 1}


def test_keep_best_completes_lists(spark):
    rows = [
        rec("1", conf="low", majors_=["甲", "乙"], depts=[("文", None, ["x"])], length=900),
        rec("1", conf="high", majors_=["乙", "丙"], depts=[(" 文 ", None, ["y"]), ("理", None, [])], length=10),
        rec("1", status="failed", majors_=["丁"]),
        rec("2", std=None, conf="high", length=500),
        rec("2", conf="low", length=1),
    ]
    df = result(spark, rows).withColumn("arrival", F.monotonically_increasing_id())
    got = {r["school_id"]: r for r in dedupe.keep_best_results(df).collect()}
    one = got["1"]["extraction"]
    assert one["confidence"] == "high" and one["majors"] == ["乙", "丙", "甲", "丁"]
    assert [d["majors"] for d in one["department_requirements"]] == [["y", "x"], []]
    assert got["2"]["extraction"]["confidence"] == "low"


def test_a_lone_record_keeps_its_lists(spark):
    lone = rec("1", majors_=[" m1", " m1"], depts=[("A", None, ["x"]), ("A", None, ["y"])])
    other = rec("2", majors_=["a"], depts=[("A", None, ["x"]), ("A", None, ["y"])])
    df = result(spark, [lone, other, rec("2", conf="low", depts=[("A", None, ["z"])])])
    got = {r["school_id"]: r["extraction"] for r in dedupe.keep_best_results(df.withColumn("arrival", F.monotonically_increasing_id())).collect()}
    assert got["1"]["majors"] == [" m1", " m1"] and [d["majors"] for d in got["1"]["department_requirements"]] == [["x"], ["y"]]
    assert [d["majors"] for d in got["2"]["department_requirements"]] == [["x", "z"], ["y", "z"]]


def test_recategorise_and_reports(spark):
    df = result(
        spark,
        [
            rec("1", status="failed", ext={"error": "内容过短", "notes": "旧"}),
            rec("2", status="failed", ext={"error": "timeout"}, length=7),
            rec("3", std=None),
        ],
    )
    fixed = records.recategorise(df)
    rows = {r["school_id"]: r for r in fixed.collect()}
    assert rows["1"]["status"] == "not_found" and rows["1"]["extraction"]["notes"] == "旧 " + V.SHORT_FAILURE_NOTE
    schools = spark.createDataFrame([("1", "甲")], "id string, name string")
    listed = records.unresolved_rows(fixed, schools).collect()
    assert [r["school_id"] for r in listed] == ["2", "1"]
    assert [r["school_id"] for r in records.follow_up_rows(fixed, schools).collect()] == ["3"]


def test_rule_note_and_review_note(spark):
    df = spark.createDataFrame([("国文达到均标",), ("报名要求 招生计划 学院 专业",)], ["t"])
    raw = df.withColumn("raw", F.lit('{"found": true, "confidence": "high"}'))
    done = textrules.add_review_note(textrules.fill_from_text(textrules.parse_record(raw, "raw"), "extraction", "t"), "extraction", "t")
    first, second = [r["extraction"] for r in done.orderBy(F.length("t")).collect()]
    assert first["general_requirements"]["chinese"]["standard"] == "均标" and first["notes"] == V.RULE_NOTE
    assert first["confidence"] == "high" and second["confidence"] == "medium" and second["notes"] == V.REVIEW_NOTE


def test_majors_attach_and_backfill(spark):
    df = result(spark, [rec("1", depts=[("法学、护理学", None, []), ("文", None, ["已有"])])]).withColumn("m", F.array(F.lit("医学")))
    ext = majors.attach_majors(df, "extraction", "m").first()["extraction"]
    assert ext["majors"] == ["医学"] and [d["majors"] for d in ext["department_requirements"]] == [["法学", "护理学"], ["已有"]]
    lists = spark.createDataFrame([(["首页", "法学"], [])], "b array<string>, n array<string>")
    assert lists.select(majors.backfill_majors("b", "n", True).alias("v")).first()["v"] == ["法学"]
    assert lists.select(majors.backfill_majors("b", "n", False).alias("v")).first()["v"] == ["首页", "法学"]


def test_row_and_school_majors(spark):
    rows = [("s", ["会计学"], "全部", ["法学"]), ("s", [], "护理学、法学", ["法学"]), ("s", [], "全部", ["法学"])]
    df = spark.createDataFrame(rows, "s string, rm array<string>, label string, sm array<string>")
    df = df.withColumn("m", majors.row_majors("rm", "label", "sm"))
    assert sorted(r["m"] for r in df.collect()) == [["会计学"], ["护理学", "法学"], ["法学"]]
    assert majors.school_majors(df, "s", "sm", "m").first()["school_majors"] == ["法学", "会计学", "护理学"]


def test_label_sync(spark):
    schools = spark.createDataFrame(
        [("1", "北京大学", "", "见 http://www.pku.edu.cn/zs"), ("2", "某某大学(北京)", "双一流", None), ("3", "第三大学", "", "http://x.cn")],
        "id string, name string, type string, zsjz_url string",
    )
    texts = spark.createDataFrame([("985", "北 京 大 学"), ("211", "某某大学")], "set_name string, t string")
    matched = labels.authority_sets(schools, "name", texts, "set_name", "t")
    domains = spark.createDataFrame([("名册 https:// pku.edu.cn）",)], ["t"])
    reference = spark.createDataFrame([("第三大学", "211", 2), ("第三大学", "985", 1)], "name string, set_name string, precedence int")
    listed = spark.createDataFrame([("第三大学",)], ["name"])
    out = labels.label_schools(schools, matched, domains, "t", reference, listed)
    got = {r["id"]: (r["tier"], r["tier_source"], r["taiwan_recognized"], r["taiwan_source"]) for r in out.collect()}
    assert got == {
        "1": ("985", "online_moe_985", True, "online_tw_moe_domain"),
        "2": ("211", "online_moe_211", False, "online_tw_moe_domain"),
        "3": ("985", "fallback_local", True, "fallback_local"),
    }
    counts = {r["tier"]: (r["n"], r["recognised"]) for r in labels.tier_report(out).collect()}
    assert counts == {"985": (2, 2), "211": (1, 0), "双一流": (0, 0), "非双一流": (0, 0), "total": (3, 2)}


def test_donor_lists(spark):
    rows = spark.createDataFrame([("1", " a ", ["x"]), ("1", "", ["q"]), ("2", "a", None)], "k string, l string, v array<string>")
    donors = spark.createDataFrame([("1", "a", 0, ["y", "x"]), ("1", "a", 1, ["z"]), ("1", "", 2, ["w"])], "k string, l string, p int, v array<string>")
    got = {(r["k"], r["l"]): r["v"] for r in lookup.donor_lists(rows, donors, "k", "l", "p", "v").collect()}
    assert got == {("1", " a "): ["x", "y"], ("1", ""): ["q"], ("2", "a"): None}
