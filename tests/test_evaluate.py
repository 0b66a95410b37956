"""Evaluator traps: score requirements, any-of groups, blanks, boundaries."""

import random

import pytest
from pyspark.sql import functions as F

from cutline.functions import standards, vocab as V
from cutline.operators import evaluate, packed

KEYS = V.SUBJECT_KEYS


def reqs(**std):
    scores = {k: F.lit(v) for k, v in std.pop("scores", {}).items()}
    return evaluate.requirement_struct({k: F.lit(v) for k, v in std.items()}, scores)


def groups(*gs):
    return F.array(*[F.array(*[F.lit(k) for k in g]) for g in gs]) if gs else None


def match(value, req, profile, gs=None, unknown=False):
    return value(lambda: evaluate.match_of(evaluate.prepare(req, gs), evaluate.user_ranks(profile), unknown))


def gap(value, req, profile, gs=None):
    return value(lambda: evaluate.gap_of(evaluate.prepare(req, gs), evaluate.user_ranks(profile)))


def test_any_minimum_score_makes_the_row_unknown(value):
    got = match(value, reqs(chinese="均标", scores={"english": 12}), {"chinese": "底标"})
    assert got == {"status": "unknown", "fit": None, "reason": "包含级分要求（需核对）"}


def test_zero_score_counts_as_absent(value):
    got = match(value, reqs(chinese="均标", scores={"english": 0}), {"chinese": "前标"})
    assert (got["status"], got["fit"]) == ("pass", 1)


def test_no_requirement_is_unknown(value):
    assert match(value, reqs(), {"chinese": "顶标"})["status"] == "unknown"


def test_group_takes_the_smallest_slack_that_passes(value):
    req = reqs(chinese="任一均标", english="任一均标")
    got = match(value, req, {"chinese": "顶标", "english": "前标"}, groups(["chinese", "english"]))
    assert (got["status"], got["fit"]) == ("pass", 1)


def test_overlapping_groups_each_count(value):
    req = reqs(chinese="均标", english="均标", social="底标")
    got = match(
        value, req, {"chinese": "前标", "english": "前标", "social": "均标"},
        groups(["chinese", "english"], ["english", "social"]),
    )
    assert (got["status"], got["fit"]) == ("pass", 2)


def test_equal_maths_mean_either(value):
    assert match(value, reqs(math_a="均标", math_b="均标"), {"math_b": "均标"})["status"] == "pass"
    assert match(value, reqs(math_a="均标", math_b="前标"), {"math_b": "前标"})["status"] == "fail"


@pytest.mark.parametrize("unknown,status", [(True, "unknown"), (False, "fail")])
def test_missing_scores(value, unknown, status):
    got = match(value, reqs(chinese="均标"), {}, unknown=unknown)
    assert got["status"] == status and got["reason"] == "缺少chinese成绩"
    grouped = match(value, reqs(chinese="均标", english="均标"), {}, groups(["chinese", "english"]), unknown)
    assert grouped["status"] == status


def test_group_without_readable_standard(value):
    req = reqs(chinese="看情况", english="均标")
    got = match(value, req, {"chinese": "顶标", "english": "顶标"}, groups(["chinese"]))
    assert (got["status"], got["reason"]) == ("fail", "未满足任一条件")


def test_gap_details_and_text(value):
    req = reqs(chinese="前标", math_a="顶标", math_b="顶标", social="底标")
    profile = {"chinese": "均标", "math_a": "均标", "math_b": "前标", "social": "顶标"}
    got = gap(value, req, profile)
    assert (got["status"], got["max_deficit"]) == ("fail", 1)
    text = value(
        lambda: standards.format_gap(evaluate.gap_of(evaluate.prepare(req, None), evaluate.user_ranks(profile))["details"])
    )
    assert text == "数学B择一差1（前标→顶标）；国文差1（均标→前标）"


def test_gap_and_match_agree_when_all_scores_are_given(spark):
    rows = spark.range(3000).select(
        *[F.pmod(F.hash("id", F.lit(k)), F.lit(6)).alias(k) for k in KEYS],
        *[(F.pmod(F.hash("id", F.lit(k), F.lit(1)), F.lit(5)) + 1).alias("u_" + k) for k in KEYS],
    )
    words = F.array(*[F.lit(w) for w in ("底标", "后标", "均标", "前标", "顶标")])
    req = evaluate.requirement_struct({k: F.when(F.col(k) > 0, F.get(words, F.col(k) - 1)) for k in KEYS})
    user = F.array(*[F.col("u_" + k) for k in KEYS])
    prep = evaluate.prepare(req, F.array(F.array(F.lit("chinese"), F.lit("social"))))
    out = rows.select(evaluate.match_of(prep, user)["status"].alias("m"), evaluate.gap_of(prep, user)["status"].alias("g"))
    assert out.filter("(m = 'pass') <> (g = 'pass')").count() == 0
    assert out.filter("m = 'fail'").count() > 100


def test_export_inheritance_differs(value):
    empty = F.struct(F.lit(None).cast("string").alias("standard"), F.lit(None).cast("int").alias("min_score"))
    row = F.struct(*[empty.alias(k) for k in KEYS])
    general = reqs(chinese="均标")
    assert value(lambda: evaluate.inherit(general, row))["chinese"]["standard"] == "均标"
    assert value(lambda: evaluate.inherit_export(general, row))["chinese"]["standard"] is None


@pytest.mark.parametrize(
    "req,user,score,want",
    [
        ("--", "", "", (True, False)),
        ("12級", "", "", (False, False)),
        ("12級", "", "abc", (False, True)),
        ("12級", "", "13", (True, False)),
        ("前標", "", "", (False, True)),
        ("前標", "均标", "", (False, False)),
        ("A級", "顶标", "", (True, True)),
    ],
)
def test_single_standard(value, req, user, score, want):
    got = value(lambda: evaluate.standard_test(F.lit(req), F.lit(user), F.lit(score)))
    assert (got["ok"], got["unknown"]) == want


def num(v):
    return F.struct(F.lit(float(v)).alias("num"), F.lit(None).cast("string").alias("txt"))


def test_boundary_stops_at_first_null(value):
    none = F.lit(None).cast("struct<num:double,txt:string>")
    items = F.array(F.lit("在校學業成績全校排名百分比"), F.lit("學測國文級分"))
    pct, scores = evaluate.profile_map({"overall": "5"}), evaluate.profile_map({"chinese": "10"})

    def run(*vec):
        return value(lambda: evaluate.boundary_test(items, F.array(*vec), scores, pct))["status"]

    assert run(num(6)) == "pass"
    assert run(num(4)) == "fail"
    assert run(num(5), num(9)) == "pass"
    assert run(num(5), none) == "unknown"
    assert run(none, num(9)) == "unknown"


def test_expression_value_counts_blanks_as_zero(value):
    scores = evaluate.profile_map({"chinese": "12", "english": "", "math_a": "9", "math_b": "11"})

    def run(expr):
        return value(lambda: evaluate.expression_value(F.lit(expr), scores))

    assert run("國文、英文") == 12
    assert run("數學") == 11
    assert run("文") == 12
    assert run("APCS") is None
    assert run("體育") is None


# ---- packed rows against the expressions ------------------------------------------------------

WORDS = [None, "", "底标", "后标", "均标", "前标", "顶标", "任一均标", "任一 前标以上", "任何一科底标", "任何一均标級以上", "前标级以上", "看情况", "- ", "任一", " 顶标\u3000"]


def _random_rows(spark, n=400):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        stds = [rnd.choice(WORDS) for _ in KEYS]
        if i % 3 == 0:
            stds[3] = stds[2]
        scores = [rnd.choice([None, None, None, 0, 0, 12]) if i % 4 == 0 else None for _ in KEYS]
        groups = [rnd.sample(KEYS + ["listen"], rnd.randint(1, 4)) + rnd.choice([[], [KEYS[0]]]) for _ in range(rnd.randint(0, 4))]
        user = [rnd.choice([None, "底标", "均标", "前标以上", "顶标", "?"]) for _ in KEYS]
        rows.append((i, stds, scores, rnd.choice([groups, groups, None]), user))
    df = spark.createDataFrame(rows, "i int, stds array<string>, scores array<int>, choice_groups array<array<string>>, user array<string>")
    reqs = evaluate.requirement_struct({k: F.col("stds")[j] for j, k in enumerate(KEYS)}, {k: F.col("scores")[j] for j, k in enumerate(KEYS)})
    profile = F.struct(*[F.col("user")[j].alias(k) for j, k in enumerate(KEYS)])
    return df.select("i", reqs.alias("reqs"), "choice_groups", profile.alias("profile"))


@pytest.mark.parametrize("groups", ["choice_groups", None, "any_of"])
def test_packed_rows_equal_the_expressions(spark, groups):
    rows = _random_rows(spark)
    rows.persist()
    given = {"choice_groups": F.col("choice_groups"), "any_of": evaluate.any_of_groups(F.col("reqs")), None: None}[groups]
    of = packed.ANY_OF if groups == "any_of" else groups
    prepared = rows.withColumn("p", evaluate.prepare(F.col("reqs"), given)).withColumn("u", evaluate.user_ranks("profile"))
    for unknown in (False, True):
        want = {r["i"]: (r["m"], r["g"]) for r in prepared.select("i", evaluate.match_of(F.col("p"), F.col("u"), unknown).alias("m"), evaluate.gap_of(F.col("p"), F.col("u")).alias("g")).collect()}
        got = {r["i"]: (r["match"], r["gap"]) for r in evaluate.match_and_gap(rows, "profile", groups=of, include_unknown=unknown).collect()}
        assert got == want
    one = {"chinese": "均标", "english": "任一前标以上", "math_b": " 底标 ", "social": "?"}
    ranked = prepared.select("i", evaluate.match_of(F.col("p"), evaluate.user_ranks(one)).alias("m"), evaluate.gap_of(F.col("p"), evaluate.user_ranks(one)).alias("g"))
    assert {r["i"]: r["match"] for r in evaluate.evaluate_rows(rows, one, groups=of).collect()} == {r["i"]: r["m"] for r in ranked.collect()}
    assert {r["i"]: r["gap"] for r in evaluate.gap_rows(rows, one, groups=of).collect()} == {r["i"]: r["g"] for r in ranked.collect()}


def test_packed_plan_has_no_lambda_and_repeats_no_step(spark):
    reqs = evaluate.requirement_struct({k: F.col("id").cast("string") for k in KEYS})
    rows = evaluate.evaluate_rows(spark.range(10).select("id", reqs.alias("reqs")), {"chinese": "均标"}, groups=packed.ANY_OF)
    plan = rows.filter("match.status = 'pass'")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Exchange" not in plan
    assert plan.count("regexp_extract") == len(KEYS)  # a filter on the result copies nothing


def test_more_groups_than_fit_stop_the_query(spark):
    reqs = evaluate.requirement_struct({k: F.lit("均标") for k in KEYS})
    rows = spark.range(1).select(reqs.alias("reqs"), F.array_repeat(F.array(F.lit("chinese")), 9).alias("choice_groups"))
    with pytest.raises(Exception, match="choice groups"):
        evaluate.evaluate_rows(rows, {}).collect()
