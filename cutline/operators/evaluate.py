"""Requirement rows against candidate profiles.

A profile is either a Python dict (one candidate, all rows) or columns already on the
row (an application table joined by key). Every evaluator is a projection: no shuffle,
no UDF, filters before it are pushed to the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.expr import blank_to_null, c, contains_any, js_number, let, lookup, no_space, number_text, parens, strip, text
from ..functions.standards import is_present, listening_rank, normalise_word, parse_standard, subject_key
from ..functions.text import distinct_groups
from ..functions.values import percent_in_range
from . import packed

KEYS = V.SUBJECT_KEYS
EMPTY_REQ = "struct<standard:string,min_score:int>"


def requirement_struct(standards: Mapping[str, Column], scores: Mapping[str, Column] | None = None) -> Column:
    """D6 subject map from per-subject columns."""
    scores = scores or {}
    return F.struct(
        *[
            F.struct(
                standards.get(k, F.lit(None)).cast("string").alias("standard"),
                scores.get(k, F.lit(None)).cast("int").alias("min_score"),
            ).alias(k)
            for k in KEYS
        ]
    )


def inherit(general: Column, row: Column | None) -> Column:
    """The row's requirement where it has one, else the general one."""
    fields = []
    for key in KEYS:
        g = F.when(is_present(general[key]), general[key])
        if row is not None:
            g = F.coalesce(F.when(is_present(row[key]), row[key]), g)
        fields.append(F.coalesce(g, F.lit(None).cast(EMPTY_REQ)).alias(key))
    return F.struct(*fields)


def inherit_export(general: Column, row: Column | None) -> Column:
    """E1, export form: a present but empty row object still hides the general one (Q9)."""
    fields = [
        (F.coalesce(row[k], general[k]) if row is not None else general[k]).alias(k) for k in KEYS
    ]
    return F.struct(*fields)


def any_of_groups(reqs: Column) -> Column:
    """Subjects that share an any-of base, in subject order, two or more."""
    stds = F.array(*[reqs[k]["standard"] for k in KEYS])
    names = F.array(*[F.lit(k) for k in KEYS])
    parsed = F.transform(stds, lambda s, i: F.struct(F.get(names, i).alias("key"), parse_standard(s).alias("p")))
    marked = F.filter(parsed, lambda x: x["p"]["any"] & x["p"]["rank"].isNotNull())

    def grouped(m: Column) -> Column:
        bases = F.array_distinct(F.transform(m, lambda x: x["p"]["base"]))
        return F.transform(
            bases, lambda b: F.transform(F.filter(m, lambda x: x["p"]["base"] == b), lambda x: x["key"])
        )

    return F.filter(let(marked, grouped), lambda g: F.size(g) >= 2)


def merge_groups(*lists: Column) -> Column:
    """U8 over several group lists."""
    empty = F.array().cast("array<array<string>>")
    return distinct_groups(F.concat(*[F.coalesce(x, empty) for x in lists]))


def user_ranks(profile: Mapping[str, str] | Column | str) -> Column:
    """Candidate standards (a dict or a struct column) to ranks in subject order; null where none is given."""
    if isinstance(profile, Mapping):
        return F.array(*[parse_standard(F.lit(profile.get(k)).cast("string"))["rank"] for k in KEYS])
    col = c(profile)
    return F.transform(F.array(*[col[k] for k in KEYS]), lambda s: parse_standard(s)["rank"])


def _index_groups(groups: Column | None) -> Column:
    if groups is None:
        return F.array().cast("array<array<int>>")
    index = {k: i for i, k in enumerate(KEYS)}
    named = F.coalesce(groups, F.array().cast("array<array<string>>"))
    # A name that is no subject must not make the tests on the group null.
    return F.transform(named, lambda g: F.array_compact(F.transform(g, lambda k: lookup(k, index))))


def prepare(reqs: Column, groups: Column | None) -> Column:
    """Requirement row as small integers, without the candidate: ranks in subject order,
    any-of targets and the remaining subjects as 0-based indexes.

    Compute it on the requirement table before candidates are joined. Steps are bound
    with ``let`` instead of helper columns: a filter on a result is pushed below the
    projection, and helper columns would multiply there.
    """
    base = F.struct(
        F.transform(F.array(*[reqs[k]["standard"] for k in KEYS]), lambda s: parse_standard(s)).alias("p"),
        F.array(*[F.coalesce(is_present(reqs[k]), F.lit(False)) for k in KEYS]).alias("has"),
        F.array(*[F.coalesce(reqs[k]["min_score"], F.lit(0)) != 0 for k in KEYS]).alias("ms"),
        _index_groups(groups).alias("g"),
    )

    def with_pair(x: Column) -> Column:
        """Equal requirements for both maths mean either one."""
        a, b = F.get(x["p"], F.lit(2)), F.get(x["p"], F.lit(3))
        pair = (
            a["rank"].isNotNull()
            & (a["rank"] == b["rank"])
            & (a["base"] == b["base"])
            & ~F.exists(x["g"], lambda g: F.array_contains(g, 2) & F.array_contains(g, 3))
        )
        added = F.when(F.coalesce(pair, F.lit(False)), F.array(F.array(F.lit(2), F.lit(3)))).otherwise(
            F.array().cast("array<array<int>>")
        )
        return F.struct(
            F.transform(x["p"], lambda p: p["rank"]).alias("rr"),
            x["has"].alias("has"),
            F.exists(x["has"], lambda h: h).alias("any_req"),
            F.exists(x["ms"], lambda h: h).alias("scored"),
            F.concat(x["g"], added).alias("g"),
        )

    def with_targets(x: Column) -> Column:
        targets = F.filter(
            F.transform(x["g"], lambda g: F.filter(g, lambda k: F.get(x["has"], k))), lambda t: F.size(t) > 0
        )
        return F.struct(*[x[n].alias(n) for n in ("rr", "any_req", "scored", "has")], targets.alias("t"))

    def with_rest(x: Column) -> Column:
        """Subjects outside every group that carry a readable standard, in subject order."""
        used = F.flatten(x["t"])
        rest = F.filter(
            F.array(*[F.lit(i) for i in range(len(KEYS))]),
            lambda k: F.get(x["has"], k)
            & F.get(x["rr"], k).isNotNull()
            & ~F.coalesce(F.array_contains(used, k), F.lit(False)),
        )
        return F.struct(*[x[n].alias(n) for n in ("rr", "any_req", "scored", "t")], rest.alias("rest"))

    return let(let(let(base, with_pair), with_targets), with_rest)


def _meet(prepared: Column, ranks: Column) -> Column:
    return F.struct(*[prepared[n].alias(n) for n in ("rr", "any_req", "scored", "t", "rest")], ranks.alias("ur"))


def match_of(prepared: Column, ranks: Column, include_unknown: bool = False) -> Column:
    """struct(status, fit, reason) of a prepared row and a candidate's ranks; smaller fit
    is closer (Q2-Q4)."""
    unk = F.lit(include_unknown)
    names = F.array(*[F.lit(k) for k in KEYS])

    def tested(x: Column) -> Column:
        def slack(k: Column) -> Column:
            rr, ur = F.get(x["rr"], k), F.get(x["ur"], k)
            return F.when(ur >= rr, ur - rr)

        def group(t: Column) -> Column:
            given = F.exists(t, lambda k: F.get(x["rr"], k).isNotNull() & F.get(x["ur"], k).isNotNull())
            return F.struct(F.array_min(F.transform(t, slack)).alias("best"), given.alias("given"))

        def single(k: Column) -> Column:
            return F.struct(k.alias("k"), F.get(x["ur"], k).isNull().alias("missing"), slack(k).alias("slack"))

        return F.struct(
            x["any_req"].alias("any_req"),
            x["scored"].alias("scored"),
            F.transform(x["t"], group).alias("or"),
            F.transform(x["rest"], single).alias("and"),
        )

    def first_bad(x: Column) -> Column:
        total = F.aggregate(x["or"], F.lit(0), lambda s, g: s + F.coalesce(g["best"], F.lit(0))) + F.aggregate(
            x["and"], F.lit(0), lambda s, a: s + F.coalesce(a["slack"], F.lit(0))
        )
        return F.struct(
            x["any_req"].alias("any_req"),
            x["scored"].alias("scored"),
            F.get(F.filter(x["or"], lambda g: g["best"].isNull()), F.lit(0)).alias("g"),
            F.get(F.filter(x["and"], lambda a: a["slack"].isNull()), F.lit(0)).alias("a"),
            total.alias("fit"),
        )

    def verdict(x: Column) -> Column:
        def out(status: str, reason) -> Column:
            why = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
            return F.struct(
                F.lit(status).alias("status"), F.lit(None).cast("int").alias("fit"), why.alias("reason")
            )

        missing = F.concat(F.lit("缺少"), F.get(names, x["a"]["k"]), F.lit("成绩"))
        passed = F.struct(
            F.lit("pass").alias("status"), x["fit"].alias("fit"), F.lit(None).cast("string").alias("reason")
        )
        return (
            F.when(~x["any_req"], out("unknown", "无科目要求"))
            .when(x["scored"], out("unknown", "包含级分要求（需核对）"))
            .when(x["g"].isNotNull() & unk & ~x["g"]["given"], out("unknown", "缺少可判定成绩"))
            .when(x["g"].isNotNull(), out("fail", "未满足任一条件"))
            .when(x["a"].isNotNull() & x["a"]["missing"], F.when(unk, out("unknown", missing)).otherwise(out("fail", missing)))
            .when(x["a"].isNotNull(), out("fail", "科目未达标"))
            .otherwise(passed)
        )

    return let(let(let(let(prepared, lambda p: _meet(p, ranks)), tested), first_bad), verdict)


GAP_DETAIL = "array<struct<kind:string,key:string,required:int,user:int,deficit:int>>"


def gap_of(prepared: Column, ranks: Column) -> Column:
    """struct(status, max_deficit, details, reason): what a failing row is short of."""
    names = F.array(*[F.lit(k) for k in KEYS])

    def tested(x: Column) -> Column:
        def option(k: Column, i: Column) -> Column:
            rr, ur = F.get(x["rr"], k), F.get(x["ur"], k)
            return F.when(
                rr.isNotNull() & ur.isNotNull(),
                F.struct(
                    F.greatest(F.lit(0), rr - ur).alias("deficit"), i.alias("i"), k.alias("k"), rr.alias("rr"), ur.alias("ur")
                ),
            )

        return F.struct(
            x["any_req"].alias("any_req"),
            x["scored"].alias("scored"),
            F.transform(x["t"], lambda t: F.array_min(F.transform(t, option))).alias("or"),
            F.transform(x["rest"], lambda k, i: F.struct(k.alias("k"), option(k, i).alias("o"))).alias("and"),
        )

    def detail(kind: str):
        return lambda o: F.struct(
            F.lit(kind).alias("kind"),
            F.get(names, o["k"]).alias("key"),
            o["rr"].alias("required"),
            o["ur"].alias("user"),
            o["deficit"].alias("deficit"),
        )

    def collected(x: Column) -> Column:
        short = F.concat(
            F.transform(F.filter(x["or"], lambda b: b["deficit"] > 0), detail("or")),
            F.transform(F.filter(F.transform(x["and"], lambda a: a["o"]), lambda o: o["deficit"] > 0), detail("and")),
        )
        return F.struct(
            x["any_req"].alias("any_req"),
            x["scored"].alias("scored"),
            F.exists(x["or"], lambda b: b.isNull()).alias("no_option"),
            F.get(F.filter(x["and"], lambda a: a["o"].isNull()), F.lit(0)).alias("missing"),
            short.cast(GAP_DETAIL).alias("d"),
        )

    def verdict(x: Column) -> Column:
        def unknown(reason) -> Column:
            why = reason if isinstance(reason, Column) else F.lit(reason)
            return F.struct(
                F.lit("unknown").alias("status"),
                F.lit(None).cast("int").alias("max_deficit"),
                F.array().cast(GAP_DETAIL).alias("details"),
                why.alias("reason"),
            )

        deepest = F.coalesce(F.array_max(F.transform(x["d"], lambda d: d["deficit"])), F.lit(0))
        known = F.struct(
            F.when(F.size(x["d"]) == 0, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
            deepest.alias("max_deficit"),
            x["d"].alias("details"),
            F.lit(None).cast("string").alias("reason"),
        )
        missing = F.concat(F.lit("缺少"), F.get(names, x["missing"]["k"]), F.lit("成绩"))
        return (
            F.when(~x["any_req"], unknown("无科目要求"))
            .when(x["scored"], unknown("包含级分要求（需核对）"))
            .when(x["no_option"], unknown("缺少可判定成绩"))
            .when(x["missing"].isNotNull(), unknown(missing))
            .otherwise(known)
        )

    return let(let(let(let(prepared, lambda p: _meet(p, ranks)), tested), collected), verdict)


def evaluate_rows(
    df: DataFrame,
    profile: Mapping[str, str] | str,
    reqs: str = "reqs",
    groups: str | object | None = "choice_groups",
    include_unknown: bool = False,
    out: str = "match",
) -> DataFrame:
    """E2 as a column of the rows, by packed integers. ``groups`` is a column, ``packed.ANY_OF`` or None."""
    rows, ranks = packed.with_ranks(packed.pack(df, reqs, groups), profile)
    return packed.match(rows, ranks, packed.slots_of(groups), include_unknown, out=out).drop("_packed", "_ranks")


def gap_rows(
    df: DataFrame,
    profile: Mapping[str, str] | str,
    reqs: str = "reqs",
    groups: str | object | None = "choice_groups",
    out: str = "gap",
) -> DataFrame:
    """E3 as a column of the rows, by packed integers."""
    rows, ranks = packed.with_ranks(packed.pack(df, reqs, groups), profile)
    return packed.gap(rows, ranks, packed.slots_of(groups), out=out).drop("_packed", "_ranks")


def match_and_gap(
    df: DataFrame,
    profile: Mapping[str, str] | str,
    reqs: str = "reqs",
    groups: str | object | None = "choice_groups",
    include_unknown: bool = False,
) -> DataFrame:
    """E2 and E3 together; the row is packed once for both."""
    rows, ranks = packed.with_ranks(packed.pack(df, reqs, groups), profile)
    slots = packed.slots_of(groups)
    return packed.gap(packed.match(rows, ranks, slots, include_unknown), ranks, slots).drop("_packed", "_ranks")


# ---- programme side -------------------------------------------------------------


def profile_map(values: Mapping[str, object]) -> Column:
    """String map literal of one candidate's inputs."""
    if not values:
        return F.create_map().cast("map<string,string>")
    pairs = []
    for key, value in values.items():
        pairs += [F.lit(key), F.lit(None if value is None else str(value)).cast("string")]
    return F.create_map(*pairs)


def standard_test(req_std: Column, user_std: Column, user_score: Column, ranks: Mapping[str, int] = V.STANDARD_RANK) -> Column:
    """E5: struct(ok, unknown, reason) of one standard, ordinal or numeric (Q5)."""
    inputs = F.struct(
        normalise_word(req_std).alias("word"),
        blank_to_null(F.regexp_extract(text(req_std), r"(\d{1,2})", 1)).cast("double").alias("need"),
        js_number(user_score).alias("score"),
        normalise_word(user_std).alias("have_word"),
    )

    def result(ok: bool | Column, unknown: bool, reason: Column | None) -> Column:
        ok = ok if isinstance(ok, Column) else F.lit(ok)
        why = F.lit(None).cast("string") if reason is None else reason
        return F.struct(ok.alias("ok"), F.lit(unknown).alias("unknown"), why.alias("reason"))

    def test(x: Column) -> Column:
        word, need, score, have_word = x["word"], x["need"], x["score"], x["have_word"]
        rank, have = lookup(word, ranks), lookup(have_word, ranks)
        low = F.concat(F.lit("级分不足("), number_text(score), F.lit("<"), number_text(need), F.lit(")"))
        short = F.concat(F.lit("未达标("), have_word, F.lit("<"), word, F.lit(")"))
        return (
            F.when(word == "", result(True, False, None))
            .when(need.isNotNull() & score.isNull(), result(False, True, F.lit("缺少级分")))
            .when(need.isNotNull(), result(score >= need, False, F.when(score < need, low)))
            .when(rank.isNull(), result(True, True, F.lit("要求解析失败")))
            .when(have.isNull(), result(False, True, F.lit("缺少五标")))
            .when(have < rank, result(False, False, short))
            .otherwise(result(True, False, None))
        )

    return let(inputs, test)


def requirement_test(entries: Column, stds: Column, scores: Column, ranks: Mapping[str, int] = V.STANDARD_RANK) -> Column:
    """struct(status, reason) of an ordered (subject, standard) list; the first failure decides."""
    tested = F.transform(
        F.filter(entries, lambda e: subject_key(e["subject"]) != ""),
        lambda e: F.struct(
            e["subject"].alias("subject"),
            standard_test(
                e["standard"],
                F.element_at(stds, subject_key(e["subject"])),
                F.element_at(scores, subject_key(e["subject"])),
                ranks,
            ).alias("r"),
        ),
    )
    tested = F.coalesce(tested, F.array().cast("array<struct<subject:string,r:struct<ok:boolean,unknown:boolean,reason:string>>>"))
    return let(tested, _summary)


def _summary(tested: Column) -> Column:
    failed = F.get(F.filter(tested, lambda t: ~t["r"]["ok"]), F.lit(0))
    unknown = F.exists(tested, lambda t: t["r"]["unknown"])
    why = F.concat(failed["subject"], F.coalesce(F.concat(F.lit("："), failed["r"]["reason"]), F.lit("")))
    return (
        F.when(failed.isNotNull(), F.struct(F.lit("fail").alias("status"), why.alias("reason")))
        .when(unknown, F.struct(F.lit("unknown").alias("status"), F.lit("部分科目缺少五标/级分").alias("reason")))
        .otherwise(F.struct(F.lit("pass").alias("status"), F.lit(None).cast("string").alias("reason")))
    )


def map_entries_of(requirements: Column | str) -> Column:
    """Requirement map as ordered (subject, standard) entries."""
    return F.transform(
        F.map_entries(c(requirements)), lambda e: F.struct(e["key"].alias("subject"), e["value"].alias("standard"))
    )


def tie_item_value(item: Column, scores: Column, pct: Column) -> Column:
    """struct(num, txt) the candidate brings for a tie-break item; null when unknown."""
    return let(strip(text(item)), lambda s: _tie_value(s, scores, pct))


def _tie_value(s: Column, scores: Column, pct: Column) -> Column:

    def num(v: Column) -> Column:
        return F.when(v.isNotNull(), F.struct(v.cast("double").alias("num"), F.lit(None).cast("string").alias("txt")))

    def pct_of(key: Column) -> Column:
        return percent_in_range(F.element_at(pct, key))

    def score_of(key: Column) -> Column:
        return js_number(F.element_at(scores, key))

    overall = s.contains("在校學業成績") & s.contains("全校排名百分比")
    subject_pct = s.contains("學業成績") & s.contains("總平均") & s.contains("全校排名百分比")
    pct_key = lookup(strip(F.regexp_extract(s, "^(.+?)學業成績", 1)), V.PERCENT_SUBJECTS)
    one_score = s.contains("學測") & s.contains("級分")
    score_key = blank_to_null(subject_key(F.regexp_extract(s, "學測(.+?)級分", 1)))
    summed = s.contains("級分總和")
    parts = [
        (s.contains("國文"), "chinese"),
        (s.contains("英文"), "english"),
        (contains_any(s, ["社會", "社会"]), "social"),
        (contains_any(s, ["數學A", "数学A"]), "math_a"),
        (contains_any(s, ["數學B", "数学B"]), "math_b"),
        (s.contains("自然"), "science"),
    ]
    total = F.lit(0.0)
    for present, key in parts:
        total = total + F.when(present, score_of(F.lit(key))).otherwise(0.0)
    listen = blank_to_null(strip(text(F.element_at(scores, F.lit("listen")))))
    return (
        F.when(overall, num(pct_of(F.lit("overall"))))
        .when(subject_pct, F.when(pct_key.isNotNull(), num(pct_of(pct_key))))
        .when(one_score, F.when(score_key.isNotNull(), num(score_of(score_key))))
        .when(summed, num(total))
        .when(
            s.contains("英聽") & s.contains("等級"),
            F.when(listen.isNotNull(), F.struct(F.lit(None).cast("double").alias("num"), listen.alias("txt"))),
        )
    )


_OUTCOME = "struct<status:string,reason:string>"


def _outcome(status: str, reason: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), reason.alias("reason"))


def boundary_test(items: Column | str, vec: Column | str, scores: Column, pct: Column) -> Column:
    """Candidate against a boundary vector, first difference decides (Q14)."""
    v = F.coalesce(c(vec), F.array().cast("array<struct<num:double,txt:string>>"))
    first_null = F.array_position(F.transform(v, lambda x: x.isNull()), True)
    limit = F.when(first_null > 0, first_null.cast("int") - 1).otherwise(F.size(v))
    pairs = F.transform(
        F.slice(v, F.lit(1), limit),
        lambda b, i: F.struct(F.coalesce(F.get(c(items), i), F.lit("")).alias("item"), b.alias("b")),
    )

    def against(item: Column, b: Column, u: Column) -> Column:
        both = b["num"].isNotNull() & u["num"].isNotNull()
        pct_item = item.contains("百分比") & both
        score_item = contains_any(item, ["級分", "级分", "總和", "总和"]) & both
        listen_item = contains_any(item, ["英聽", "英听"])
        b_text = F.coalesce(b["txt"], number_text(b["num"]))
        u_text = F.coalesce(u["txt"], number_text(u["num"]))
        br, ur = listening_rank(b_text), listening_rank(u_text)
        better = _outcome("pass", F.concat(F.lit("优于边界："), item))
        worse = _outcome("fail", F.concat(F.lit("劣于边界："), item))
        open_ = F.lit(None).cast(_OUTCOME)
        return (
            F.when(u.isNull(), _outcome("unknown", F.concat(F.lit("缺少比序项："), item)))
            .when(pct_item, F.when(u["num"] < b["num"], better).when(u["num"] > b["num"], worse).otherwise(open_))
            .when(score_item, F.when(u["num"] > b["num"], better).when(u["num"] < b["num"], worse).otherwise(open_))
            .when(listen_item, F.when(ur > br, better).when(ur < br, worse).otherwise(open_))
            .when(u_text != b_text, _outcome("unknown", F.concat(F.lit("无法比较："), item)))
            .otherwise(open_)
        )

    def step(acc: Column, x: Column) -> Column:
        item, b = x["item"], x["b"]
        verdict = let(tie_item_value(item, scores, pct), lambda u: against(item, b, u))
        return F.when(acc.isNotNull(), acc).otherwise(verdict)

    settled = F.aggregate(pairs, F.lit(None).cast(_OUTCOME), step)
    return F.when(limit == 0, _outcome("unknown", F.lit("无有效边界"))).otherwise(
        F.coalesce(settled, _outcome("unknown", F.lit("与边界持平（不确定）")))
    )


def normal_expression(expr: Column | str) -> Column:
    """SF31."""
    return F.regexp_replace(parens(no_space(strip(text(expr)))), "[：:，,、。\\.|]+", "")


def expression_value(expr: Column | str, scores: Column, blank_is_null: bool = False) -> Column:
    """Candidate total for a combined-subject expression; null when it cannot be read (Q6)."""
    return let(F.upper(normal_expression(expr)), lambda s: _expression_total(s, scores, blank_is_null))


def _expression_total(s: Column, scores: Column, blank_is_null: bool) -> Column:
    def score(key: str) -> Column:
        raw = F.element_at(scores, F.lit(key))
        value = js_number(raw)
        return F.when(strip(text(raw)) != "", value) if blank_is_null else value

    math_a = contains_any(s, ["數學A", "数学A", "數A", "数A"])
    math_b = contains_any(s, ["數學B", "数学B", "數B", "数B"])
    english = s.contains("英")
    chinese = contains_any(s, ["國", "国"]) | (s.contains("文") & ~english)
    social, science = s.contains("社"), s.contains("自")
    plain = contains_any(s, ["數", "数"]) & ~math_a & ~math_b
    either = F.greatest(score("math_a"), score("math_b"))
    flags = [
        (english, score("english")),
        (chinese, score("chinese")),
        (math_a, score("math_a")),
        (math_b, score("math_b")),
        (social, score("social")),
        (science, score("science")),
        (plain, either),
    ]
    total, any_flag = F.lit(0.0), F.lit(False)
    for flag, value in flags:
        total = total + F.when(flag, value).otherwise(0.0)
        any_flag = any_flag | flag
    return F.when((s != "") & ~s.contains("APCS") & any_flag, total)


def sieve_test(orders: Column | str, scores: Column) -> Column:
    """Candidate against ordered screening minima."""
    rows = F.array_sort(
        F.transform(
            F.filter(
                F.coalesce(c(orders), F.array().cast("array<struct<order:int,expr:string,min_score:int,raw:string>>")),
                lambda r: r.isNotNull(),
            ),
            lambda r, i: F.struct(
                F.coalesce(r["order"], F.lit(0)).alias("o"),
                i.alias("i"),
                strip(F.coalesce(blank_to_null(r["expr"]), r["raw"], F.lit(""))).alias("e"),
                r["min_score"].cast("double").alias("need"),
            ),
        )
    )

    def against(r: Column, u: Column) -> Column:
        return (
            F.when((r["e"] == "") | r["need"].isNull(), F.lit(None).cast(_OUTCOME))
            .when(u.isNull(), _outcome("unknown", F.concat(F.lit("缺少个申比对项："), r["e"])))
            .when(u > r["need"], _outcome("pass", F.concat(F.lit("优于个申筛选边界："), r["e"])))
            .when(u < r["need"], _outcome("fail", F.concat(F.lit("低于个申筛选边界："), r["e"])))
            .otherwise(F.lit(None).cast(_OUTCOME))
        )

    def step(acc: Column, r: Column) -> Column:
        verdict = let(expression_value(r["e"], scores), lambda u: against(r, u))
        return F.when(acc.isNotNull(), acc).otherwise(verdict)

    settled = F.aggregate(rows, F.lit(None).cast(_OUTCOME), step)
    return F.when(F.size(rows) == 0, _outcome("unknown", F.lit("无筛选最低级分"))).otherwise(
        F.coalesce(settled, _outcome("unknown", F.lit("与个申边界持平（不确定）")))
    )


def sieve_year_stats(
    history: DataFrame, key: str, status: str, year: str, years: Sequence[int], programs: DataFrame | None = None
) -> DataFrame:
    """pass/fail/unknown counts over a fixed set of years; a missing year is unknown (Q6, Q20)."""
    counted = (
        history.filter(F.col(year).isin(list(years)))
        .groupBy(key)
        .agg(
            F.count_if(F.col(status) == "pass").alias("pass_count"),
            F.count_if(F.col(status) == "fail").alias("fail_count"),
        )
    )
    if programs is not None:
        counted = programs.select(key).distinct().join(counted, key, "left").na.fill(0, ["pass_count", "fail_count"])
    return counted.withColumn("unknown_count", F.lit(len(years)) - F.col("pass_count") - F.col("fail_count")).select(
        "*", (F.col("fail_count") >= 2).alias("likely_fail"), (F.col("pass_count") >= 2).alias("likely_pass")
    )


def overall_cutoff(round1: Column | str, round2: Column | str) -> Column:
    """Smaller of the two rounds' first numbers, nulls skipped."""
    return F.least(F.get(c(round1), F.lit(0))["num"], F.get(c(round2), F.lit(0))["num"])


def bucket(status: Column, slack: Column, apply_hard: Column | None = None) -> Column:
    """Bucket by slack for passing programmes; a good one that is hard to reach otherwise is an opportunity."""
    base = (
        F.when((status != "pass") | slack.isNull(), F.lit("incomplete"))
        .when(slack >= 0, F.lit("star_good"))
        .when(slack >= -1.0, F.lit("star_edge"))
        .otherwise(F.lit("star_hard"))
    )
    if apply_hard is None:
        return base
    return F.when((base == "star_good") & apply_hard, F.lit("oppty")).otherwise(base)
