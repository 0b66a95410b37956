"""SF1-SF5, SF7, SF8, SF12, SF26: standards, ranks and requirement text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .expr import c, contains_any, let, lookup, number_text, strip, text


def parse_standard(std: Column | str, ranks: dict[str, int] = V.STANDARD_RANK) -> Column:
    """SF1: struct(rank, any, base) of a requirement standard such as ``任一均标以上``."""

    def parse(raw: Column) -> Column:
        # The patterns only run on the few values that need them.
        body = (
            F.when(raw.startswith("任一"), raw.substr(3, 1 << 20))
            .when(raw.startswith("任何一"), F.regexp_replace(raw, "^任何一(?:科|門|门|項|项)?", ""))
            .otherwise(raw)
        )
        is_any = raw.startswith("任一") | raw.startswith("任何一")
        return F.struct(is_any.alias("any"), body.alias("body"))

    def bare(x: Column) -> Column:
        base = F.when(x["body"].endswith("以上"), strip(F.regexp_replace(x["body"], "(级以上|級以上|以上)$", "")))
        return F.struct(x["any"].alias("any"), F.coalesce(base, strip(x["body"])).alias("base"))

    def ranked(x: Column) -> Column:
        return F.struct(lookup(x["base"], ranks).alias("rank"), x["any"].alias("any"), x["base"].alias("base"))

    # The usual spellings are looked up; only unusual ones are taken apart.
    pairs = []
    for word, rank in ranks.items():
        for prefix in ("", "任一"):
            for suffix in ("", "以上", "级以上"):
                known = F.struct(
                    F.lit(rank).alias("rank"), F.lit(prefix != "").alias("any"), F.lit(word).alias("base")
                )
                pairs += [F.lit(prefix + word + suffix), known]
    usual = F.create_map(*pairs)
    absent = F.struct(F.lit(None).cast("int").alias("rank"), F.lit(False).alias("any"), F.lit("").alias("base"))

    def read(raw: Column) -> Column:
        unusual = let(let(let(raw, parse), bare), ranked)
        return F.when(raw == "", absent).otherwise(F.coalesce(F.element_at(usual, raw), unusual))

    return let(strip(text(std)), read)


def standard_rank(std: Column | str) -> Column:
    return parse_standard(std)["rank"]


def detect_standard(value: Column | str, search=V.STANDARD_SEARCH) -> Column:
    """SF2: first standard of a fixed order that occurs anywhere (Q7)."""
    out = F.when(F.lit(False), F.lit(""))
    for standard, aliases in search:
        out = out.when(contains_any(value, aliases), F.lit(standard))
    return out


def normalise_word(value: Column | str) -> Column:
    """SF3, lenient form: unknown words stay as they are, dashes are empty."""
    raw = strip(text(value))
    return F.when(raw.isin("", "-", "--"), F.lit("")).otherwise(F.coalesce(lookup(raw, V.STANDARD_FORMS), raw))


def normalise_word_strict(value: Column | str) -> Column:
    """SF3, strict form: unknown words are null."""
    return lookup(strip(c(value)), V.STANDARD_FORMS)


def tier_rank(tier: Column | str) -> Column:
    return lookup(strip(text(tier)), V.TIER_RANK, 1)


def confidence_rank(conf: Column | str) -> Column:
    return lookup(F.lower(text(conf)), V.CONFIDENCE_RANK, 0)


def status_rank(status: Column | str) -> Column:
    return lookup(text(status), V.STATUS_RANK, 0)


def listening_rank(grade: Column | str) -> Column:
    return lookup(F.upper(text(grade)), V.LISTENING_RANK, 0)


def bucket_rank(bucket: Column | str) -> Column:
    return lookup(text(bucket), V.BUCKET_RANK, 4)


def rank_word(rank: Column | str, ranks: dict[str, int] = V.STANDARD_RANK) -> Column:
    """SF5: rank back to its word, empty when out of range."""
    words = {str(v): k for k, v in ranks.items()}
    return lookup(c(rank).cast("string"), words, "")


def subject_key(name: Column | str, names: dict[str, str] = V.SUBJECT_NAMES) -> Column:
    """SF8."""
    return lookup(strip(text(name)), names, "")


def is_present(req: Column) -> Column:
    """A subject requirement counts when it has a standard or a non-zero score."""
    return (F.coalesce(req["standard"], F.lit("")) != "") | (F.coalesce(req["min_score"], F.lit(0)) != 0)


def has_requirements(subjects: Column, keys=tuple(V.SUBJECT_KEYS)) -> Column:
    """SF12 for one subject map."""
    hit = F.lit(False)
    for key in keys:
        hit = hit | F.coalesce(is_present(subjects[key]), F.lit(False))
    return hit


def extraction_has_requirements(extraction: Column) -> Column:
    """SF12 for a whole extraction: general map or any department row."""
    depts = F.coalesce(
        F.exists(extraction["department_requirements"], lambda d: has_requirements(d["subjects"])),
        F.lit(False),
    )
    return has_requirements(extraction["general_requirements"]) | depts


def format_requirement(req: Column) -> Column:
    """SF26: ``均标(12级)``, ``均标``, ``(12级)`` or ``-``."""
    std = F.coalesce(req["standard"], F.lit(""))
    score = F.coalesce(req["min_score"], F.lit(0))
    suffix = F.when(score != 0, F.concat(F.lit("("), score.cast("string"), F.lit("级)"))).otherwise("")
    shown = F.concat(std, suffix)
    return F.when(shown == "", F.lit("-")).otherwise(shown)


def format_percent(value: Column | str) -> Column:
    """SF26: one decimal, half up (Q17)."""
    v = c(value).cast("double")
    rounded = F.floor(v * 10 + 0.5) / 10
    return F.coalesce(F.concat(number_text(rounded), F.lit("%")), F.lit("-"))


def _shown(std: Column) -> Column:
    return ~strip(text(std)).isin("", "-", "--")


def format_requirement_map(req_map: Column | str, order=("國文", "英文", "數學A", "數學B", "社會", "自然", "英聽")) -> Column:
    """SF26: ``國文 均標；英文 前標`` in a fixed subject order."""
    parts = [
        F.when(_shown(F.element_at(c(req_map), F.lit(k))), F.concat(F.lit(k + " "), F.element_at(c(req_map), F.lit(k))))
        for k in order
    ]
    joined = F.array_join(F.array_compact(F.array(*parts)), "；")
    return F.when(joined == "", F.lit("无明确检定")).otherwise(joined)


def format_stage_list(rows: Column | str) -> Column:
    """SF26: stage-one list ``subject standard`` joined."""
    kept = F.filter(c(rows), lambda r: (strip(text(r["subject"])) != "") & _shown(r["standard"]))
    shown = F.transform(kept, lambda r: F.concat(strip(r["subject"]), F.lit(" "), strip(r["standard"])))
    joined = F.array_join(F.coalesce(shown, F.array().cast("array<string>")), "；")
    return F.when(joined == "", F.lit("无明确检定")).otherwise(joined)


def format_gap(details: Column | str, labels: dict[str, str] = V.SUBJECT_LABELS) -> Column:
    """SF26: gap details ``数学A择一差1（均标→前标）``."""

    def one(d: Column) -> Column:
        req, usr = rank_word(d["required"]), rank_word(d["user"])
        return F.when(
            (req != "") & (usr != ""),
            F.concat(
                F.coalesce(lookup(d["key"], labels), d["key"]),
                F.when(d["kind"] == "or", F.lit("择一")).otherwise(""),
                F.lit("差"),
                d["deficit"].cast("string"),
                F.lit("（"),
                usr,
                F.lit("→"),
                req,
                F.lit("）"),
            ),
        )

    return F.array_join(F.array_compact(F.transform(c(details), one)), "；")
