"""Rules that turn document text into requirement records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.expr import alternation, blank_to_null, count_words, let, no_space, parens, strip, text
from ..functions.standards import detect_standard, extraction_has_requirements
from ..functions.text import MATH_PAIR, choice_subjects_once, has_choice

KEYS = V.SUBJECT_KEYS


def _default_detect(value: Column) -> Column:
    return choice_subjects_once(value, both_scripts=False)


@dataclass(frozen=True)
class RuleVocabulary:
    """Words of the text rules; the defaults are the domain's fixed values."""

    subjects: Mapping[str, str] = field(default_factory=lambda: dict(V.TEXT_SUBJECTS))
    standards: Sequence[str] = ("顶标", "前标", "均标", "后标", "底标")
    joins: str = "[、,，和及与與]"
    reach: str = "达到"
    any_prefix: str = "任一"
    choice_subjects: Sequence[str] = (
        "语文", "国文", "英文", "英语", "数学A", "數學A", "数学B", "數學B", "数学", "數學", "社会", "社會",
        "自然", "四科", "四门", "四項", "四项", "四科目",
    )
    choice_words: Sequence[str] = tuple(V.CHOICE_WORDS_LONG)
    stops: str = "。；;"
    unit: str = "级"
    unit_full: str = "级分"
    pair_pattern: str | None = MATH_PAIR
    detect: Callable[[Column], Column] = _default_detect
    detect_standard: Callable[[Column], Column] = detect_standard
    has_choice: Callable[[Column], Column] = has_choice

    def list_pattern(self) -> str:
        s = alternation(self.subjects)
        # The possessive loop keeps no backtracking state, so a long list in a junk text
        # cannot exhaust the stack; nothing is lost because no list item starts like ``reach``.
        return f"(?:{s})(?:{self.joins}(?:{s}))*+{self.reach}(?:{alternation(self.standards)})"

    def choice_pattern(self) -> str:
        return (
            f"(?:{alternation(self.choice_subjects)})[^{self.stops}]{{0,40}}?(?:{alternation(self.choice_words)})"
            f"[^{self.stops}]{{0,20}}?(?:{alternation(self.standards)})"
        )

    def score_patterns(self) -> list[str]:
        s = alternation(self.subjects)
        return [f"({s})[:：]?([0-9]{{1,2}}){self.unit_full}", f"({s}).*?([0-9]{{1,2}}){self.unit}"]


DEFAULT = RuleVocabulary()


def cleaned(value: Column | str) -> Column:
    return no_space(parens(text(value)))


def _pick(standard: Column, score: Column) -> Column:
    return F.struct(standard.cast("string").alias("standard"), score.cast("int").alias("min_score"))


def _words_of(vocab: RuleVocabulary, key: str) -> list[str]:
    return [w for w, k in vocab.subjects.items() if k == key]


def _hit(value: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | value.contains(w)
    return out


def _suffix_standard(phrase: Column, standards: Sequence[str]) -> Column:
    """The standard a phrase ends with."""
    return F.regexp_extract(phrase, f"({alternation(standards)})$", 1)


def listed_standards(subjects: Column, value: Column, vocab: RuleVocabulary = DEFAULT) -> Column:
    """The last "A, B reach X" phrase per subject overwrites standard and score."""
    return let(F.struct(subjects.alias("s"), value.alias("v")), lambda x: _listed(x["s"], x["v"], vocab))


def _listed(subjects: Column, value: Column, vocab: RuleVocabulary) -> Column:
    phrases = F.regexp_extract_all(value, F.lit(vocab.list_pattern()), F.lit(0))
    start = F.array(F.lit(None).cast("string"))

    def last_of(ph: Column) -> Column:
        return F.struct(
            *[F.element_at(F.concat(start, F.filter(ph, _naming(_words_of(vocab, k)))), -1).alias(k) for k in KEYS]
        )

    def overwritten(last: Column) -> Column:
        return F.struct(
            *[
                F.when(last[k].isNotNull(), _pick(_suffix_standard(last[k], vocab.standards), F.lit(None)))
                .otherwise(subjects[k])
                .alias(k)
                for k in KEYS
            ]
        )

    return let(let(phrases, last_of), overwritten)


def _naming(words: Sequence[str]):
    return lambda p: _hit(p, words)


def _raise(cur: Column, std: Column, vocab: RuleVocabulary) -> Column:
    """Empty or equal standards become any-of; others stay."""
    empty = F.coalesce(cur, F.lit("")) == ""
    return F.when(empty | (strip(cur) == std), F.concat(F.lit(vocab.any_prefix), std)).otherwise(cur)


def choice_matches(value: Column, vocab: RuleVocabulary = DEFAULT) -> Column:
    phrases = F.regexp_extract_all(value, F.lit(vocab.choice_pattern()), F.lit(0))
    return F.transform(
        phrases, lambda p: F.struct(vocab.detect(p).alias("keys"), _suffix_standard(p, vocab.standards).alias("std"))
    )


def choice_standards(subjects: Column, context: Column, vocab: RuleVocabulary = DEFAULT) -> Column:
    """Any-of standards from phrases; from the whole context when no phrase applies;
    a lone maths standard is copied to its pair."""
    return let(F.struct(subjects.alias("s"), context.alias("c")), lambda x: _chosen(x["s"], x["c"], vocab))


def _chosen(subjects: Column, context: Column, vocab: RuleVocabulary) -> Column:
    prefix = vocab.any_prefix
    first = F.coalesce(*[blank_to_null(subjects[k]["standard"]) for k in KEYS])
    facts = F.struct(
        F.filter(choice_matches(no_space(context), vocab), lambda m: F.size(m["keys"]) > 0).alias("matches"),
        vocab.detect(context).alias("keys"),
        strip(F.coalesce(vocab.detect_standard(context), first)).alias("std"),
        vocab.has_choice(context).alias("choice"),
    )

    def folded(x: Column) -> Column:
        std = x["std"]
        base = F.when(std.startswith(prefix), std.substr(len(prefix) + 1, 1 << 20)).otherwise(std)
        fields = []
        for key in KEYS:
            cur = subjects[key]["standard"].cast("string")
            by_phrase = F.aggregate(x["matches"], cur, _fold_phrase(key, vocab))
            loose = F.when(
                std.isNotNull() & x["choice"] & F.array_contains(x["keys"], key), _raise(cur, base, vocab)
            ).otherwise(cur)
            fields.append(F.when(F.size(x["matches"]) > 0, by_phrase).otherwise(loose).alias(key))
        return F.struct(*fields, x["choice"].alias("choice"))

    def paired(x: Column) -> Column:
        out = {k: _pick(x[k], subjects[k]["min_score"]) for k in KEYS}
        if vocab.pair_pattern:
            both = x["choice"] & context.rlike(vocab.pair_pattern)
            ma, mb = blank_to_null(x["math_a"]), blank_to_null(x["math_b"])
            copy = {"math_a": (ma.isNull() & mb.isNotNull(), mb), "math_b": (mb.isNull() & ma.isNotNull(), ma)}
            for key, (lone, std) in copy.items():
                out[key] = F.when(both & lone, _pick(std, F.lit(None))).otherwise(out[key])
        return F.struct(*[out[k].alias(k) for k in KEYS])

    return let(let(facts, folded), paired)


def _fold_phrase(key: str, vocab: RuleVocabulary):
    return lambda acc, m: F.when(F.array_contains(m["keys"], key), _raise(acc, m["std"], vocab)).otherwise(acc)


def minimum_scores(subjects: Column, value: Column, vocab: RuleVocabulary = DEFAULT) -> Column:
    """Scores 1-15; the second, wider pattern runs after the first, later matches win (Q12)."""
    return let(F.struct(subjects.alias("s"), value.alias("v")), lambda x: _scored(x["s"], x["v"], vocab))


def _scored(subjects: Column, value: Column, vocab: RuleVocabulary) -> Column:
    s, unit = alternation(vocab.subjects), vocab.unit
    close, wide = vocab.score_patterns()
    # Past the last number no match can end; without that tail every scan is linear.
    upto = F.regexp_extract(value, f"(?s)^(.*[0-9]{unit})", 1)

    def pairs_of(source: Column, pattern: str, tail: str) -> Column:
        return F.transform(
            F.regexp_extract_all(source, F.lit(pattern), F.lit(0)),
            lambda m: F.struct(
                F.regexp_extract(m, f"^({s})", 1).alias("w"),
                F.regexp_extract(m, f"([0-9]{{1,2}}){tail}$", 1).cast("int").alias("n"),
            ),
        )

    pairs = [pairs_of(value, close, vocab.unit_full), pairs_of(upto, wide, unit)]
    usable = F.filter(F.concat(*pairs), lambda p: p["n"].between(1, 15))

    def scored(found: Column) -> Column:
        fields = []
        for key in KEYS:
            last = let(F.filter(found, _worded(_words_of(vocab, key))), lambda m: F.get(m, F.size(m) - 1)["n"])
            fields.append(_pick(subjects[key]["standard"], F.coalesce(last, subjects[key]["min_score"])).alias(key))
        return F.struct(*fields)

    return let(usable, scored)


def _worded(words: Sequence[str]):
    return lambda p: p["w"].isin(words)


def empty_subjects() -> Column:
    none = _pick(F.lit(None), F.lit(None))
    return F.struct(*[none.alias(k) for k in KEYS])


def ensure_subjects(subjects: Column) -> Column:
    """All six keys present."""
    none = _pick(F.lit(None), F.lit(None))
    return F.struct(
        *[
            F.when(subjects[k].isNotNull(), _pick(subjects[k]["standard"], subjects[k]["min_score"])).otherwise(none).alias(k)
            for k in KEYS
        ]
    )


def rule_subjects(df, subjects: str, value: str, out: str, vocab: RuleVocabulary = DEFAULT):
    """X13-X15 in order over a DataFrame; each rule is its own projection step."""
    step = df.withColumn("_clean", cleaned(value)).withColumn(out, ensure_subjects(F.col(subjects)))
    step = step.withColumn(out, listed_standards(F.col(out), F.col("_clean"), vocab))
    step = step.withColumn(out, choice_standards(F.col(out), F.col("_clean"), vocab))
    return step.withColumn(out, minimum_scores(F.col(out), F.col("_clean"), vocab)).drop("_clean")


def append_note(notes: Column, tail: str) -> Column:
    n = text(notes)
    return F.when(n.contains(tail), notes).otherwise(strip(F.concat(n, F.lit(" " + tail))))


def fill_from_text(df, extraction: str, value: str, vocab: RuleVocabulary = DEFAULT):
    """X13-X15 on a record: requirements completed, with a note when they are new."""
    e = F.col(extraction)
    had = F.coalesce(extraction_has_requirements(e), F.lit(False))
    step = df.withColumn("_had", had).withColumn("_gen", e["general_requirements"])
    step = rule_subjects(step, "_gen", value, "_gen", vocab)
    blank = text(value) == ""
    e2 = F.when(blank, e).otherwise(e.withField("general_requirements", F.col("_gen")))
    step = step.withColumn(extraction, e2)
    e = F.col(extraction)
    new = ~F.col("_had") & F.coalesce(extraction_has_requirements(e), F.lit(False)) & ~blank
    return step.withColumn(
        extraction, F.when(new, e.withField("notes", append_note(e["notes"], V.RULE_NOTE))).otherwise(e)
    ).drop("_had", "_gen")


def review_flag(found: Column, has_requirements: Column, value: Column | str, signals=tuple(V.REVIEW_SIGNALS), least: int = 3) -> Column:
    """Found without requirements but with enough signals in the text."""
    return found & ~has_requirements & (count_words(no_space(text(value)), signals) >= least)


def add_review_note(df, extraction: str, value: str):
    """Note and a high confidence lowered to medium."""
    e = F.col(extraction)
    flag = review_flag(
        F.coalesce(e["found"], F.lit(False)), F.coalesce(extraction_has_requirements(e), F.lit(False)), value
    )
    noted = e.withField("notes", append_note(e["notes"], V.REVIEW_NOTE)).withField(
        "confidence", F.when(e["confidence"] == "high", F.lit("medium")).otherwise(e["confidence"])
    )
    return df.withColumn(extraction, F.when(flag, noted).otherwise(e))


def search_score(
    text_length: Column, keyword_hits: Column, same_org: Column, edu: Column, gov: Column, admission: Column, name_hit: Column, content_hit: Column
) -> Column:
    """Evidence score of a search hit."""
    bonus = F.lit(0)
    for flag, points in ((same_org, 1800), (edu, 1000), (gov, 600), (admission, 700), (name_hit, 700), (content_hit, 900)):
        bonus = bonus + F.when(flag, points).otherwise(0)
    return text_length + keyword_hits * 650 + bonus


def usable_hit(text_length: Column, keyword_hits: Column, same_org: Column, content_hit: Column) -> Column:
    """Minimum evidence of a search hit."""
    return (
        (text_length > 0)
        & ((keyword_hits > 0) | (same_org & content_hit))
        & (content_hit | same_org | (keyword_hits >= 2))
    )


# ---- X18: raw extractor output ---------------------------------------------------


def json_body(raw: Column | str) -> Column:
    """Inside of a fenced block, then from the first to the last brace."""
    t = strip(text(raw))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    t = F.when(t.rlike(r"(?s)```(?:json)?\s*.*?```"), strip(fenced)).otherwise(t)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(braces != "", braces).otherwise(t)


def repaired_json(raw: Column | str) -> Column:
    """First parsable form of the body: as is, missing commas added, trailing commas removed (Q15)."""
    body = json_body(raw)
    added = F.regexp_replace(body, r'([}\]])\s*("[A-Za-z_][^"\\]*"\s*:)', "$1,\n$2")
    trimmed = F.regexp_replace(added, r",\s*([}\]])", "$1")

    def parsable(candidate: Column) -> Column:
        # Spark's parser stops at the end of the first value, so the text must also end there.
        ok = F.try_parse_json(candidate).isNotNull() & candidate.rlike(r"(?s)^\s*[\{\[].*[\}\]]\s*$")
        return F.when(ok, candidate)

    return F.coalesce(parsable(body), parsable(added), parsable(trimmed))


EXTRA_FIELDS = ("math_requirement", "other_requirement", "requirement")


def parse_record(df, raw: str, out: str = "extraction"):
    """Raw text to a normalised record; unreadable text gives a failed one."""
    step = df.withColumn("_v", F.try_parse_json(repaired_json(raw)))
    return normalise_record(step, "_v", out).drop("_v")


def _none() -> Column:
    return F.array().cast("array<string>")


def _is(v: Column, kind: str) -> Column:
    """The variant is there and of this kind: OBJECT, ARRAY or STRING."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _get(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _items(v: Column, name: str, kind: str) -> Column:
    """The elements of this kind of a list; a field that is no list has none."""
    found = F.when(_is(_get(v, name, "variant"), "ARRAY"), _get(v, name, "array<variant>"))
    return F.coalesce(F.filter(found, lambda x: _is(x, kind)), F.array().cast("array<variant>"))


def _strings(v: Column, name: str) -> Column:
    return F.transform(_items(v, name, "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


def variant_subjects(v: Column) -> Column:
    """The six subjects of an object; a missing one, or one that is no object, is empty."""
    return F.struct(
        *[
            F.when(_is(_get(v, k, "variant"), "OBJECT"), _pick(_get(v, f"{k}.standard", "string"), _get(v, f"{k}.min_score", "int")))
            .otherwise(_pick(F.lit(None), F.lit(None)))
            .alias(k)
            for k in KEYS
        ]
    )


def normalise_record(df, raw: str, out: str):
    """A VARIANT of any shape to a record of fixed shape.

    The kinds decide, not the characters: subjects may be an object, a text or anything else, and each field that is
    not of its kind is empty. Text subjects become a map, any-of context is filled in. A value that is no object
    (null, list, text) gives a failed record. Departments that are no objects go. Of ``other_conditions`` and
    ``majors`` only texts stay. A number where a text belongs is read as its text.
    """
    ok = _is(F.col(raw), "OBJECT")
    step = df.withColumn("_o", F.when(ok, F.col(raw)).otherwise(F.parse_json(F.lit("{}"))))
    o = F.col("_o")
    conditions = _strings(o, "other_conditions")
    context = F.concat_ws(" ", text(_get(o, "notes", "string")), F.array_join(conditions, " "))
    return step.withColumn(
        out,
        F.struct(
            F.when(ok, _get(o, "found", "boolean")).otherwise(False).alias("found"),
            _get(o, "year", "int").alias("year"),
            _get(o, "application_deadline", "string").alias("application_deadline"),
            choice_standards(variant_subjects(_get(o, "general_requirements", "variant")), context).alias("general_requirements"),
            F.transform(_items(o, "department_requirements", "OBJECT"), _department).alias("department_requirements"),
            conditions.alias("other_conditions"),
            _get(o, "contact", "string").alias("contact"),
            _get(o, "notes", "string").alias("notes"),
            F.when(ok, _get(o, "confidence", "string")).otherwise("low").alias("confidence"),
            _strings(o, "majors").alias("majors"),
            F.when(ok, _get(o, "error", "string")).otherwise("提取结构异常").alias("error"),
        ),
    ).drop("_o")


def _department(d: Column) -> Column:
    parts = [text(_get(d, n, "string")) for n in ("subjects", "level", "notes", "standard")]
    parts += [_extra(d, n) for n in EXTRA_FIELDS]
    facts = F.struct(d.alias("d"), F.concat_ws(" ", *parts).alias("context"))
    return let(facts, lambda x: _shaped(x["d"], x["context"]))


def _extra(d: Column, name: str) -> Column:
    """An extra field counts when it is a text."""
    return F.when(_is(_get(d, name, "variant"), "STRING"), _get(d, name, "string"))


def _shaped(d: Column, context: Column) -> Column:
    subjects, notes = _get(d, "subjects", "variant"), _get(d, "notes", "string")
    start = (
        F.when(_is(subjects, "OBJECT"), variant_subjects(subjects))
        .when(_is(subjects, "STRING"), let(detect_standard(context), lambda std: _named_subjects(d, context, std)))
        .otherwise(empty_subjects())
    )
    return F.struct(
        _get(d, "department", "string").alias("department"),
        choice_standards(start, context).alias("subjects"),
        F.when(_is(subjects, "STRING"), F.coalesce(blank_to_null(notes), _get(d, "level", "string"))).otherwise(notes).alias("notes"),
        _strings(d, "majors").alias("majors"),
    )


def _named_subjects(d: Column, context: Column, std: Column) -> Column:
    """Subjects named in the row text, then those of the extra fields, later ones winning."""
    extras = F.struct(*[_extra(d, name).alias(name) for name in EXTRA_FIELDS])  # read once each, not at every test

    def steps(e: Column) -> Column:
        found = [F.struct(choice_subjects_once(context, False).alias("keys"), _any_if(std, context).alias("std"))]
        for name in EXTRA_FIELDS:
            extra = e[name]
            keys = F.when(extra.isNotNull(), choice_subjects_once(extra, False)).otherwise(_none())
            value = _any_if(F.coalesce(detect_standard(extra), std), text(extra))
            found.append(F.struct(keys.alias("keys"), value.alias("std")))
        return F.array(*found)

    return let(let(extras, steps), _last_named)


def _any_if(std: Column, context: Column) -> Column:
    return F.when(has_choice(context), F.concat(F.lit("任一"), strip(std))).otherwise(std)


def _last_named(steps: Column) -> Column:
    """The last step that names a subject gives its standard."""

    def of(key: str) -> Column:
        hits = F.filter(steps, lambda st: F.array_contains(st["keys"], key))
        return _pick(let(hits, lambda h: F.get(h, F.size(h) - 1)["std"]), F.lit(None))

    return F.struct(*[of(k).alias(k) for k in KEYS])
