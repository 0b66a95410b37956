"""SF6, SF7, SF9-SF11, SF15, SF16, SF18, SF27-SF30, E14: free-text expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .expr import alternation, array_of, c, contains_any, ends_with_any, let, no_space, parens, strip, strip_chars, text

# Fixed value: "math A/B" written as a pair.
MATH_PAIR = "(数学|數學)\\s*[AaＡ].{0,4}[/、,，及和與与或].{0,4}[BbＢ]"
TRIM_MARKS = " \t\r\n,;，；。．.·•★☆-—–"
LIST_NUMBER = r"^\(?[一二三四五六七八九十0-9]+\)?[、.．]\s*"


def has_choice(value: Column | str, words=tuple(V.CHOICE_WORDS)) -> Column:
    """SF7."""
    return contains_any(value, words)


def detect_subjects(value: Column | str, both_scripts: bool = True) -> Column:
    """SF6: ordered distinct subject keys named in a text.

    ``both_scripts=False`` tests the unqualified math word in its simplified form
    only, as the server-side rules do (Q8).
    """
    t = parens(text(value))
    return _subjects_in(t, t.rlike(MATH_PAIR), both_scripts)


def _subjects_in(t: Column, pair: Column, both_scripts: bool) -> Column:
    math_a, math_b = contains_any(t, ["数学A", "數學A"]), contains_any(t, ["数学B", "數學B"])
    plain = contains_any(t, ["数学", "數學"] if both_scripts else ["数学"]) & ~pair & ~math_a & ~math_b
    parts = [
        F.when(pair, F.lit("math_a")),
        F.when(pair, F.lit("math_b")),
        F.when(contains_any(t, ["语文", "國文", "国文"]), F.lit("chinese")),
        F.when(contains_any(t, ["英语", "英文"]), F.lit("english")),
        F.when(math_a | plain, F.lit("math_a")),
        F.when(math_b | plain, F.lit("math_b")),
        F.when(contains_any(t, ["社会", "社會"]), F.lit("social")),
        F.when(t.contains("自然"), F.lit("science")),
    ]
    return F.array_distinct(F.array_compact(F.array(*parts)))


def expand_choice(value: Column | str, keys: Column) -> Column:
    """SF7: add the four core subjects or the math pair when a choice text implies them."""
    t = text(value)
    four = F.when(contains_any(t, V.FOUR_SUBJECT_WORDS), array_of(["chinese", "english", "math_a", "math_b"])).otherwise(
        F.array().cast("array<string>")
    )
    pair = F.when(t.rlike(MATH_PAIR), array_of(["math_a", "math_b"])).otherwise(F.array().cast("array<string>"))
    return F.when(has_choice(t), F.array_union(F.array_union(keys, four), pair)).otherwise(F.array_distinct(keys))


def choice_subjects(value: Column | str, both_scripts: bool = True) -> Column:
    return expand_choice(value, detect_subjects(value, both_scripts))


def choice_subjects_once(value: Column, both_scripts: bool = True) -> Column:
    """``choice_subjects`` for use inside a lambda, where Spark evaluates a repeated expression every time."""
    plain = lambda v: F.struct(v.alias("v"), parens(v).alias("t"))
    paired = lambda x: F.struct(x["v"].alias("v"), x["t"].alias("t"), x["t"].rlike(MATH_PAIR).alias("pair"))
    found = lambda x: expand_choice(x["v"], _subjects_in(x["t"], x["pair"], both_scripts))
    return let(let(let(text(value), plain), paired), found)


# Fixed value: a subject list followed by an any-of word.
_SUBJECT_ALT = "国文|國文|语文|英文|英语|数学A|數學A|数学B|數學B|数学|數學|社会|社會|自然|四科|四门|四項|四项|四科目"
CHOICE_SEGMENT = "((?:" + _SUBJECT_ALT + ")[^。；;]{0,40}?)(" + "|".join(V.CHOICE_WORDS_LONG) + ")"


def context_groups(value: Column | str, segment: str = CHOICE_SEGMENT) -> Column:
    """Any-of groups named in a text, each group once (U8)."""
    empty = F.array().cast("array<array<string>>")

    def groups_of(t: Column) -> Column:
        segments = F.regexp_extract_all(t, F.lit(segment), F.lit(1))
        named = F.filter(F.transform(segments, lambda g: choice_subjects(g)), lambda g: F.size(g) > 0)
        whole = F.filter(F.array(choice_subjects(t)), lambda g: F.size(g) > 0)
        return let(named, lambda g: distinct_groups(F.when(F.size(g) > 0, g).otherwise(whole)))

    return F.when(has_choice(value), let(no_space(text(value)), groups_of)).otherwise(empty)


def distinct_groups(groups: Column) -> Column:
    """U8: keep the first group of each member set; empty groups go."""
    clean = F.filter(F.transform(groups, F.array_distinct), lambda g: F.size(g) > 0)

    def firsts(keyed: Column) -> Column:
        sigs = F.transform(keyed, lambda x: x["sig"])
        kept = F.filter(keyed, lambda x, i: F.array_position(sigs, x["sig"]) == i + 1)
        return F.transform(kept, lambda x: x["g"])

    keyed = F.transform(clean, lambda g: F.struct(F.array_join(F.array_sort(g), "|").alias("sig"), g.alias("g")))
    return let(keyed, firsts)


# ---- majors --------------------------------------------------------------------


def split_tokens(value: Column | str) -> Column:
    """SF9: tokens of a list written with mixed separators."""

    def split(s: Column) -> Column:
        left = F.substring_index(s, "：", 1)
        listed = s.contains("：") & left.rlike("招生专业|招生專業|专业|專業")
        body = strip(F.when(listed, s.substr(F.length(left) + 2, F.length(s))).otherwise(s))
        body = F.translate(parens(body), "，,/\\；;|｜", "、" * 8)
        parts = F.split(F.regexp_replace(body, LIST_NUMBER, ""), "、")
        return F.filter(F.transform(parts, strip), lambda t: t != "")

    return let(strip(text(value)), split)


def normalise_major(value: Column | str) -> Column:
    """SF10, extraction form: marks, code prefix and unit prefix removed."""
    s = strip_chars(no_space(parens(text(value))), TRIM_MARKS)
    s = strip_chars(F.regexp_replace(s, "^[0-9]{4,12}", ""), TRIM_MARKS)

    def after_unit(v: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for unit in V.UNIT_WORDS:
            tail = strip(F.substring_index(v, unit, -1))
            out = out.when(v.contains(unit) & F.length(tail).between(2, 40), tail)
        return out.otherwise(v)

    return let(s, after_unit)


def han_count(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^一-鿿]", ""))


def is_major(name: Column | str) -> Column:
    """SF11: plausibility of a major name, on its normalised form."""
    return let(normalise_major(name), _plausible)


def _plausible(s: Column) -> Column:
    base = strip(F.substring_index(s, "(", 1))
    short_ok = (F.length(s) != 2) | s.endswith("学") | s.endswith("语") | s.isin(V.TWO_CHAR_MAJORS)
    clean = (
        F.length(s).between(2, 60)
        & (han_count(s) >= 2)
        & short_ok
        & ~s.rlike("(?i)https?://|www\\.|@")
        & ~s.rlike("[0-9]|元")
        & ~contains_any(s, V.MAJOR_STOP_WORDS)
        & ~contains_any(s, V.SENTENCE_MARKS)
        & ~base.isin(V.SUBJECT_BASES)
    )
    language = base.endswith("语") & (F.length(base) <= 6)
    score = (
        F.when(ends_with_any(base, V.MAJOR_SUFFIXES), 3).otherwise(0)
        + F.when(s.contains("(") & s.contains(")"), 1).otherwise(0)
        + F.when(contains_any(base, V.MAJOR_KEYWORDS), 1).otherwise(0)
    )
    applied = base.endswith("应用") & contains_any(base, V.APPLIED_WORDS)
    return clean & (language | (score >= 3) | applied)


@dataclass(frozen=True)
class NameRule:
    """A rule of SF11: a pattern on the whole name or on its part before a parenthesis, and what a hit weighs."""

    name: str
    pattern: str
    weight: int
    base: bool = False


REJECT = -100
KEEP = 3


def name_rules() -> list[NameRule]:
    """SF11 as a table, in the order in which a rule gets to decide; the words are the domain's fixed values."""
    return [
        NameRule("length", r"(?s)^(?:.?|.{61,})$", REJECT),
        NameRule("script", "(?s)^[^一-鿿]*[一-鿿]?[^一-鿿]*$", REJECT),
        NameRule("fragment", f"(?s)^(?!.[学语]$)(?!(?:{alternation(V.TWO_CHAR_MAJORS)})$)..$", REJECT),
        NameRule("address", "(?i)https?://|www\\.|@", REJECT),
        NameRule("number", "[0-9]|元", REJECT),
        NameRule("stop word", alternation(V.MAJOR_STOP_WORDS), REJECT),
        NameRule("sentence", alternation(V.SENTENCE_MARKS), REJECT),
        NameRule("subject", f"^(?:{alternation(V.SUBJECT_BASES)})$", REJECT, base=True),
        NameRule("language", "(?s)^.{0,5}语$", KEEP, base=True),
        NameRule("suffix", f"(?:{alternation(V.MAJOR_SUFFIXES)})$", KEEP, base=True),
        NameRule("applied", f"(?s)(?:{alternation(V.APPLIED_WORDS)}).*应用$", KEEP, base=True),
        NameRule("keyword", alternation(V.MAJOR_KEYWORDS), 1, base=True),
        NameRule("bracket", r"(?s)\(.*\)|\).*\(", 1),
    ]


def major_verdict(name: Column | str, rules: Sequence[NameRule] | None = None, least: int = KEEP) -> Column:
    """SF11 with its reason: struct of the normalised ``name``, ``kept``, ``score`` and ``rule``.

    ``score`` sums the weights of all rules that hit, and a name is kept from ``least`` points on. ``rule`` is the first
    one whose weight alone settles that, or ``weak`` when none does. Null counts as an empty name.
    """
    rules = name_rules() if rules is None else rules

    def judged(x: Column) -> Column:
        hits = [(x["base"] if r.base else x["name"]).rlike(r.pattern) for r in rules]
        score = F.lit(0)
        for r, hit in zip(rules, hits):
            score = score + F.when(hit, r.weight).otherwise(0)
        settled = [F.when(hit, F.lit(r.name)) for r, hit in zip(rules, hits) if r.weight <= REJECT or r.weight >= least]
        return F.struct(x["name"].alias("name"), (score >= least).alias("kept"), score.alias("score"), F.coalesce(*settled, F.lit("weak")).alias("rule"))

    parts = let(normalise_major(name), lambda s: F.struct(s.alias("name"), strip(F.substring_index(s, "(", 1)).alias("base")))
    return let(parts, judged)


def display_key(value: Column | str) -> Column:
    """SF10, display form."""
    s = F.translate(parens(no_space(strip(text(value)))), "·•", "")
    return F.regexp_replace(s, "[，,;；。]+$", "")


def is_display_major(value: Column | str) -> Column:
    """SF11, display form."""
    return let(display_key(value), _display_plausible)


def _display_plausible(v: Column) -> Column:
    short_ok = (F.length(v) != 2) | v.endswith("学") | v.endswith("语") | v.isin(V.TWO_CHAR_MAJORS)
    return (
        F.length(v).between(2, 40)
        & ~v.rlike("^[0-9]+$")
        & (han_count(v) >= 2)
        & short_ok
        & ~v.rlike(V.DISPLAY_STOP_PATTERN)
    )


def label_majors(label: Column | str) -> Column:
    """X9, extraction form: majors named in a department label, at most 80."""

    def named(s: Column) -> Column:
        names = F.filter(F.transform(split_tokens(s), normalise_major), is_major)
        return F.when(_generic_label(s), F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(names), 1, 80))

    return let(normalise_major(label), named)


def _generic_label(s: Column) -> Column:
    """Category labels name no majors unless they are visibly a list."""
    return (s == "") | ((s.contains("类专业") | s.endswith("专业") | s.endswith("專業")) & ~s.rlike("[、,，/]"))


def display_label_majors(label: Column | str) -> Column:
    """X9, display form."""
    s = display_key(label)
    generic = (s.contains("类专业") | s.endswith("专业") | s.endswith("專業")) & ~s.rlike("[、，,/]")
    names = F.filter(F.transform(split_tokens(s), display_key), is_display_major)
    return F.when(generic | (s == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(names))


def clean_list(values: Column | str) -> Column:
    """Strings stripped, blanks gone, first occurrences in order."""
    items = F.coalesce(c(values), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(items, strip), lambda v: v.isNotNull() & (v != "")))


def merge_lists(first: Column | str, second: Column | str, limit: int = 600) -> Column:
    """Ordered unique union of two lists with a cap."""
    return F.slice(F.array_union(clean_list(first), clean_list(second)), 1, limit)


def clean_majors(values: Column | str, limit: int = 400) -> Column:
    """Normalised plausible majors of a list, first occurrences, capped."""
    items = F.coalesce(c(values), F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.filter(F.transform(items, normalise_major), is_major)), 1, limit)


# ---- matching ------------------------------------------------------------------


def match_text(value: Column | str) -> Column:
    """SF15."""
    return no_space(F.translate(parens(text(value)), "·", ""))


def name_aliases(name: Column | str, suffixes=tuple(V.NAME_SUFFIXES), min_length: int = 4) -> Column:
    """SF16: the name, the name without parentheses, and without a city ending."""
    full = match_text(name)
    base = F.regexp_replace(full, r"\([^)]*\)", "")
    forms = [full, base]
    for suffix in suffixes:
        forms.append(
            F.when(
                base.endswith(suffix) & (F.length(base) > len(suffix) + 1),
                base.substr(F.lit(1), F.length(base) - len(suffix)),
            )
        )
    return F.filter(F.array_distinct(F.array_compact(F.array(*forms))), lambda a: F.length(a) >= min_length)


def keyword_hit(value: Column | str, keywords) -> Column:
    """ASCII keywords match without case, others exactly."""
    t = text(value)
    words = [w.strip() for w in keywords if w and w.strip()]
    is_ascii = [w for w in words if all(ch.isascii() and (ch.isalnum() or ch in "+_.-") for ch in w)]
    exact = [w for w in words if w not in is_ascii]
    hit = F.lit(False)
    if is_ascii:
        hit = hit | contains_any(F.lower(t), [w.lower() for w in is_ascii])
    if exact:
        hit = hit | contains_any(t, exact)
    return hit


def custom_keywords(value: Column | str) -> Column:
    """SF30: words of a keyword field, punctuation removed, first of each case-folded form."""
    words = F.split(strip(text(value)), r"(?U)\s+")
    clean = F.filter(
        F.transform(words, lambda w: strip(F.regexp_replace(w, r"[，,;；/\\|｜]+", ""))), lambda w: w != ""
    )

    def firsts(x: Column) -> Column:
        return F.filter(x["clean"], lambda w, i: F.array_position(x["folded"], F.get(x["folded"], i)) == i + 1)

    return let(
        let(clean, lambda k: F.struct(k.alias("clean"), F.transform(k, lambda w: F.lower(w)).alias("folded"))), firsts
    )


def first_url(value: Column | str) -> Column:
    """SF18: first URL of a mixed text without trailing marks; the text itself when none."""
    s = strip(text(value))
    url = F.regexp_extract(s, r"(?i)https?://[^\s]+", 0)
    return F.when(url == "", s).otherwise(F.regexp_replace(url, r"[)\],.，。；;]+$", ""))


def other_text(conditions: Column | str, notes: Column | str, first_row: Column) -> Column:
    """SF27: first two conditions (first row only) and the notes."""
    empty = F.array().cast("array<string>")
    conds = F.filter(F.coalesce(c(conditions), empty), lambda x: x.isNotNull() & (strip(x) != ""))
    note = strip(text(notes))
    parts = F.concat(
        F.when(first_row, F.slice(conds, 1, 2)).otherwise(empty),
        F.when(note != "", F.array(note)).otherwise(empty),
    )
    return F.array_join(parts, "；")


def row_track(
    label: Column | str,
    majors: Column | str,
    notes: Column | str,
    science_std: Column | str,
    social_std: Column | str,
    mixed_words=tuple(V.TRACK_MIXED),
    arts_words=tuple(V.TRACK_ARTS),
    science_words=tuple(V.TRACK_SCIENCE),
) -> Column:
    """SF28: mixed, science, arts or unknown; requirements decide when no word does."""
    t = no_space(F.concat(text(label), F.lit(" "), F.array_join(c(majors), "、"), F.lit(" "), text(notes)))
    arts, science = t.rlike(alternation(arts_words)), t.rlike(alternation(science_words))
    has_science, has_social = text(science_std) != "", text(social_std) != ""
    return (
        F.when(contains_any(t, mixed_words), F.lit("mixed"))
        .when(arts & science, F.lit("mixed"))
        .when(science, F.lit("science"))
        .when(arts, F.lit("arts"))
        .when(has_science & has_social, F.lit("mixed"))
        .when(has_science, F.lit("science"))
        .when(has_social, F.lit("arts"))
        .otherwise(F.lit("unknown"))
    )


def flex_signals(parts: list[Column], signals=tuple(V.FLEX_SIGNALS)) -> Column:
    """SF29: labels of the flexibility patterns found in the joined texts."""
    t = no_space(F.concat_ws(" ", *parts))
    return F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(label)) for p, label in signals]))
