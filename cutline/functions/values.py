"""SF22-SF25, X19: value coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V
from .expr import blank_to_null, number, strip, text
from .standards import normalise_word_strict


def code_token(value: Column | str, digits: int) -> Column:
    """SF22: the first free-standing run of exactly ``digits`` digits, else the input (Q10)."""
    raw = strip(text(value))
    token = F.regexp_extract(raw, rf"(?<![\p{{L}}\p{{N}}_])([0-9]{{{digits}}})(?![\p{{L}}\p{{N}}_])", 1)
    return F.coalesce(blank_to_null(token), raw)


def percent(value: Column | str) -> Column:
    """SF23: number with an optional percent sign."""
    return number(F.replace(strip(text(value)), F.lit("%"), F.lit("")))


def percent_in_range(value: Column | str) -> Column:
    """SF23: input form, blank or outside 0-100 is null."""
    v = number(strip(text(value)))
    return F.when(v.between(0, 100), v)


def value_token(tok: Column | str) -> Column:
    """SF24: struct(num, txt) of a cell, null for blanks and dashes."""
    s = strip(text(tok))
    body = s.substr(F.lit(1), F.length(s) - 1)
    num = F.when(s.endswith("%"), number(body)).when(s.rlike(r"^\d+(\.\d+)?$"), s.try_cast("double"))
    return F.when(
        ~s.isin("", "--", "-", "無", "无"),
        F.struct(num.alias("num"), F.when(num.isNull(), s).alias("txt")),
    )


def deadline(value: Column | str) -> Column:
    """SF25: date in free text; out-of-range months and days roll over."""
    s = text(value)
    pattern = r"(\d{4})\s*[\-./年]\s*(\d{1,2})\s*[\-./月]\s*(\d{1,2})"
    y, m, d = (blank_to_null(F.regexp_extract(s, pattern, i)).cast("int") for i in (1, 2, 3))
    start = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1)
    return F.when((y > 0) & (m > 0) & (d > 0), F.date_add(start, d - 1))


def to_int(value: Column | str) -> Column:
    """Whole number of a number or text, fractions of texts cut."""
    v = number(strip(text(value)))
    return (F.floor(F.abs(v)) * F.signum(v).cast("int")).try_cast("int")


def coerce_rows(df: DataFrame, keys=tuple(V.SUBJECT_KEYS)) -> DataFrame:
    """Flat history rows brought to their types; missing columns become null."""
    have = set(df.columns)

    def get(name: str) -> Column:
        return F.col(name).cast("string") if name in have else F.lit(None).cast("string")

    out = [
        blank_to_null(strip(get("program_code"))).alias("program_code"),
        strip(get("program_name")).alias("program_name"),
        to_int(get("quota")).alias("quota"),
        to_int(get("extra_quota")).alias("extra_quota"),
        F.when(to_int(get("round")) == 2, 2).otherwise(1).alias("round"),
        percent(get("school_rank_percent")).alias("school_rank_percent"),
        blank_to_null(strip(get("english_listening"))).alias("english_listening"),
    ]
    for key in keys:
        score = to_int(get(f"{key}_score"))
        out.append(normalise_word_strict(get(f"{key}_std")).alias(f"{key}_std"))
        out.append(F.when(score.between(1, 15), score).alias(f"{key}_score"))
    out.append(blank_to_null(strip(get("notes"))).alias("notes"))
    passed = [c for c in df.columns if c not in {f.split(" ")[0] for f in _row_fields(keys)}]
    return df.select(*out, *passed)


def _row_fields(keys) -> list[str]:
    base = ["program_code", "program_name", "quota", "extra_quota", "round", "school_rank_percent", "english_listening", "notes"]
    return base + [f"{k}_std" for k in keys] + [f"{k}_score" for k in keys]
