"""E2/E3 over requirement rows packed into integers.

A standard's rank takes three bits, so the six subjects of a row or of a candidate are one integer.
A group of subjects of which any one counts is a list of subject numbers, three bits each, in the
group's own order, and a mask of its subjects. A candidate's slack gives a mask of subjects per value, so the best subject of
a group is the first value whose mask meets the group's, and subjects outside groups are one mask.

Everything is a projection without lambdas, which Spark compiles. A step that later ones read
more than once is the output of a one-row generator (``_once``): Spark neither repeats it there
nor moves a filter on the result below it, which would copy the whole expression.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.expr import SPACE

KEYS = V.SUBJECT_KEYS
SUBJECTS = range(len(KEYS))
ANY_OF = object()
"""Groups are those subjects of a row whose standards say "any of" and are the same (A14)."""
GIVEN = 8
"""Groups that a row can list; a row with more stops the query with an error."""
DETAIL = "array<struct<kind:string,key:string,required:int,user:int,deficit:int>>"

# How a standard can be written around its word.
PREFIX = "(?:任何一(?:科|門|门|項|项)?|任一)?"
SUFFIX = "(?:级以上|級以上|以上)?"
ANY_PREFIXES = ("任一", "任何一")


def _text(value: str) -> str:
    """An SQL string literal."""
    return "'" + "".join(f"\\u{ord(ch):04x}" if ch in SPACE or ch in "'\\" else ch for ch in value) + "'"


def _bits(parts: list[str], step: int) -> str:
    return " | ".join(f"shiftleft({part}, {step * k})" for k, part in enumerate(parts))


def _at(packed: str, k: int) -> str:
    return f"(shiftright({packed}, {3 * k}) & 7)"


def _once(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Columns computed once; each step is a compiled projection of its own, small enough for the JVM to optimise."""
    listed = ", ".join(f"{sql} as {name}" for name, sql in fields.items())
    kept = [f"`{name}`" for name in df.columns if name not in fields]
    return df.selectExpr(*kept, f"inline(array(struct({listed})))")


def _pattern() -> str:
    space = "[" + re.escape(SPACE) + "]*"
    return f"^{PREFIX}{space}({'|'.join(V.STANDARD_RANK)}){space}{SUFFIX}$"


def rank_of(standard: str | None) -> int:
    """Rank of a written standard, 0 if it cannot be read; the rule that ``pack`` applies to columns."""
    found = re.match(_pattern(), (standard or "").strip(SPACE))
    return V.STANDARD_RANK[found[1]] if found else 0


def pack_profile(profile: Mapping[str, str]) -> str:
    """A candidate's ranks as an SQL integer."""
    return str(sum(rank_of(profile.get(key)) << (3 * k) for k, key in enumerate(KEYS)))


def _codes(raw: str) -> str:
    """Rank of a stripped standard, plus 8 where it says "any of"; usual spellings are looked up."""
    usual = {}
    for word, rank in V.STANDARD_RANK.items():
        for suffix in ("", "以上", "级以上"):
            usual[word + suffix], usual["任一" + word + suffix] = rank, rank + 8
    known = "map(" + ", ".join(f"{_text(word)}, {code}" for word, code in usual.items()) + ")"
    ranks = "map(" + ", ".join(f"{_text(word)}, {rank}" for word, rank in V.STANDARD_RANK.items()) + ")"
    pattern = _text(_pattern())
    some = " or ".join(f"startswith({raw}, {_text(prefix)})" for prefix in ANY_PREFIXES)
    read = f"coalesce({ranks}[regexp_extract({raw}, {pattern}, 1)], 0)"
    return f"case when {raw} = '' then 0 else coalesce({known}[{raw}], {read} + if({some}, 8, 0)) end"


def _raw(struct: str) -> dict[str, str]:
    space = _text(SPACE)
    return {f"_s{k}": f"btrim(coalesce({struct}.{key}.standard, ''), {space})" for k, key in enumerate(KEYS)}


def pack(df: DataFrame, reqs: str = "reqs", groups: str | object | None = "choice_groups", out: str = "_packed") -> DataFrame:
    """Add the packed requirement row: ranks, subjects required, subjects outside groups, groups."""
    present = [f"if(coalesce({reqs}.{key}.standard, '') <> '' or coalesce({reqs}.{key}.min_score, 0) <> 0, 1, 0)" for key in KEYS]
    scored = " or ".join(f"coalesce({reqs}.{key}.min_score, 0) <> 0" for key in KEYS)
    names = df.columns
    df = _once(df, _raw(reqs) | {"_has": _bits(present, 1), "_scored": scored})
    df = _once(df, {f"_c{k}": _codes(f"_s{k}") for k in SUBJECTS})

    slots: list[str] = []
    both = "false"
    if groups is ANY_OF:
        for first in SUBJECTS[:-1]:
            earlier = " or ".join([f"_c{j} = _c{first}" for j in range(first)] or ["false"])
            members = " | ".join(f"if(_c{j} = _c{first}, {(j + 1) << (3 * j)}, 0)" for j in SUBJECTS[first:])
            slots.append(f"if(_c{first} <= 8 or {earlier} or ({members}) = {(first + 1) << (3 * first)}, 0, {members})")
        both = "_c2 > 8 and _c2 = _c3"
    elif groups is not None:
        subjects = "array(" + ", ".join(map(_text, KEYS)) + ")"
        df = _once(df, {f"_g{i}": f"array_intersect(get({groups}, {i}), {subjects})" for i in range(GIVEN)})
        for i in range(GIVEN):
            slots.append(_bits([f"coalesce(cast(array_position({subjects}, get(_g{i}, {p})) as int), 0)" for p in SUBJECTS], 3))
        slots[0] = f"if(size({groups}) > {GIVEN}, cast(raise_error('more than {GIVEN} choice groups in a row') as int), {slots[0]})"
        both = " or ".join(f"coalesce(array_contains(_g{i}, 'math_a') and array_contains(_g{i}, 'math_b'), false)" for i in range(GIVEN))
    # Equal requirements for both maths mean either one.
    slots.append(f"if((_c2 & 7) > 0 and (_c2 & 7) = (_c3 & 7) and not ({both}), {3 | 4 << 3}, 0)")
    df = _once(df, {"_rr": _bits([f"(_c{k} & 7)" for k in SUBJECTS], 3)} | {f"_t{i}": slot for i, slot in enumerate(slots)})

    df = _once(df, {f"_m{i}": f"{_members(f'_t{i}')} & _has" for i in range(len(slots))})
    used = " | ".join(f"_m{i}" for i in range(len(slots)))
    readable = _bits([f"if({_at('_rr', k)} > 0, 1, 0)" for k in SUBJECTS], 1)
    listed = ["_rr", readable, "_has", "if(_scored, 1, 0)", f"_has & ({readable}) & ~({used})", *[x for i in range(len(slots)) for x in (f"_t{i}", f"_m{i}")]]
    return _once(df, {out: f"array({', '.join(listed)})"}).select(*[F.col(f"`{n}`") for n in names], out)


def _fields(packed: str, slots: int) -> dict[str, str]:
    """The integers of a packed row as columns."""
    names = ["_rr", "_rs", "_has", "_scored", "_rest", *[x for i in range(slots) for x in (f"_g{i}", f"_m{i}")]]
    return {name: f"coalesce(get({packed}, {i}), 0)" for i, name in enumerate(names)}


def _members(slot: str) -> str:
    """Mask of a group's subjects."""
    return "(" + " | ".join(f"if({_at(slot, p)} > 0, shiftleft(1, {_at(slot, p)} - 1), 0)" for p in SUBJECTS) + ")"


def _slot_count(groups: str | object | None) -> int:
    return 1 + (len(KEYS) - 1 if groups is ANY_OF else GIVEN if groups is not None else 0)


def _first(mask: str, values: list[str]) -> str:
    """The value of the first subject in a mask."""
    return "case " + " ".join(f"when ({mask}) & {1 << k} <> 0 then {value}" for k, value in enumerate(values)) + " end"


RANKS = range(max(V.STANDARD_RANK.values()))


def _masks(names: str, difference: str) -> dict[str, str]:
    """Per value, the subjects whose two ranks are given and differ by it."""
    pairs = [(_at(f"_rr", k), _at("_ur", k)) for k in SUBJECTS]
    return {f"{names}{d}": _bits([f"if({r} > 0 and {u} > 0 and {difference.format(r=r, u=u)} = {d}, 1, 0)" for r, u in pairs], 1) for d in RANKS}


def _least(mask: str, names: str) -> str:
    """The smallest value of a group's subjects, null if none has one."""
    return "case " + " ".join(f"when {mask} & {names}{d} <> 0 then {d}" for d in RANKS) + " end"


def _verdict(cases: list[tuple[str, str]], other: str) -> str:
    return "case " + " ".join(f"when {test} then {value}" for test, value in cases) + f" else {other} end"


def match(df: DataFrame, ranks: str, slots: int, include_unknown: bool = False, packed: str = "_packed", out: str = "match") -> DataFrame:
    """struct(status, fit, reason); smaller fit is closer (Q2-Q4). ``ranks`` is an SQL integer."""
    names = df.columns
    df = _once(df, _fields(packed, slots) | {"_ur": f"coalesce({ranks}, 0)"})
    given = _bits([f"if({_at('_ur', k)} > 0, 1, 0)" for k in SUBJECTS], 1)
    df = _once(df, _masks("_a", "{u} - {r}") | {"_us": given})
    enough = " | ".join(f"_a{d}" for d in RANKS)
    df = _once(df, {f"_b{i}": _least(f"_m{i}", "_a") for i in range(slots)} | {"_bad": f"_rest & ~({enough})"})

    alone = [f"{d} * bit_count(_rest & _a{d})" for d in RANKS if d]
    fit = " + ".join([f"coalesce(_b{i}, 0)" for i in range(slots)] + alone)
    bad = [f"(_m{i} <> 0 and _b{i} is null)" for i in range(slots)]
    known = " ".join(f"when {b} then (_m{i} & _us & _rs) <> 0" for i, b in enumerate(bad))
    missing = _first("_bad", [f"if(_us & {1 << k} = 0, '缺少{key}成绩', null)" for k, key in enumerate(KEYS)])
    df = _once(df, {
        "_fit": f"cast({fit} as int)", "_none": " or ".join(bad), "_known": f"case {known} else true end", "_missing": missing,
        "_first": "_bad <> 0",
    })

    def out_of(status: str, reason: str, fit: str = "cast(null as int)") -> str:
        return f"named_struct('status', '{status}', 'fit', {fit}, 'reason', {reason})"

    cases = [(f"_has = 0", out_of("unknown", "'无科目要求'")), (f"_scored = 1", out_of("unknown", "'包含级分要求（需核对）'"))]
    cases += [("not _known", out_of("unknown", "'缺少可判定成绩'"))] if include_unknown else []
    cases += [("_none", out_of("fail", "'未满足任一条件'")), ("_missing is not null", out_of("unknown" if include_unknown else "fail", "_missing"))]
    cases += [("_first", out_of("fail", "'科目未达标'"))]
    verdict = _verdict(cases, out_of("pass", "cast(null as string)", "_fit"))
    return _once(df, {out: verdict}).select(*[F.col(f"`{n}`") for n in names if n != out], out)


def gap(df: DataFrame, ranks: str, slots: int, packed: str = "_packed", out: str = "gap") -> DataFrame:
    """struct(status, max_deficit, details, reason): what a failing row is short of."""
    names = df.columns
    df = _once(df, _fields(packed, slots) | {"_ur": f"coalesce({ranks}, 0)"})
    df = _once(df, _masks("_d", "greatest(0, {r} - {u})"))
    tested = " | ".join(f"_d{d}" for d in RANKS)
    df = _once(df, {f"_b{i}": _least(f"_m{i}", "_d") for i in range(slots)} | {"_bad": f"_rest & ~({tested})"})
    df = _once(df, {f"_x{i}": "case " + " ".join(f"when _b{i} = {d} then _d{d}" for d in RANKS if d) + " else 0 end" for i in range(slots)})
    # Of a group's subjects with the smallest deficit the first in the group's order counts.
    df = _once(df, {
        f"_k{i}": "coalesce(" + ", ".join(f"if(_x{i} & shiftright(shiftleft(1, {_at(f'_g{i}', p)}), 1) <> 0, {_at(f'_g{i}', p)} - 1, null)" for p in SUBJECTS) + ", 0)"
        for i in range(slots)
    })

    def detail(kind: str, key: str, k: str, deficit: str) -> str:
        rank, user = f"shiftright(_rr, 3 * {k}) & 7", f"shiftright(_ur, 3 * {k}) & 7"
        return f"array(named_struct('kind', '{kind}', 'key', {key}, 'required', {rank}, 'user', {user}, 'deficit', {deficit}))"

    nothing = f"cast(array() as {DETAIL})"
    subjects = "array(" + ", ".join(map(_text, KEYS)) + ")"
    short = {f"_o{i}": f"if(_b{i} > 0, {detail('or', f'{subjects}[_k{i}]', f'_k{i}', f'_b{i}')}, {nothing})" for i in range(slots)}
    for k, key in enumerate(KEYS):
        deficit = " + ".join(f"if(_d{d} & {1 << k} <> 0, {d}, 0)" for d in RANKS if d)
        short[f"_p{k}"] = f"if(_rest & ~_d0 & ({tested}) & {1 << k} <> 0, {detail('and', _text(key), str(k), deficit)}, {nothing})"
    deepest = ", ".join([f"coalesce(_b{i}, 0)" for i in range(slots)] + [f"if(_rest & _d{d} <> 0, {d}, 0)" for d in RANKS if d])
    no_option = " or ".join(f"(_m{i} <> 0 and _b{i} is null)" for i in range(slots))
    df = _once(df, short | {"_deepest": f"greatest(0, {deepest})", "_none": no_option})

    def out_of(status: str, deepest: str, details: str, reason: str) -> str:
        return f"named_struct('status', '{status}', 'max_deficit', {deepest}, 'details', {details}, 'reason', {reason})"

    def unknown(reason: str) -> str:
        return out_of("unknown", "cast(null as int)", nothing, reason)

    missing = _first("_bad", [f"'缺少{key}成绩'" for key in KEYS])
    cases = [(f"_has = 0", unknown("'无科目要求'")), (f"_scored = 1", unknown("'包含级分要求（需核对）'")), ("_none", unknown("'缺少可判定成绩'"))]
    cases += [("_bad <> 0", unknown(missing)), ("_deepest = 0", out_of("pass", "0", nothing, "cast(null as string)"))]
    verdict = _verdict(cases, out_of("fail", "_deepest", f"flatten(array({', '.join(short)}))", "cast(null as string)"))
    return _once(df, {out: verdict}).select(*[F.col(f"`{n}`") for n in names if n != out], out)


def with_ranks(df: DataFrame, profile: Mapping[str, str] | str, out: str = "_ranks") -> tuple[DataFrame, str]:
    """A candidate as an SQL integer: from a dict, or from a struct column with a standard per subject."""
    if isinstance(profile, Mapping):
        return df, pack_profile(profile)
    names = df.columns
    space = _text(SPACE)
    df = _once(df, {f"_s{k}": f"btrim(coalesce({profile}.{key}, ''), {space})" for k, key in enumerate(KEYS)})
    df = _once(df, {out: _bits([f"(({_codes(f'_s{k}')}) & 7)" for k in SUBJECTS], 3)})
    return df.select(*[F.col(f"`{n}`") for n in names if n != out], out), out


def slots_of(groups: str | object | None) -> int:
    """Group places of a row packed with ``groups``."""
    return _slot_count(groups)
