"""Keyword groups and reference sets as tables."""

import json
import random

import pytest

from cutline.operators import lookup, refsets
from cutline.sources import readers


def plain(value, keyword):
    k = keyword.strip()
    if k.isascii() and all(ch.isalnum() or ch in "+_.-" for ch in k):
        return k.lower() in value.lower()
    return k in value


@pytest.mark.parametrize("bound", [0, 1000])
def test_hits_equal_the_plain_test(spark, bound):
    rng = random.Random(bound)
    alphabet = "abABé理工学 .KİΣΟσ"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    rows = [(i % 40, word(rng.randint(0, 60)), rng.choice([1, 2, None])) for i in range(120)]
    rows += [(i, "計算機 Computer Science", 2) for i in range(60)] + [(5, None, 1)]
    groups = [(f"g{i % 6}", word(rng.randint(1, 4))) for i in range(60)]
    groups += [("it", "computer"), ("it", " COMPUTER "), ("blank", "  "), ("none", None), ("kelvin", "k"), ("dot", "i")]
    want = {}
    for key, value, p in rows:
        for group, keyword in groups:
            if value and keyword and keyword.strip() and plain(value, keyword):
                old = want.get((key, group))
                want[key, group] = min(x for x in (old, p) if x is not None) if (old, p) != (None, None) else None
    values = spark.createDataFrame(rows, "id long, v string, p int")
    table = spark.createDataFrame(groups, "group_name string, keyword string")
    hits = refsets.group_hits(values, "id", "v", "p", table, max_aliases=bound)
    assert {(r["id"], r["group_name"]): r["p"] for r in hits.collect()} == want

    keys = values.select("id").distinct()
    got = {r["id"]: r["target"] for r in refsets.targets(keys, "id", hits, "p", ["g1", "it"]).collect()}
    best = {}
    for (key, group), p in want.items():
        if group in ("g1", "it"):
            best[key] = min(best.get(key, (True, 9, "~")), (p is None, p or 0, group))
    assert got == {k: best[k][2] if k in best else None for k in got}


def test_empty_tables(spark):
    values = spark.createDataFrame([], "id long, v string, p int")
    groups = spark.createDataFrame([("a", "x")], "group_name string, keyword string")
    assert refsets.group_hits(values, "id", "v", "p", groups).collect() == []
    some = spark.createDataFrame([(1, "x", 1)], values.schema)
    assert refsets.group_hits(some, "id", "v", "p", groups.limit(0)).collect() == []


def test_readers(spark, tmp_path):
    (tmp_path / "groups.json").write_text(json.dumps({"groups": {"it": {"label": "资讯", "keywords": ["软件", "AI"]}, "art": {"keywords": None}}}))
    rows = readers.read_keyword_groups(spark, str(tmp_path / "groups.json")).collect()
    assert sorted(tuple(r) for r in rows) == [("it", "资讯", "AI"), ("it", "资讯", "软件")]
    lines = [{"name": "甲大学", "set_name": "211", "precedence": 2}, {"name": "甲大学", "set_name": "985", "precedence": 1}, {"set_name": "x"}]
    (tmp_path / "sets.json").write_text("\n".join(json.dumps(x) for x in lines))
    sets = readers.read_reference_sets(spark, str(tmp_path / "sets.json"))
    df = spark.createDataFrame([("甲大学", ""), ("乙大学", "双一流")], "n string, t string")
    got = {r["n"]: r["local_tier"] for r in lookup.local_tier(df, sets, "n", "t").collect()}
    assert got == {"甲大学": "985", "乙大学": "双一流"}


def _shuffled(spark):
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_searched_values_are_not_shuffled(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("abcdefghijklmnop ", k=5000)) + ("Informatics" if i % 3 == 0 else ""), 1) for i in range(200)]
    values = spark.createDataFrame(rows, "id long, v string, p int")
    groups = spark.createDataFrame([("it", "informatics"), ("it", "computers"), ("art", "sculpture")], "group_name string, keyword string")
    before = _shuffled(spark)
    got = refsets.group_hits(values, "id", "v", "p", groups, max_aliases=0).collect()
    assert sorted(r["id"] for r in got) == list(range(0, 200, 3))
    assert sum(size for stage, size in _shuffled(spark).items() if stage not in before) < 100_000
