"""Ordered scans, dedupe and joins against brute force, with hot keys."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from cutline.operators import bands, dedupe, matching, scans, sets


def hot_rows(n=600, seed=1):
    """A third of all rows share one key."""
    rnd = random.Random(seed)
    return [(0 if i % 3 == 0 else rnd.randint(1, 9), rnd.randint(0, 400)) for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_gap_clusters_do_not_depend_on_slices(spark, width):
    rows = hot_rows()
    want = set()
    for key, vals in groupby(sorted(rows), key=lambda r: r[0]):
        cluster = []
        for _, v in vals:
            if cluster and v - cluster[-1] > 2:
                want.add((key, cluster[0], cluster[-1], len(cluster)))
                cluster = []
            cluster.append(v)
        want.add((key, cluster[0], cluster[-1], len(cluster)))
    got = scans.gap_clusters(spark.createDataFrame(rows, "k int, v int"), ["k"], "v", 2, width=width).collect()
    assert {(r["k"], r["start"], r["end"], r["n"]) for r in got} == want
    assert sum(r["n"] for r in got) == len(rows)


@pytest.mark.parametrize("width", [3, 50, 5000])
def test_coalesced_intervals(spark, width):
    rnd = random.Random(2)
    rows = [(k, s, s + rnd.randint(0, 9)) for k, s in hot_rows(seed=3)]
    want = set()
    for key, spans in groupby(sorted(rows), key=lambda r: r[0]):
        cur = None
        for _, s, e in spans:
            if cur and s <= cur[1] + 1:
                cur = (cur[0], max(cur[1], e))
            else:
                if cur:
                    want.add((key, *cur))
                cur = (s, e)
        want.add((key, *cur))
    df = spark.createDataFrame(rows, "k int, s int, e int")
    got = scans.coalesce_intervals(df, ["k"], "s", "e", 1, width).collect()
    assert {(r["k"], r["start"], r["end"]) for r in got} == want


@pytest.mark.parametrize("width", [2, 65536])
def test_run_islands(spark, width):
    rnd = random.Random(4)
    rows = [(k, i, rnd.random() < 0.3) for k in (0, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, p int, b boolean")
    got = {(r["k"], r["p"]): r["island"] for r in scans.run_islands(df, ["k"], "p", F.col("b"), width).collect()}
    for k in (0, 1):
        n = 0
        for kk, p, b in rows:
            if kk == k:
                n += b
                assert got[(k, p)] == n


def test_global_rank_is_a_total_order(spark):
    rows = [(i, (i * 7919) % 50) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, score int").repartition(5)
    got = {r["id"]: r["rank"] for r in scans.global_rank(df, [F.col("score").asc(), F.col("id").asc()]).collect()}
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert got == want


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_rows(), "k int, v int")
    top = scans.top_per_key(df, ["k"], [F.col("v").asc()], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.groupBy("k").count().filter("count > 2").count() == 0


def test_section_cut_equals_in_row_cut(spark):
    rnd = random.Random(5)
    rows = [(k, i, rnd.choice("abhs")) for k in range(20) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, p int, c string")
    cut = scans.section_cut(df, ["k"], "p", F.col("c") == "h", F.col("c") == "s")
    got = {r["k"]: r["n"] for r in cut.groupBy("k").agg(F.count("*").alias("n")).collect()}
    lists = df.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "c"))), lambda x: x["c"]).alias("l"))
    inner = lists.select("k", F.size(scans.cut_lines(F.col("l"), lambda x: x == "h", lambda x: x == "s")).alias("n"))
    assert {r["k"]: r["n"] for r in inner.collect()} == got


def test_keep_best_ignores_input_order(spark):
    rows = [(k, i, v % 5) for i, (k, v) in enumerate(hot_rows())]
    order = [F.col("q").desc(), F.col("i").asc()]
    first = dedupe.keep_best(spark.createDataFrame(rows, "k int, i int, q int"), ["k"], order).collect()
    random.Random(6).shuffle(rows)
    second = dedupe.keep_best(spark.createDataFrame(rows, "k int, i int, q int"), ["k"], order).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))


def test_first_occurrence_lists_cap(spark):
    rows = [(1, i, f"v{(i * 3) % 10}") for i in range(40)]
    df = spark.createDataFrame(rows, "k int, p int, v string")
    got = dedupe.first_occurrence_lists(df, ["k"], "v", ["p"], 4, "l").first()["l"]
    assert got == ["v0", "v3", "v6", "v9"]


TEXTS = [(1, "abcdef ghij"), (2, "zzabcdzz"), (3, ""), (4, None), (5, "ghij abcdef" * 30)]
ALIASES = [(1, "abcd"), (2, "ghij"), (3, "cdef ghij"), (3, "nothing here"), (4, "abcdefghij" * 5), (5, "j abcdefg")]


def test_contains_join_strategies_agree(spark):
    t = spark.createDataFrame(TEXTS, "tid int, t string")
    a = spark.createDataFrame(ALIASES, "aid int, a string")
    want = {(i, j) for i, x in TEXTS for j, y in ALIASES if x and y in x}
    small = matching.contains_join(t, "tid", "t", a, "aid", "a")
    grams = matching.contains_join(t, "tid", "t", a, "aid", "a", max_aliases=0)
    assert {tuple(r) for r in small.collect()} == want
    assert {tuple(r) for r in grams.collect()} == want


def test_contains_join_long_aliases(spark):
    rnd = random.Random(12)
    pool = ["".join(rnd.choices("abcdé中", k=rnd.randint(60, 200))) for _ in range(30)]
    texts = [(i, "".join(rnd.choices("abcdé中", k=300)) + rnd.choice(pool) + "zz" + rnd.choice(pool)[:90]) for i in range(60)]
    texts.append((60, pool[0]))
    aliases = list(enumerate(pool)) + [(99, "x" * 70)]
    want = {(i, j) for i, x in texts for j, y in aliases if y in x}
    t = spark.createDataFrame(texts, "tid int, t string")
    a = spark.createDataFrame(aliases, "aid int, a string")
    got = matching.contains_join(t, "tid", "t", a, "aid", "a", max_aliases=0)
    assert {tuple(r) for r in got.collect()} == want


def test_domain_join_equals_the_pairwise_test(spark):
    rnd = random.Random(7)
    parts = ["a", "b", "cn", "edu", "x"]
    names = {".".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(60)}
    hosts, domains = sorted(names)[::2], sorted(names)[1::2]
    h = spark.createDataFrame([(x,) for x in hosts], ["h"])
    d = spark.createDataFrame([(x,) for x in domains], ["d"])
    want = {x for x in hosts if any(x == y or x.endswith("." + y) or y.endswith("." + x) for y in domains)}
    assert {r["h"] for r in matching.domain_matches(h, "h", d, "d").collect()} == want


def test_band_join_equals_the_pairwise_test(spark):
    rnd = random.Random(8)
    left = [(i, rnd.random() * 100) for i in range(60)]
    right = [(i, rnd.random() * 100) for i in range(200)]
    lf = spark.createDataFrame([(1, *x) for x in left], "g int, l int, ly double")
    rf = spark.createDataFrame([(1, *x) for x in right], "g int, r int, ry double")
    want = {(i, j) for i, a in left for j, b in right if a - 3 <= b <= a + 3}
    got = [(r["l"], r["r"]) for r in bands.band_join(lf, rf, ["g"], "ly", "ry", 3.0).collect()]
    assert set(got) == want and len(got) == len(want)


def test_anchor_dedupe_is_chained(spark):
    boxes = [("d", "c", 0.0, 50.0, 1.0), ("d", "c", 2.0, 40.0, 2.0), ("d", "c", 4.0, 30.0, 3.0), ("d", "c", 90.0, 1.0, 4.0)]
    df = spark.createDataFrame(boxes, "doc string, code string, y0 double, x0 double, yc double")
    row = bands.dedupe_anchors(df, ["doc"], "code").first()
    assert (row["y0"], row["x0"]) == (4.0, 30.0)


def test_major_filter_never_empties_an_institution(spark):
    rows = [("a", ["x"], ["m"]), ("a", ["y"], ["m"]), ("b", ["m"], []), ("b", ["z"], []), ("c", ["q"], ["r"])]
    df = spark.createDataFrame(rows, "s string, rm array<string>, sm array<string>")
    got = sets.major_filter(df, "s", "rm", "sm", ["m"]).collect()
    assert sorted((r["s"], r["mapping_unknown"]) for r in got) == [("a", True), ("a", True), ("b", False)]


def test_fragments_with_gaps_in_their_positions_join(spark):
    df = spark.createDataFrame([("k", p, str(p)) for p in (0, 10, 20, 31, 47, 58, 66, 90)], "key string, pos long, value string")
    rows = scans.fragment_runs(df, ["key"], "pos", "value", F.lit(True)).orderBy("first_pos").collect()
    assert [(r["first_pos"], r["pieces"], r["joined"]) for r in rows] == [(0, 6, "01020314758"), (66, 2, "6690")]


def _brute_counts(anchors, words, tol, bounds):
    want = {}
    for g, ay in set(anchors):
        if g is None or ay is None:
            continue
        for h, wy, x in words:
            col = next((i for i in range(len(bounds) - 1) if bounds[i] <= x < bounds[i + 1]), None)
            if h == g and wy is not None and col is not None and ay - tol <= wy <= ay + tol:
                n, first = want.get((g, ay, col), (0, x))
                want[g, ay, col] = (n + 1, min(first, x))
    return {(*k, *v) for k, v in want.items()}


@pytest.mark.parametrize("tol", [0.0, 0.5, 3.0])
def test_band_counts_equal_the_pairs(spark, tol):
    rnd = random.Random(int(tol * 2))
    anchors = [(rnd.choice([1, 2, None]), rnd.choice([rnd.randint(-9, 30) / 4, 2.0, None])) for _ in range(60)]
    words = [(rnd.choice([1, 2, None]), rnd.choice([rnd.randint(-9, 30) / 4, None]), float(rnd.randint(-5, 40))) for _ in range(300)]
    words += [(1, 2.0, 7.0)] * 50
    bounds = [0.0, 10.0, 20.0, 35.0]
    left = spark.createDataFrame(anchors, "g int, ay double")
    right = spark.createDataFrame(words, "g int, wy double, x double")
    found = bands.band_counts(left, right, ["g"], "ay", "wy", "x", tol, bounds).collect()
    assert {(r["g"], r["ay"], r["col"], r["n_words"], r["first_x"]) for r in found} == _brute_counts(anchors, words, tol, bounds)
    assert len(found) == len({(r["g"], r["ay"], r["col"]) for r in found})


def test_band_counts_of_a_dense_band_make_no_pairs(spark):
    """10,000 lines and 10,000 words within one band: each line reads two running values."""
    n = 10_000
    left = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") / n).alias("ay"))
    right = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") / n).alias("wy"), F.lit(5.0).alias("x"))
    counted = bands.band_counts(left, right, ["g"], "ay", "wy", "x", 1.0, [0.0, 10.0])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert counted.agg(F.count(F.lit(1)).alias("lines"), F.min("n_words").alias("low")).first() == (n, n)


def test_opportunities_aggregate_without_a_sort(spark, sf):
    from cutline.plans.opportunities import picks

    rows = picks(spark, sf)
    rows.collect()
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_all_modes_equal_each_order(spark):
    """One sort over all modes gives what sorting by each order gives, opportunity modes included."""
    from cutline.operators import ordering

    rnd = random.Random(3)
    rows = [
        (i, rnd.choice(["985", "211", "双一流", "?", None]), rnd.choice(["high", "low", "none", None]), rnd.randint(1, 3), rnd.choice([None, 0, 3, 9]),
         rnd.choice([None, 0.5, 2.5]), rnd.choice([None, "2026-01-05", "2025-12-31"]), rnd.choice(["a", "b", None]))
        for i in range(300)
    ]
    schema = "i long, tier string, confidence string, status_rank int, best_fit int, oppty_score double, d string, school_name string"
    df = spark.createDataFrame(rows, schema).withColumn("deadline", F.col("d").cast("date")).repartition(5)
    kinds = [(m, True, o) for m in ("fit", "tier", "deadline", "other") for o in (False, True)] + [("fit", False, False)]
    modes = {f"m{j}": ordering.institution_keys(*kind) for j, kind in enumerate(kinds)}
    got = {r["i"]: r for r in scans.ranks_by_mode(df, ["i"], modes, [F.coalesce("school_name", F.lit("")), F.col("i")]).collect()}
    for j, kind in enumerate(kinds):
        want = [r["i"] for r in df.orderBy(*ordering.institution_order(*kind), "i").collect()]
        assert [got[i][f"m{j}"] for i in want] == list(range(1, 301)), kind
