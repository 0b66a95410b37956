"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, per operator and stage."""

import json
import math
import pkgutil
import textwrap
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cutline.llm import ann, decontam, htmltext, langid, licences, lm, mixing, neardup, toolcalls, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(start: int, n: int = 40) -> str:
    return " ".join(f"{WORDS[(start * 7 + i * i) % 20]}{(start * 31 + i) % 97}" for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, prose(1), "en", "a", 10),
        (2, prose(1), "en", "a", 10),
        (2, prose(1), "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n", "en", None, 3),
        (None, prose(5), "en", "b", 1),
        (6, prose(6) + " You stupid idiot! " + prose(7), "en", "b", 1),
        (7, "word " * 200_000, "en", "c", 1_000_000),
        (8, "12 34 !?", "xx", "c", 8),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df, *names):
    return df.withColumns({n: F.lit("old") for n in names})


def test_language(spark, docs, none):
    model = langid.train([("en", "the quick brown fox and the dog " * 9), ("de", "der schnelle braune fuchs und der hund " * 9)])
    found = langid.identify(clash(docs, "score", "LANG_PRED"), "text", model)
    assert found.count() == docs.count()
    rows = {r["doc_id"]: r for r in found.collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (3, 4, 5, 8))
    assert rows[1]["lang_pred"] in ("de", "en") and 0 <= rows[1]["score"] <= 1
    assert langid.identify(none, "text", model).count() == 0
    empty = langid.identify(docs, "text", langid.fit(none, F.lit(True)))
    assert {(r["lang_pred"], r["score"]) for r in empty.collect()} == {("und", 0.0)}


def test_language_lengths_are_a_distribution():
    model = langid.train([("en", "abracadabra banana bandana " * 3)])
    import numpy as np

    p = np.exp2(-model.bits[:, 0].astype(float)).reshape(-1, langid.SYMBOLS)
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_toxicity(spark, docs, none):
    lines = [(i, prose(i, 10 + i * 7 % 180) + (" you stupid idiot moron " if i % 3 == 0 else " plain end ")) for i in range(200)]
    train = spark.createDataFrame(lines, "doc_id long, text string")
    labels = train.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("toxic"))
    labels = labels.union(spark.createDataFrame([(9999, None), (None, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(train, labels, F.lit(True))
    rows = {r["doc_id"]: r["score"] for r in toxicity.score(clash(docs, "score"), model).collect()}
    assert rows[6] >= 0.7 and rows[1] < 0.7 and all(0 <= s <= 1 for s in rows.values())
    assert toxicity.score(none, model).count() == 0
    one_class = toxicity.fit(train, labels.filter("toxic = 0"), F.lit(True))
    assert one_class.trees is None and toxicity.score(docs, one_class).filter("score = 0").count() == docs.count()
    assert toxicity.fit(none, labels.limit(0), F.lit(True)).prior == 0


def test_near_duplicates(docs, none):
    linked = neardup.link(clash(docs, "kept", "n"), width=4).collect()
    rows = {r["id"]: r for r in linked if r["id"] is not None}
    assert len(linked) == 10 and rows[2]["component_id"] == 1 and not rows[2]["kept"] and rows[1]["kept"]
    assert all(rows[i]["n_shingles"] == 0 and rows[i]["component_id"] == i and rows[i]["kept"] for i in (3, 4, 5))
    assert neardup.link(none).count() == 0
    kept = neardup.keep_one(docs)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert kept.columns == docs.columns


def test_near_duplicates_of_each_text_of_a_shared_id(spark):
    texts = [prose(1), prose(2)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0].rsplit(" ", 1)[0] + " end"), (3, texts[1].rsplit(" ", 1)[0] + " end")]
    linked = neardup.link(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({r["n_shingles"] for r in linked.collect()}) == 1
    assert {(r["id"], r["component_id"]) for r in linked.collect()} == {(1, 1), (2, 1), (3, 1)}


def test_leaks(spark, docs, none):
    item = " ".join(prose(1).split()[5:30])
    changed = item.split()
    changed[4], changed[15] = "other", "others"
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "too short one"), (5, "12 34")], "item_id long, text string")
    more = docs.union(spark.createDataFrame([(20, "start " + " ".join(changed) + " end", "en", "a", 1)], SCHEMA))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(clash(more, "item_id", "seed"), items).collect()}
    assert found == {(1, 1), (2, 1), (20, 1)}
    assert decontam.leaks(none, items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0
    assert decontam.decontaminate(docs, items).count() == docs.count() - 3


@pytest.mark.parametrize("a", range(15))
def test_any_two_substitutions_are_seen(a):
    """With two of fifteen tokens replaced some mask fits, or the overlap is no longer 80 percent of a window."""
    for b in range(a + 1, 15):
        lost = {a, b}
        hit = any(all(p + k not in lost for k, c in enumerate(mask) if c == "1") for mask in decontam.MASKS for p in range(15 - decontam.SPAN + 1))
        assert hit, (a, b)


def test_every_allowed_change_is_seen_at_every_length(spark):
    items, rows = [], []
    for n in range(decontam.SHORT, decontam.WINDOW + 1):
        words = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        changes = n - math.ceil(n * decontam.AGREE)
        rows += [(n, " ".join("other" if k in lost else w for k, w in enumerate(words)), changes) for lost in combinations(range(n), changes)]
    rows = [(i, *row) for i, row in enumerate(rows)]
    found = decontam.leaks(spark.createDataFrame(rows, "doc_id long, n long, text string, changes long"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in found.collect()} == {(i, n, n - changes, n) for i, n, _, changes in rows}


def test_leaks_in_scripts_without_spaces(spark):
    items = spark.createDataFrame([(1, "北京大学的录取分数线是多少")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "请问北京大学的录取位数线是多少呢"), (2, "请问上海交通大学在哪里")], "doc_id long, text string")
    assert [tuple(r) for r in decontam.leaks(docs, items).collect()] == [(1, 1, 12, 13)]


def test_mix(spark, docs, none):
    rows = mixing.mix(clash(docs, "taken", "shards")).collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(rows, key=str) == sorted(mixing.mix(clash(docs, "taken", "shards")).collect(), key=str)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for source in by.values():
        assert abs(sum(r["taken"] for r in source) - source[0]["target"]) <= 2 * mixing.BLOCK
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs.filter("doc_id in (3, 4)")).agg(F.sum("taken")).first()[0] == 0


def test_sainte_lague_equals_highest_quotients(spark):
    votes = {"a": 53000, "b": 24000, "c": 23000, "d": 0, "e": 7}
    parties = spark.createDataFrame([(k, v, 97) for k, v in votes.items()], "name string, votes long, total long")
    got = {r["name"]: r["seats"] for r in mixing.apportion(parties, [], "name", "votes", "seats", "total").collect()}
    want = dict.fromkeys(votes, 0)
    for _ in range(97):
        best = max(votes, key=lambda k: votes[k] / (2 * want[k] + 1))
        want[best] += 1
    assert got == want


def test_neighbours_find_the_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    points = rng.normal(size=(1500, 16))
    points[700:760] = points[0]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    bad = [(5000, None), (5100, []), (5200, [0.0] * 16), (5300, [float("nan")] * 16), (None, rows[1][1]), (5400, [None] + [1.0] * 15), (5500, [1.0])]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<double>")
    got = ann.nearest(clash(df, "score", "rank"), F.col("vec_id") % 100 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 1500, 100))
    hits = total = 0
    for q, rows_of in found.items():
        gap = np.sqrt(((points - points[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(1500), gap)) if i != q][:10]
        ids = [i for _, i, _ in sorted(rows_of)]
        hits += len(set(ids) & set(want))
        total += 10
        assert [r for r, _, _ in sorted(rows_of)] == list(range(1, 11)) and all(abs(s - gap[i]) < 1e-12 for _, i, s in rows_of)
    assert hits / total >= 0.9
    assert found[0] and [i for _, i, _ in sorted(found[0])] == list(range(700, 710))
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(df.filter("vec_id < 4"), F.col("vec_id") == 0).count() == 3


def test_language_model_equals_brute_force(spark, docs, none):
    import math
    from collections import Counter

    texts = [(i, " ".join(WORDS[(i * j) % (5 + i % 7)] for j in range(i % 23)), i % 5) for i in range(300)] + [(None, None, 0), (7, "Alpha  beta\tALPHA", 0)]
    rows = [(i, t, 0 if f == 1 else 2 if f == 2 and i % 3 == 0 else 1) if i is not None else (i, t, 0) for i, t, f in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, fold int")
    got = sorted(((r["id"], r["fold"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.score(df, "fold").collect()), key=str)

    def tokens(t):
        return [*(t or "").lower().split(), None]

    def counts(folds):
        one, two, n_docs = Counter(), Counter(), 0
        for _, t, f in rows:
            if f in folds:
                n_docs += 1
                w = tokens(t)
                one.update(w)
                two.update(zip(["<s>", *w[:-1]], w))
        one["<s>"] = 0
        return one, two, n_docs, sum(one.values()), sum(c > 0 for c in one.values())

    def parts(t, table):
        one, two, n_docs, n, v = table
        w = tokens(t)
        for a, b in zip(["<s>", *w[:-1]], w):
            base = (one[b] + 0.5) / (n + 0.5 * (v + 1))
            c = n_docs if a == "<s>" else one[a]
            yield base, (two[a, b] / c / base if c else 0), (int(math.log2(c)) if c else None), one[b] > 0

    kept, train = counts({1}), counts({1, 2})
    seen = Counter()
    for _, t, f in rows:
        if f == 2:
            for _, ratio, bucket, _ in parts(t, kept):
                if bucket is not None:
                    x = -1 if ratio == 0 else int(min(max((math.log2(ratio) - lm.LOWEST_BIN) / lm.BIN_WIDTH, 0), lm.BINS - 1))
                    seen[bucket, x] += 1
    weights = lm.learn_weights([(b, x, n) for (b, x), n in seen.items()])
    want = []
    for i, t, f in rows:
        p = list(parts(t, train))
        base = sum(math.log10(b) for b, *_ in p)
        full = sum(math.log10(b * (weights[k] * r + 1 - weights[k])) if k is not None else math.log10(b) for b, r, k, _ in p)
        want.append((i, f, len(p), sum(k for *_, k in p), train[3], base, full))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)
    assert sum(w[6] for w in want) > sum(w[5] for w in want)
    assert lm.score(none.withColumn("fold", F.lit(1)), "fold").count() == 0
    assert lm.score(docs.withColumn("fold", F.lit(0)), "fold").agg(F.max("score"), F.min("score")).first() == (0.0, 0.0)


def test_licences(spark, docs, none):
    mit = next(t for name, t in licences.KNOWN if name == "MIT")
    rows = [
        (1, "Copyright (c) 2020 Someone\n(c) others\n\n" + mit.upper().replace(", ", ",\n").replace("SUBLICENSE", "sub-license")),
        (2, "text\nreleased under the MIT licence\nAll rights reserved\nALL RIGHTS RESERVED."),
        (3, "We say all rights reserved. Always."),
        (4, None),
        (5, ""),
    ]
    found = licences.scan(clash(spark.createDataFrame(rows, "doc_id long, text string"), "digest", "c"), licences.known_digests(spark))
    got = {(r["doc_id"], r["licence"], r["whole_text"], r["lines"]) for r in found.collect()}
    assert got == {(1, "MIT", True, 0), (2, "MIT", False, 1), (2, "LicenseRef-all-rights-reserved", False, 2)}
    assert licences.scan(none, licences.known_digests(spark)).count() == 0


def test_whole_licence_texts(spark):
    texts = {}
    for row in map(json.loads, pkgutil.get_data("cutline.llm", "licence_texts.jsonl").decode().splitlines()):
        texts[row["licence"]] = f"{row['text']}\n\n{row['tail']}"
    assert {"BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Unlicense"} < set(texts)
    isc, bsd = texts["ISC"], texts["BSD-3-Clause"]
    wrapped = "\n\n".join(textwrap.fill(p, 72) for p in isc.split("\n\n"))
    assert "\ncopyright notice" in wrapped
    rows = list(texts.items()) + [
        ("MIT", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + texts["MIT"]),
        ("ISC", "ISC License\n\nCopyright (c) 2020 Someone\n\n" + wrapped),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + bsd.replace(", ", ",\n")),
    ]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    found = {(r["doc_id"], r["licence"]) for r in licences.scan(docs, licences.known_digests(spark)).filter("whole_text").collect()}
    assert found == {(i, licence) for i, (licence, _) in enumerate(rows)}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            ("c", "b", 2, "sum", {"x": "1", "y": "2.50"}, "a"),
            ("c", "a", 3, "sum", {"y": "x"}, None),
            ("c", "a", 9, "late", {"y": "1"}, None),
            ("c", "d", 4, "none", None, "missing"),
            ("c", "l1", 5, "sum", {"x": "01", "z": "q\"\n"}, "l2"),
            ("c", "l2", 6, "sum", {"x": "1"}, "l1"),
            (None, "n", 1, "sum", {"x": "1"}, None),
        ],
        "conv_id string, call_id string, turn long, name string, arguments map<string,string>, parent string",
    )
    results = spark.createDataFrame([("c", "a", 8, "later"), ("c", "a", 7, "é\"first"), ("c", "o", 1, None)], "conv_id string, call_id string, turn long, content string")
    schemas = spark.createDataFrame([("sum", "x", "integer", True), ("sum", "y", "number", False)], "name string, field string, type string, required boolean")
    rows = {r["call_id"]: r for r in toolcalls.link(calls, results, schemas).collect()}
    assert set(rows) == {"a", "b", "d", "l1", "l2", "o"}
    assert {k: (r["status"], r["depth"], r["position"], r["errors"]) for k, r in rows.items()} == {
        "a": ("linked", 0, 1, "missing:x,type:y"),
        "d": ("pending", 0, 2, "tool"),
        "b": ("pending", 1, 3, ""),
        "l1": ("pending", None, None, "type:x,unknown:z"),
        "l2": ("pending", None, None, ""),
        "o": ("orphan", None, None, None),
    }
    assert rows["b"]["json"] == '{"arguments":{"x":1,"y":2.50},"id":"b","name":"sum","result":null}'
    assert rows["a"]["json"] == '{"arguments":{"y":"x"},"id":"a","name":"sum","result":"é\\"first"}'
    assert toolcalls.link(calls.limit(0), results.limit(0), schemas).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav class="menu"><ul><li><a href=x>Home</a></li><li><a>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, agree?</div><div id="content"><h1>Head&amp;line</h1><p>First <b>bold</b> text,<br>next &eacute;
line. It goes on for a while, as articles do.<p>Second part of it, with words.<div class="ad">Buy now</div></div>
<div class="comments"><p>A reader says that this is a nice article indeed.</p></div><form><label>Mail</label></form>
<footer>&copy; somebody</footer><script>var a = "</p>";</script></body></html>"""


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    forest = htmltext.fit(pages)
    rows = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>"), (5, "plain"), (6, "<div>" * 3000 + "x")], "page_id long, html string")
    got = {r["page_id"]: r for r in htmltext.extract(clash(rows, "TEXT"), forest).collect()}
    assert got[1]["text"] == "Head&line First bold text, next é line. It goes on for a while, as articles do. Second part of it, with words."
    assert all(got[i]["text"] == "" and got[i]["n_chars"] == 0 for i in (2, 3, 4))
    assert htmltext.extract(rows.limit(0), forest).count() == 0
    out = htmltext.extract(pages, forest)
    import re
    from html import unescape

    for r in out.join(pages.select("page_id", F.col("html").alias("raw")), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r["raw"], re.S)[1]
        assert r["text"] == " ".join(unescape(re.sub(r"</?(p|br|h1)>", " ", body).replace("<b>", "").replace("</b>", "")).split())


@pytest.mark.parametrize("items", [50, 1997, 1998, 6000])
def test_head_share_is_of_characters_on_pages_of_every_size(items):
    tree = htmltext.parse("<body><p>" + "long " * 500 + "</p>" + "<p>x</p>" * items + "</body>")
    chars = [items + 2499] * 2 + [2499] + [1] * items
    assert len(tree.nodes) == len(chars)
    got = htmltext.features(tree)[:, htmltext.FEATURES.index("head_share")]
    assert got.tolist() == [sum(chars[:i]) / sum(chars) for i in range(len(chars))]


def test_decoding_is_optimal():
    import itertools

    import numpy as np

    tree = htmltext.parse("<div><p>a<b>x</b></p><ul><li>b</li></ul></div><p>c</p>")
    rng = np.random.default_rng(3)
    for _ in range(20):
        p = rng.uniform(0.01, 0.99, len(tree.nodes))
        got = htmltext.decode(tree, p)
        best = max(
            (c for c in itertools.product([False, True], repeat=len(p) - 1) if all(not k or n.parent == 0 or c[n.parent - 1] for k, n in zip(c, tree.nodes[1:]))),
            key=lambda c: sum(np.log(q if k else 1 - q) for k, q in zip(c, p[1:])),
        )
        assert tuple(got[1:]) == best


def test_stages_on_odd_rows(spark, docs, none, sf):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, none, sf).count() == 0
    assert corpus_pipeline.source_mix(spark, none, sf).count() == 0
