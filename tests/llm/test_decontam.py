"""Leaks of long documents, at the borders of slices, of items that come under many ids, and the filter in chunks."""

import random

from pyspark.sql import functions as F

from cutline.llm import decontam, frames

ITEM = [f"item{k}" for k in range(20)]
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_a_row_never_holds_a_long_document(spark):
    """Every position of 30,000 tokens is a hit of four masks: with the whole token list beside each, 29 GB."""
    docs = spark.createDataFrame([(1, " ".join(ITEM * 1500))], DOCS)
    items = spark.createDataFrame([(7, " ".join(ITEM))], ITEMS)
    assert [tuple(r) for r in decontam.leaks(docs, items).collect()] == [(1, 7, 13, 13)]


def test_slices_hold_what_their_windows_reach(spark):
    words = [f"w{k}" for k in range(3 * decontam.SLICE + 50)]
    rows = decontam._slices(spark.createDataFrame([(1, " ".join(words)), (2, "one two three four")], DOCS), "doc_id", "text").orderBy("s").collect()
    hashes = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r["s"] for r in rows] == [0, decontam.SLICE, 2 * decontam.SLICE, 3 * decontam.SLICE]
    for r in rows:
        last = min(r["s"] + decontam.SLICE - 1 + decontam.WINDOW, len(words))
        assert r["m"] == len(words) and r["first"] == max(r["s"] - 3, 0)
        assert r["t"] == [h[0] for h in hashes[r["first"] : last]]


def test_leaks_at_the_borders_of_slices(spark):
    """Thirteen tokens with two changes are found wherever the border falls, with as many agreeing tokens."""
    found = [t if k not in (2, 9) else "other" for k, t in enumerate(ITEM[:13])]
    rows = [(n, " ".join([f"a{n}b{k}" for k in range(n)] + found + ["end"] * more)) for n in range(decontam.SLICE - 16, decontam.SLICE + 4) for more in (0, 3)]
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    got = decontam.leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, " ".join(ITEM))], ITEMS)).collect()
    assert {tuple(r) for r in got} == {(i, 1, 11, 13) for i, _ in rows} and len(got) == len(rows)


def test_items_of_equal_tokens_each_have_their_rows(spark):
    items = [(1, " ".join(ITEM)), (2, " ".join(ITEM).upper()), (None, " ".join(ITEM)), (2, " ".join(ITEM[:5])), (2, " ".join(ITEM))]
    docs = [(1, " ".join(ITEM)), (None, "start " + " ".join(ITEM)), (1, " ".join(ITEM[:5])), (3, " ".join(ITEM[:4]))]
    got = decontam.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, i, 13, 13)) for d in (1, None) for i in (1, 2, None))
    assert [r["doc_id"] for r in decontam.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()] == [3]


def test_only_likely_leaky_documents_are_shuffled(spark):
    """Of 2,000 documents two leak: their texts, and few others that the filter takes for them, meet the exact join."""
    rows = [(k if k % 7 else None, f"text {k} of words that no item holds and that end here") for k in range(2000)]
    docs = spark.createDataFrame([*rows, (1, " ".join(ITEM)), (5000, " ".join(ITEM))], DOCS)
    kept = decontam.decontaminate(docs, spark.createDataFrame([(1, " ".join(ITEM))], ITEMS))
    assert sorted(r["text"] for r in kept.collect()) == sorted(t for k, t in rows if k != 1)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1


def test_filter_in_chunks(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(6000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "h long")
    words = 4 * frames.CHUNK
    table = frames.bit_table(df.limit(3000), "h", words)
    assert sorted(r["n"] for r in table.select(F.size("bits").alias("n")).collect()) == [frames.CHUNK] * 4
    kept = {r["h"] for r in frames.maybe_in(df, table, "h", words).collect()}
    assert kept >= set(values[:3000]) and len(kept) < 3100
