"""The pipeline's stages against brute force on its smallest input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from cutline.llm import neardup, wordhash


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute(rows, width):
    sets = {i: shingle_set(t, width) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= 80 * (len(x) + len(y) - shared):
                    ra, rb = sorted((root(a), root(b)))
                    comp[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_links_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for width in (4, 5):
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(docs, width=width).collect()}
        assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], width)


def test_links_in_a_group_of_near_copies(spark):
    """Copies with growing edits: each links with its neighbours, and few with all others."""
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for j in range(i % 12):
            words[(i * 13 + j * 37) % 150] = f"x{i}-{j}"
        rows.append((i, " ".join(words)))
    got = neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), width=5).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 5)


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["A b\tc  d", None, "", "x", "É é y", "a B C D", "long" * 3000]
    hashes, offsets = wordhash.words(pa.array(texts))
    assert list(offsets) == [0, 4, 4, 4, 5, 7, 11, 12]
    assert list(hashes[:4]) == list(hashes[7:11]) and len(set(hashes)) == 8
    again, _ = wordhash.words(pa.array(["x", "d"]))
    assert again[0] == hashes[4] and again[1] == hashes[3]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, seen = seen, stage(spark, seen, sf)
        seen.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/test-{name}")
        seen = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/test-{name}")
        counts.append(seen.count())
        if name == "near_dedup":
            rows = brute([(r["doc_id"], texts[r["doc_id"]]) for r in before.select("doc_id").collect()], 5)
            assert {r["doc_id"] for r in seen.select("doc_id").collect()} == {i for i, (_, c) in rows.items() if i == c}
        if name == "toxicity":
            gone = {r["doc_id"] for r in before.select("doc_id").collect()} - {r["doc_id"] for r in seen.select("doc_id").collect()}
            assert not any(labels.get(i) == 0 for i in gone)
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    run = corpus_pipeline.run(spark, sf)
    assert sorted(r["doc_id"] for r in run.collect()) == sorted(r["doc_id"] for r in seen.collect())
    assert run.agg(F.min("taken")).first()[0] > 0
