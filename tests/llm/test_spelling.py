"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cutline.llm import queries, spelling

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def words_of(rows, every=None):
    found = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{word}".encode())
            if every and h % every == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def brute(words):
    near = {w: set() for w in words}
    deleted = {}
    for w in words:  # words one edit apart share a word with one letter less, or one is it
        for k in range(len(w)):
            deleted.setdefault(w[:k] + w[k + 1 :], set()).add(w)
        deleted.setdefault(w, set()).add(w)
    for group in deleted.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_documents(spark):
    rows = [(1, "Colour colour COLOUR color color color colours " * 4), (2, None), (3, ""), (None, "colour " * 5), (1, "Ärger ärger ärger ärger ÄRGER " * 3)]
    rows += [(4, "12 aaaaa aaaaaa aaaaaaa " * 40 + "aaaaab " * 5), (5, "x×÷yz " * 9), (6, "abcde" * 300 + " " + "word " * 100_000), (6, "abcde" * 300), (7, "abcde" * 300)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit("old"), "n": F.lit(3), "id": F.lit(0)})
    for every in (None, 3):
        assert rows_of(spelling.variants(df, every=every)) == brute(words_of(rows, every))
    assert spelling.variants(df.limit(0)).count() == 0


def test_chains_of_forms(spark):
    words = {"abcdefgh": 3, "abcdefghi": 6, "abcdefghij": 12, "abcdefghijk": 24, "abcdefghijkl": 48, "zzzzz": 5, "zzzzzz": 9, "zzzzy": 10, "zzzzx": 10}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.grouped(df)) == brute(words)


@settings(max_examples=6, deadline=None)
@given(st.sets(st.text("abÀé", min_size=5, max_size=9), min_size=2, max_size=60), st.randoms())
def test_pairs_of_close_words(spark, found, random):
    words = {w: random.randint(3, 50) for w in found}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(df).collect()}
    assert len(got) == spelling.near_pairs(df).count()
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


@pytest.mark.parametrize("name", ["op13_spelling_variants"])
def test_query_equals_brute_force(spark, sf, name):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.QUERIES[name](spark, sf)) == brute(words_of(rows, 97))
