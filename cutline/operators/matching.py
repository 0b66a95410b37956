"""Containment and suffix joins without nested loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.expr import c
from ..functions.text import keyword_hit
from ..functions.urls import dot_suffixes
from ..session import cut_lineage

# Bounds under which the alias table travels to every task as one automaton.
MAX_BROADCAST_ALIASES = 50_000
MAX_BROADCAST_CHARS = 1_000_000


def contains_join(
    texts: DataFrame,
    text_id: str,
    text_col: str,
    aliases: DataFrame,
    alias_id: str,
    alias_col: str,
    max_aliases: int = MAX_BROADCAST_ALIASES,
    max_chars: int = MAX_BROADCAST_CHARS,
    shown: str | None = None,
    test: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Distinct (text id, alias id) pairs where the alias occurs in the text.

    Text ids must be unique, or rows that share one count as one text in parts.
    Up to the bounds the aliases become one automaton and every text is read once;
    beyond them the join runs on grams and no alias is collected. Both are exact.

    ``shown`` is another form of the text, character for character. Of it ``test`` sees the place where the alias
    occurs (for long aliases the whole) beside the alias id, and pairs stay that pass at one place at least.
    """
    if shown is None:
        texts, shown, test = texts.withColumn("_shown", F.col(text_col)), "_shown", lambda place, alias: F.lit(True)
    texts = texts.select(text_id, text_col, shown)
    clean = aliases.select(alias_id, alias_col).filter(F.length(alias_col) > 0).distinct()
    stats = clean.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.length(alias_col)), F.lit(0)).alias("chars"),
        F.coalesce(F.min(F.length(alias_col)), F.lit(1)).alias("shortest"),
        F.coalesce(F.max(F.length(alias_col)), F.lit(0)).alias("longest"),
    ).first()
    if stats["n"] <= max_aliases and stats["chars"] <= max_chars:
        found = _automaton_join(texts, text_id, text_col, shown, clean, alias_id, alias_col)
        return found.filter(test(F.col("_place"), F.col(alias_id))).select(text_id, alias_id).distinct()
    return _gram_join(texts, text_id, text_col, shown, test, clean, alias_id, alias_col, stats["shortest"], stats["longest"])


def _automaton_join(texts, text_id, text_col, shown, aliases, alias_id, alias_col) -> DataFrame:
    import ahocorasick

    rows = aliases.collect()  # size checked by the caller
    words: dict[str, list] = {}
    for row in rows:
        words.setdefault(row[alias_col], (len(row[alias_col]), []))[1].append(row[alias_id])
    shared = texts.sparkSession.sparkContext.broadcast(words)
    schema = f"{text_id} {texts.schema[text_id].dataType.simpleString()}, {alias_id} {aliases.schema[alias_id].dataType.simpleString()}, _place string"
    if not words:
        return texts.sparkSession.createDataFrame([], schema)

    alias_type = to_arrow_type(aliases.schema[alias_id].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for word, ids in shared.value.items():
            machine.add_word(word, ids)
        machine.make_automaton()
        for batch in batches:
            rows, hits, places = [], [], []
            for row, (value, whole) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if value:
                    found = {(i, whole[end + 1 - n : end + 1]) for end, (n, group) in machine.iter(value) for i in group}
                    rows.extend([row] * len(found))
                    hits.extend(i for i, _ in found)
                    places.extend(place for _, place in found)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, alias_type), pa.array(places, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[text_id, alias_id, "_place"])

    return texts.mapInArrow(scan, schema)


# Aliases of at least this many characters are found by window minima of their grams,
# about one gram in 25; shorter ones by all their grams.
LONG_ALIAS, LONG_GRAM = 64, 16


# Slots of the filters of gram hashes: a fixed size, whatever the number of aliases.
FILTER_BITS = 1 << 23


def _gram_hashes(value: str, q: int) -> np.ndarray:
    """Hashes of all overlapping grams of ``q`` characters."""
    codes = np.frombuffer(value.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = max(len(codes) - q + 1, 0)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(q if n else 0):
        h = h * np.uint64(1099511628211) + codes[j : n + j]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return h


def _alias_grams(aliases: DataFrame, value: str, q: int) -> DataFrame:
    """(alias row, gram hash, place of the gram) for all grams of the aliases."""
    grams = F.pandas_udf(lambda s: s.map(lambda v: _gram_hashes(v, q).view(np.int64)), "array<bigint>")
    return aliases.select("*", F.posexplode(grams(value)).alias("at", "gram"))


def _filter_of(grams: DataFrame):
    """The gram hashes folded into bits of a fixed size, for the tasks that read the texts; an exact join follows."""
    slot = F.col("gram").bitwiseAND(FILTER_BITS - 1)
    bit = F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int"))
    rows = grams.groupBy(F.shiftright(slot, 3).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    bits[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.uint8)
    return grams.sparkSession.sparkContext.broadcast(bits)


def _wanted(value: str, q: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams of a text that the filter lets through."""
    h = _gram_hashes(value, q)
    slot = h & np.uint64(FILTER_BITS - 1)
    places = np.flatnonzero((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
    return places, h[places].view(np.int64)


def _gram_counts(texts: DataFrame, value: str, q: int, shared) -> DataFrame:
    """(gram hash, number of places) of the wanted grams."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_wanted(v or "", q, shared.value)[1] for v in batch.column(0).to_pylist()]
            grams, counts = np.unique(np.concatenate(found) if found else np.empty(0, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], names=["gram", "n"])

    return texts.select(value).mapInArrow(scan, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("_df"))


def _gram_places(texts: DataFrame, text_id: str, q: int, longest: int, shared) -> DataFrame:
    """Wanted grams of each text with what stands around them, as far as an alias can reach, in both forms of the text."""
    reach = longest - q
    schema = f"{text_id} {texts.schema[text_id].dataType.simpleString()}, gram bigint, at_text int, around string, around_shown string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, (value, whole) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                places, grams = _wanted(value or "", q, shared.value)
                spans = ((g, i, max(i - reach, 0), i + longest) for i, g in zip(places.tolist(), grams.tolist()))
                here = {(g, i - lo, value[lo:hi], whole[lo:hi]) for g, i, lo, hi in spans}
                rows.extend([row] * len(here))
                found.extend(here)
            grams, at, around, other = zip(*found) if found else ((), (), (), ())
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(grams, pa.int64()), pa.array(at, pa.int32()),
                pa.array(around, pa.string()), pa.array(other, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[text_id, "gram", "at_text", "around", "around_shown"])

    return texts.mapInArrow(scan, schema)


def _window_keys(df: DataFrame, key: str, value: str, q: int, span: int) -> DataFrame:
    """(key, gram hash) for the smallest gram hash of every window of ``span`` characters.

    A text that contains an alias of ``span`` characters or more contains its windows,
    so it selects the same minima; far fewer keys than all grams are shuffled.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, gram bigint"

    def minima(text: str) -> np.ndarray:
        h = _gram_hashes(text, q)
        if len(h) < span - q + 1:
            return np.empty(0, dtype=np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(h, span - q + 1)
        return np.unique(windows.min(axis=1)).view(np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [minima(v or "") for v in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(m) for m in found])
            grams = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
            columns = [batch.column(0).take(pa.array(rows)), pa.array(grams, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "gram"])

    return df.select(key, value).mapInArrow(scan, schema)


def _gram_join(texts, text_id, text_col, shown, test, aliases, alias_id, alias_col, shortest: int, longest: int) -> DataFrame:
    """Each alias is looked up by its rarest gram in the texts, then tested on what stands around that gram.

    Texts are read where they lie: only grams that aliases hold leave a task, with the few characters around them.
    """
    edges = sorted({shortest, *[e for e in (8, 24, LONG_ALIAS) if shortest < e <= longest]}) + [longest + 1]
    out = None
    for q, upper in zip(edges, edges[1:]):
        part = aliases.filter(F.length(alias_col).between(q, upper - 1))
        if q >= LONG_ALIAS:
            hits = _long_hits(texts, text_id, text_col, shown, test, part, alias_id, alias_col, q)
        else:
            grams = _alias_grams(part, alias_col, q)
            freq = _gram_counts(texts, text_col, q, _filter_of(grams))
            # An alias with a gram no text holds cannot occur.
            rarest = F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "gram", "at")).alias("_a")
            anchors = grams.join(freq, "gram", "left").groupBy(alias_id, alias_col).agg(rarest).filter("_a.df > 0")
            anchors = cut_lineage(anchors.select(alias_id, alias_col, "_a.gram", "_a.at"))
            places = _gram_places(texts, text_id, q, upper - 1, _filter_of(anchors))
            start, length = F.col("at_text") - F.col("at"), F.length(alias_col)
            met = places.join(anchors, "gram").filter((start >= 0) & (F.substr("around", start + 1, length) == F.col(alias_col)))
            hits = met.filter(test(F.substr("around_shown", start + 1, length), F.col(alias_id))).select(text_id, alias_id)
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()


def _long_hits(texts, text_id, text_col, shown, test, aliases, alias_id, alias_col, q: int) -> DataFrame:
    numbered = aliases.select(alias_id, alias_col, F.xxhash64(alias_id, alias_col).alias("_alias"))
    alias_keys = _window_keys(numbered, "_alias", alias_col, LONG_GRAM, q)
    text_keys = _window_keys(texts, text_id, text_col, LONG_GRAM, q)
    freq = text_keys.join(alias_keys.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("_df"))
    # An alias with a key no text holds cannot occur: its rarest count is 0.
    anchors = (
        alias_keys.join(freq, "gram", "left")
        .groupBy("_alias")
        .agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "gram")).alias("_a"))
        .filter("_a.df > 0")
        .select("_alias", F.col("_a.gram").alias("gram"))
    )
    pairs = text_keys.join(anchors, "gram").join(numbered, "_alias").select(text_id, alias_id, alias_col)
    hits = pairs.join(texts, text_id).filter(F.col(text_col).contains(F.col(alias_col)))
    return hits.filter(test(F.col(shown), F.col(alias_id))).select(text_id, alias_id)


def names_in_texts(texts: DataFrame, text_id: str, text_col: str, names: DataFrame, name: str, aliases: Column, **kw) -> DataFrame:
    """J8 over institution names: a name matches when any of its aliases does."""
    exploded = names.select(name, F.explode(aliases).alias("_alias"))
    return contains_join(texts, text_id, text_col, exploded, name, "_alias", **kw)


def domain_matches(hosts: DataFrame, host: str, domains: DataFrame, domain: str) -> DataFrame:
    """Distinct hosts equal to a domain, below one, or above one.

    Two equi semi joins on label suffixes replace the pairwise test. Both sides are
    made distinct first, so a host with many rows weighs one row.
    """
    h = hosts.select(F.col(host).alias("_h")).filter("_h <> ''").distinct()
    d = domains.select(F.col(domain).alias("_d")).filter("_d <> ''").distinct()
    h_suffix = h.select("_h", F.explode(dot_suffixes("_h")).alias("_s"))
    below = h_suffix.join(d, F.col("_s") == F.col("_d"), "left_semi").select("_h")
    d_suffix = d.select(F.explode(dot_suffixes("_d")).alias("_s")).distinct()
    above = h.join(d_suffix, F.col("_h") == F.col("_s"), "left_semi")
    return below.union(above).distinct().withColumnRenamed("_h", host)


def target_hit(majors: Column | str, labels: Column | str, keywords) -> Column:
    """Any major, else any row label, hits a keyword."""
    return F.coalesce(F.exists(c(majors), lambda m: keyword_hit(m, keywords)), F.lit(False)) | F.coalesce(
        F.exists(c(labels), lambda x: keyword_hit(x, keywords)), F.lit(False)
    )


def group_keywords(keyword_groups: dict[str, list[str]], selected, extra=()) -> list[str]:
    """Keywords of the selected groups plus the custom ones, each once in order."""
    words = [w for g in selected for w in keyword_groups.get(g, [])] + list(extra)
    return list(dict.fromkeys(w.strip() for w in words if w and w.strip()))
