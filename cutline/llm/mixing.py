"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Sizes: words per document, summed per source. Sources in code-point order (null last) weigh
   3, 1, 2, repeating. Their targets share ``budget`` times all words by weight; none is above
   ``most`` times its source's words, and what that cuts is shared again by weight until none is
   above: each target is min(cap, level * weight), the level found in one pass over the sources
   ordered by cap / weight.
2. Apportionment: the mix is dealt out as equal blocks of ``block`` words. Blocks go to sources,
   then inside every source to its shards (hash buckets of documents), by the highest quotients
   votes / (2 * seats - 1). Only quotients near the cut are listed: with n parties and M seats,
   rounding every quota misses M by n / 2 at most, so party i can move by its quota * n / (2 * M),
   plus one.
3. Selection: a shard's documents stand in the order of a seeded hash. The shard's blocks are
   taken from that order, round after round; what a document gives is the overlap of its words
   with them, never above ``most`` times its size.

Everything is DataFrame operations. Windows run over sources, over the shards of one source
(``MAX_SHARDS`` at most) and over the documents of one shard, so a source that holds most rows
is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
BLOCK = 16
SHARD_WORDS = 25_000
MAX_SHARDS = 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words of a text: maximal runs without space and 0x09-0x0D (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def apportion(parties: DataFrame, group: list[str], name: str, votes: str, seats: str, total: str) -> DataFrame:
    """Sainte-Laguë: add ``seats`` per party so that each group's seats sum to its ``total`` column.

    ``parties`` is small (one row per party); the highest quotients win, ties go to the first name.
    A group without votes gets no seats.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sized = parties.withColumns({"_v": F.sum(votes).over(whole), "_n": F.count(F.lit(1)).over(whole)})
    quota = F.col(votes) * F.col(total) / F.col("_v")
    reach = F.ceil(F.col(votes) / F.col("_v") * F.col("_n")) + 2
    sized = sized.withColumn("_low", F.when(F.col("_v") > 0, F.greatest(F.lit(0), F.floor(quota) - reach)).otherwise(0))
    sized = sized.withColumn("_high", F.when(F.col("_v") > 0, F.floor(quota) + reach).otherwise(0))
    sized = sized.withColumn("_left", F.when(F.col("_v") > 0, F.col(total) - F.sum("_low").over(whole)).otherwise(0))
    listed = sized.withColumn("_seat", F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    order = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(
        F.desc(F.col(votes) / (2 * F.col("_seat") - 1)), F.col(name).asc_nulls_last(), "_seat"
    )
    won = listed.withColumn("_rank", F.row_number().over(order)).filter((F.col("_rank") <= F.col("_left")) & (F.col(votes) > 0))
    won = won.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(name).alias("_name")).agg(F.count(F.lit(1)).alias("_won"))
    same = F.col(name).eqNullSafe(F.col("_name"))
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = sized.join(won, same, "left").withColumn(seats, F.col("_low") + F.coalesce("_won", F.lit(0)))
    return joined.select(*parties.columns, F.col(seats).cast("bigint").alias(seats))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size) rows with their ``target``: min(most * size, level * weight)."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    df = df.withColumns({"_level": level, "_at": F.row_number().over(by_ratio)})
    first = F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.col("_at"))
    fits = F.min_by("_level", first).over(everything)
    return df.withColumn("target", F.least(F.col("cap"), F.coalesce(fits * F.col("weight"), F.col("cap")))).select(
        "source", "source_size", "weight", "target"
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    most: int = MOST,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """Per document: its size, its source's size and target, and ``taken``, the words the mix takes.

    The other columns but the text come along; sizes are counted in one pass over the texts and
    written to the shared folder, so the texts are read once and never shuffled. The rows per source
    and per shard are written too: each plan is small, however often the next one reads its rows.

    A null id hashes as the text 'null'; rows with equal ids stand next to each other in the
    order, smaller first. A null source is a source of its own. Empty texts have size 0 and give
    nothing; an empty table gives no row. Columns named like the results are replaced.
    """
    names = ["size", "source_size", "target", "taken"]
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).cast("binary"))
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*names, text_col.lower()}]).alias("_row")
    size = word_count(F.col(f"`{text_col}`")).alias("_size")
    rows = written(docs.select(kept, F.col(f"`{source_col}`").alias("_s"), size, digest.alias("_key")), "mix-sizes")
    sizes = rows.groupBy(F.col("_s").alias("source")).agg(F.sum("_size").alias("source_size"))
    sources = source_targets(sizes, weights, budget, most)
    sources = sources.withColumn("shards", F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_size") / shard_words) + 1).cast("bigint"))
    blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("bigint")
    sources = apportion(sources.withColumn("_blocks", blocks), [], "source", "target", "quota", "_blocks").drop("_blocks")
    sources = written(sources.withColumnRenamed("source", "_src"), "mix-sources")

    shard = F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") % F.col("shards")
    dealt = rows.join(sources, F.col("_s").eqNullSafe(F.col("_src"))).withColumn("_shard", shard)
    per_shard = dealt.groupBy("_src", "_shard", "quota").agg(F.sum("_size").alias("_words"))
    quotas = apportion(per_shard, ["_src"], "_shard", "_words", "_seats", "quota")
    quotas = written(quotas.select(F.col("_src").alias("_src2"), F.col("_shard").alias("_shard2"), "_words", "_seats"), "mix-quotas")
    placed = dealt.join(quotas, F.col("_src").eqNullSafe(F.col("_src2")) & (F.col("_shard") == F.col("_shard2")))

    run = Window.partitionBy("_src", "_shard").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_end", F.sum("_size").over(run))
    words = F.least(F.col("_seats") * block, most * F.col("_words"))
    rest = words % F.greatest(F.col("_words"), F.lit(1))
    rounds = F.floor(words / F.greatest(F.col("_words"), F.lit(1)))
    overlap = F.greatest(F.lit(0), F.least(F.col("_end"), rest) - (F.col("_end") - F.col("_size")))
    placed = placed.withColumn("taken", (rounds * F.col("_size") + overlap).cast("bigint")).withColumn("size", F.col("_size"))
    return placed.select("_row.*", *names)
