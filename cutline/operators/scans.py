"""W5-W7, W9, W14 and the distributed ordered scans behind them.

A window over one key runs in one task, and one key may hold a third of all rows.
The scans here cut every key's axis into slices, run the window inside
(key, slice), fold one summary row per slice, and join the carry back. Results do
not depend on the slice width; it only bounds the rows of one window group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import let
from ..session import cut_lineage


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position in a total order, without a single-task window.

    Range-partitioned sort, row index inside each partition, plus the offsets of
    the partitions before it: one row per partition, so the offset table is bounded
    by the partition count and safe to broadcast. The sorted rows are checkpointed so
    that both readings see the same partitions, also after an executor is lost.
    """
    low_bits = 33
    indexed = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    sizes = indexed.groupBy(F.shiftright("_mid", low_bits).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    row = F.col("_mid").bitwiseAND((1 << low_bits) - 1)
    return (
        indexed.withColumn("_part", F.shiftright("_mid", low_bits))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (row + F.col("_off") + 1).cast("bigint"))
        .drop("_mid", "_part", "_off")
    )


def ranks_by_mode(df: DataFrame, keys: Sequence[str], modes: Mapping[str, Sequence[Column]], tail: Sequence[Column]) -> DataFrame:
    """T4: 1-based positions of every row in several orders, from one global sort.

    ``keys`` identify a row; ``modes`` give as many ascending sort keys of the same types each, and
    ``tail`` follows in all of them. Each row is sorted once per mode with its sort keys alone; no
    other column takes part. Every mode has the same number of rows, so positions are ranks less
    those of the modes before.
    """
    names = list(modes)
    per_mode = [F.struct(F.lit(i).alias("_mode"), *[k.alias(f"_s{j}") for j, k in enumerate(modes[m])]) for i, m in enumerate(names)]
    tails = [t.alias(f"_t{j}") for j, t in enumerate(tail)]
    rows = df.select(*keys, *tails, F.explode(F.array(*per_mode)).alias("_m")).select(*keys, *[f"_t{j}" for j in range(len(tails))], "_m.*")
    width = len(modes[names[0]])
    order = [F.col("_mode"), *[F.col(f"_s{j}") for j in range(width)], *[F.col(f"_t{j}") for j in range(len(tails))]]
    ranked = global_rank(rows, order, "_rank")
    n = ranked.filter("_mode = 0").count()
    places = [F.max(F.when(F.col("_mode") == i, F.col("_rank") - i * n)).alias(name) for i, name in enumerate(names)]
    return ranked.groupBy(*keys).agg(*places)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per key. Spark limits each key before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def _slice_offsets(counted: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Flag totals of all earlier slices of the same key, one row per (key, slice)."""
    totals = counted.groupBy(*keys, "_slice").agg(F.sum(flag).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "_slice", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_off"))


def _number_islands(flagged: DataFrame, keys: Sequence[str], order: str, flag: str, island: str) -> DataFrame:
    """Running flag count per key: inside the slice plus the slices before it."""
    w = Window.partitionBy(*keys, "_slice").orderBy(order)
    counted = flagged.withColumn("_run", F.sum(flag).over(w))
    return (
        counted.join(_slice_offsets(counted, keys, flag), [*keys, "_slice"])
        .withColumn(island, F.col("_run") + F.col("_off"))
        .drop("_run", "_off", "_slice", flag)
    )


def _sliced(df: DataFrame, axis: str, width: float) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(axis).cast("double") / F.lit(float(width))))


def gap_islands(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    tol: float,
    width: float | None = None,
    island: str = "island",
) -> DataFrame:
    """W5 numbering: 0-based island per key; a new one starts where the gap exceeds ``tol``.

    Works on the distinct (key, axis) values: equal values never split, so copies are
    counted first and ``n`` holds how many rows share the value.
    """
    width = width or max(tol, 1e-9) * 4096
    points = df.groupBy(*keys, axis).agg(F.count(F.lit(1)).alias("n"))
    value = F.col(axis).cast("double")
    sliced = _sliced(points, axis, width)
    w_local = Window.partitionBy(*keys, "_slice").orderBy(axis)
    broken = F.coalesce((value - F.lag(value).over(w_local) > tol).cast("int"), F.lit(0))
    inner = sliced.withColumn("_new", broken).withColumn("_run", F.sum("_new").over(w_local))
    # One row per slice: its ends and its inner breaks. The break between two slices is
    # found from their ends, so the points are read once for the rows and once for this.
    ends = inner.groupBy(*keys, "_slice").agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_new").alias("_s")
    )
    w_slice = Window.partitionBy(*keys).orderBy("_slice")
    edge = F.coalesce((F.col("_lo") - F.lag("_hi").over(w_slice) > tol).cast("int"), F.lit(0))
    carried = ends.withColumn("_edge", edge).select(
        *keys,
        "_slice",
        (F.sum(F.col("_edge") + F.col("_s")).over(w_slice.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_off"),
    )
    return (
        inner.join(carried, [*keys, "_slice"])
        .withColumn(island, F.col("_run") + F.col("_off"))
        .drop("_run", "_off", "_new", "_slice")
    )


def gap_clusters(df: DataFrame, keys: Sequence[str], axis: str, tol: float, width: float | None = None) -> DataFrame:
    """One row per cluster with its bounds, size and mean."""
    islands = gap_islands(df, keys, axis, tol, width)
    value = F.col(axis).cast("double")
    return islands.groupBy(*keys, "island").agg(
        F.min(axis).alias("start"),
        F.max(axis).alias("end"),
        F.sum("n").alias("n"),
        (F.sum(value * F.col("n")) / F.sum("n")).alias("mean"),
    )


def coalesce_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    slack: float,
    width: float,
    weight: str | None = None,
) -> DataFrame:
    """Merge intervals whose start is at most ``slack`` past the furthest end so far.

    ``n`` is the number of intervals, or the sum of their ``weight``.
    """
    count = F.sum(weight) if weight else F.count(F.lit(1))
    spans = df.groupBy(*keys, start).agg(F.max(end).alias(end), count.alias("n"))
    before = Window.partitionBy(*keys, "_slice").orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    sliced = _sliced(spans, start, width)
    inner = sliced.withColumn("_reach", F.max(end).over(before))
    folded = inner.groupBy(*keys, "_slice").agg(F.max(end).alias("_max"))
    w_slice = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = folded.select(*keys, "_slice", F.max("_max").over(w_slice).alias("_before"))
    reach = F.greatest("_reach", "_before")
    flagged = inner.join(carried, [*keys, "_slice"]).withColumn(
        "_new", F.coalesce((F.col(start) > reach + F.lit(slack)).cast("int"), F.lit(0))
    )
    # Numbering reads the flags twice; written once, the spans are not shuffled again.
    flagged = cut_lineage(flagged.drop("_reach", "_before"))
    numbered = _number_islands(flagged, keys, start, "_new", "island")
    return numbered.groupBy(*keys, "island").agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.sum("n").alias("n")
    )


def run_islands(
    df: DataFrame, keys: Sequence[str], pos: str, breaks: Column, width: int = 65536
) -> DataFrame:
    """Running count of ``breaks`` up to and with each row, per key in ``pos`` order."""
    flagged = df.withColumn("_brk", F.coalesce(breaks.cast("int"), F.lit(0)))
    return _number_islands(_sliced(flagged, pos, width), keys, pos, "_brk", "island")


def fragment_runs(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    is_fragment: Column,
    max_run: int = 6,
    min_run: int = 2,
) -> DataFrame:
    """Join runs of fragments; a run ends at a non-fragment or after ``max_run`` pieces.

    Returns one row per joined run: keys, first position, pieces, text. Runs shorter
    than ``min_run`` give no row. Each output group holds at most ``max_run`` pieces.
    Positions may have gaps: pieces are counted by their rank, a running count in slices.
    """
    ranked = run_islands(df.withColumn("_frag", is_fragment), keys, pos, F.lit(True)).withColumnRenamed("island", "_rank")
    islands = run_islands(ranked, keys, "_rank", ~F.col("_frag"))
    frags = islands.filter("_frag")
    # Ranks are consecutive inside a run, because any other row starts a new island.
    firsts = frags.groupBy(*keys, "island").agg(F.min("_rank").alias("_first"))
    placed = frags.join(firsts, [*keys, "island"]).withColumn(
        "_chunk", F.floor((F.col("_rank") - F.col("_first")) / F.lit(max_run))
    )
    return (
        placed.groupBy(*keys, "island", "_chunk")
        .agg(
            F.min(pos).alias("first_pos"),
            F.count(F.lit(1)).alias("pieces"),
            F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))).alias("_parts"),
        )
        .filter(F.col("pieces") >= min_run)
        .select(*keys, "first_pos", "pieces", F.array_join(F.transform("_parts", lambda x: x["v"]), "").alias("joined"))
    )


def section_cut(
    df: DataFrame, keys: Sequence[str], pos: str, hit: Column, stop: Column
) -> DataFrame:
    """Per key, drop the rows from the first ``stop`` row that comes after a ``hit`` row.

    Two aggregates with map-side combine give the first hit and the first stop after
    it; no window, so a key of any size is spread over tasks.
    """
    flagged = df.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_stop", F.coalesce(stop, F.lit(False)))
    first_hit = flagged.filter("_hit").groupBy(*keys).agg(F.min(pos).alias("_hit_pos"))
    cut = (
        flagged.filter("_stop")
        .join(first_hit, list(keys))
        .filter(F.col(pos) > F.col("_hit_pos"))
        .groupBy(*keys)
        .agg(F.min(pos).alias("_cut_pos"))
    )
    return (
        flagged.join(cut, list(keys), "left")
        .filter(F.col("_cut_pos").isNull() | (F.col(pos) < F.col("_cut_pos")))
        .drop("_hit", "_stop", "_cut_pos")
    )


def cut_lines(lines: Column, hit, stop) -> Column:
    """W14 inside one cell: the lines before the first ``stop`` line that follows a ``hit`` line.

    Lines of one document already sit in one row, so no rows are exploded or shuffled.
    """
    def cut(ls: Column) -> Column:
        first_hit = F.array_min(F.transform(ls, lambda x, i: F.when(hit(x), i)))
        return let(first_hit, lambda h: after(ls, h))

    def after(ls: Column, h: Column) -> Column:
        stops = F.transform(ls, lambda x, i: F.when((i > h) & stop(x), i))
        return F.slice(ls, F.lit(1), F.coalesce(F.array_min(stops), F.size(ls)))

    return let(lines, cut)
