"""Word boxes on pages, joined by vertical bands."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import no_space, parens, strip, text
from ..functions.values import value_token
from .scans import gap_clusters


def box_edges(df: DataFrame) -> DataFrame:
    """Corner and centre coordinates of boxes given as x, y, w, h."""
    return df.select(
        "*",
        F.col("x").alias("x0"),
        F.col("y").alias("y0"),
        (F.col("x") + F.col("w")).alias("x1"),
        (F.col("y") + F.col("h")).alias("y1"),
        (F.col("x") + F.col("w") / 2).alias("xc"),
        (F.col("y") + F.col("h") / 2).alias("yc"),
    )


def band_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_y: str, right_y: str, below: float, above: float | None = None
) -> DataFrame:
    """Pairs with left_y - below <= right_y <= left_y + above, as a bucketed equi-join.

    A right row falls into one bucket, a left row reaches the buckets its band
    touches, so no pair is found twice. The bucket is part of the key, which also
    spreads a page that holds many rows.
    """
    above = below if above is None else above
    size = F.lit(float(below + above) or 1.0)
    lo, hi = F.col(left_y) - F.lit(below), F.col(left_y) + F.lit(above)
    reach = left.withColumn("_b", F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))))
    placed = right.withColumn("_b", F.floor(F.col(right_y) / size))
    return (
        reach.join(placed, [*keys, "_b"])
        .filter(F.col(right_y).between(F.col(left_y) - F.lit(below), F.col(left_y) + F.lit(above)))
        .drop("_b")
    )


def column_index(x: Column, bounds: Column) -> Column:
    """0-based half-open interval of an ascending bound list; null outside."""
    n = F.size(F.filter(bounds, lambda b: b <= x))
    return F.when((n >= 1) & (n < F.size(bounds)), n - 1)


def band_counts(
    anchors: DataFrame,
    words: DataFrame,
    keys: Sequence[str],
    anchor_y: str,
    word_y: str,
    word_x: str,
    tol: float,
    bounds: Sequence[float],
) -> DataFrame:
    """J13 counted per (anchor line, column), without making a pair.

    The axis is cut into slices as wide as a band. A band then is the end of one slice and the
    beginning of the next, so each anchor line reads two running values: the words of its first
    slice from its lower end on, and those of the second up to its upper end. Copies are folded
    first, words to one row per (line, column). Rows whose key or place is null meet nothing.
    """
    placed = [F.col(k).isNotNull() for k in keys]
    lines = anchors.select(*keys, F.col(anchor_y).alias("_line")).filter(reduce(lambda x, y: x & y, placed, F.col("_line").isNotNull())).distinct()
    idx = column_index(F.col(word_x), F.array(*[F.lit(float(b)) for b in bounds]))
    cells = (
        words.withColumn("col", idx)
        .filter(reduce(lambda x, y: x & y, placed, F.col("col").isNotNull() & F.col(word_y).isNotNull()))
        .groupBy(*keys, F.col(word_y).cast("double").alias("_y"), "col")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(word_x).alias("_x"))
    )
    if tol <= 0:
        exact = lines.join(cells.withColumnRenamed("_y", "_line"), [*keys, "_line"])
        return exact.select(*keys, F.col("_line").alias(anchor_y), "col", F.col("_n").alias("n_words"), F.col("_x").alias("first_x"))
    size, middle = F.lit(2.0 * tol), F.col("_line").cast("double")
    first = F.floor((middle - tol) / size)
    columns = F.sequence(F.lit(0), F.lit(len(bounds) - 2))
    ends = F.array(
        F.struct(F.lit(True).alias("_from"), (middle - tol).alias("_y"), first.alias("_slice")),
        F.struct(F.lit(False).alias("_from"), (middle + tol).alias("_y"), (first + 1).alias("_slice")),
    )
    asked = lines.withColumn("col", F.explode(columns)).select(*keys, "_line", "col", F.explode(ends).alias("_e")).select(*keys, "_line", "col", "_e.*")
    rows = asked.unionByName(cells.withColumn("_slice", F.floor(F.col("_y") / size)), allowMissingColumns=True)
    group = Window.partitionBy(*keys, "col", "_slice")
    up, down = group.orderBy("_y"), group.orderBy(F.desc("_y"))  # running values; rows of one place count together
    running = rows.select(
        *keys, "_line", "col", "_from",
        F.sum("_n").over(up).alias("_n_up"), F.min("_x").over(up).alias("_x_up"),
        F.sum("_n").over(down).alias("_n_down"), F.min("_x").over(down).alias("_x_down"),
    ).filter("_line is not null")
    part = running.select(
        *keys, F.col("_line").alias(anchor_y), "col",
        F.when(F.col("_from"), F.col("_n_down")).otherwise(F.col("_n_up")).alias("_n"),
        F.when(F.col("_from"), F.col("_x_down")).otherwise(F.col("_x_up")).alias("_x"),
    ).filter("_n is not null")
    return part.groupBy(*keys, anchor_y, "col").agg(F.sum("_n").alias("n_words"), F.min("_x").alias("first_x"))


def dedupe_anchors(words: DataFrame, keys: Sequence[str], code: str, tol: float = 3.0) -> DataFrame:
    """One anchor per code and page: top-most, then left-most within ``tol`` (chained).

    Boxes on the same line are folded to the left-most one first, so the ordered fold
    reads at most one entry per line of a page.
    """
    lines = words.groupBy(*keys, code, "y0").agg(F.min_by(F.struct("x0", "yc"), "x0").alias("_w"))
    entry = F.struct(F.col("y0").alias("y0"), F.col("_w.x0").alias("x0"), F.col("_w.yc").alias("yc"))
    items = F.sort_array(F.collect_list(entry))

    def step(cur: Column, w: Column) -> Column:
        closer = (F.abs(w["y0"] - cur["y0"]) <= tol) & (w["x0"] < cur["x0"])
        return F.when(closer, w).otherwise(cur)

    return (
        lines.groupBy(*keys, code)
        .agg(items.alias("_i"))
        .withColumn("_a", F.aggregate("_i", F.get("_i", F.lit(0)), step))
        .select(*keys, code, "_a.y0", "_a.x0", "_a.yc")
    )


def cell_parse(raw: Column | str) -> Column:
    """struct(raw, expr, min_score) of a cell text, null when it holds no rule (Q13)."""
    r = F.replace(strip(no_space(text(raw))), F.lit("—"), F.lit("-"))
    numbers = F.regexp_extract_all(r, F.lit(r"(\d{1,3})"), F.lit(1))
    # Number runs are read left to right in threes; what follows the last one has no digit.
    last = F.get(numbers, F.size(numbers) - 1)
    tail = F.length(F.regexp_extract(r, r"(\D*)$", 1))
    head = r.substr(F.lit(1), F.length(r) - tail - F.length(last))
    fifteen = r.endswith("巧") | r.endswith("用")
    expr = F.when(F.size(numbers) > 0, head).when(fifteen, r.substr(F.lit(1), F.length(r) - 1))
    score = F.when(F.size(numbers) > 0, last.cast("int")).when(fifteen, F.lit(15))
    expr = parens(strip(expr))
    keep = ~r.isin("", "-", "--", "*") & (expr != "")
    return F.when(keep, F.struct(r.alias("raw"), expr.alias("expr"), score.alias("min_score")))


def sieve_rows(words: DataFrame, columns: DataFrame, keys: Sequence[str] = ("doc", "page"), row_tol: float = 14.0, every_anchor: bool = False) -> DataFrame:
    """Per programme code the ordered screening minima and the oversubscribe flag.

    ``columns`` has one row per page key with ``bounds``: eight ascending positions. Of a code that stands on a page
    several times the top-most place counts (W4), with ``every_anchor`` the words near each of its places.
    """
    keys = list(keys)
    boxes = box_edges(words).join(columns, keys)
    codes = boxes.filter(
        strip("text").rlike(r"^\d{6}$") & (F.col("x0") < F.get("bounds", F.lit(0)))
    ).withColumn("apply_code", strip("text"))
    anchors = codes if every_anchor else dedupe_anchors(codes, keys, "apply_code")
    anchors = anchors.select(*keys, "apply_code", F.col("yc").alias("anchor_y"))
    cells = boxes.withColumn("col", column_index(F.col("xc"), F.col("bounds"))).select(
        *keys, "col", "x0", "y0", F.col("yc").alias("word_y"), "text"
    )
    pairs = band_join(anchors, cells, keys, "anchor_y", "word_y", row_tol).filter("col is not null")
    joined = (
        pairs.groupBy(*keys, "apply_code", "col")
        .agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "text"))).alias("_w"))
        .withColumn("cell", F.array_join(F.transform("_w", lambda w: w["text"]), ""))
    )
    parsed = joined.withColumn("p", F.when(F.col("col") < 6, cell_parse("cell")))
    order = F.struct(
        (F.col("col") + 1).cast("int").alias("order"),
        F.col("p.expr").alias("expr"),
        F.col("p.min_score").alias("min_score"),
        F.col("p.raw").alias("raw"),
    )
    return parsed.groupBy(*keys, "apply_code").agg(
        F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), order))).alias("min_orders"),
        F.coalesce(F.max((F.col("col") == 6) & F.col("cell").contains("*")), F.lit(False)).alias("oversubscribe"),
    )


def history_entries(words: DataFrame, keys: Sequence[str] = ("doc", "page")) -> DataFrame:
    """Cutoff vectors of a history page: code, label lines near it, first value of each line.

    Fixed values of the page layout: codes left of 160, labels at 560-670, first round
    at 690-760, second round at 770-820, bands of 40 and 2.0, line tolerance 1.2.
    """
    keys = list(keys)
    codes = words.filter(strip("text").rlike(r"^\d{5}$") & (F.col("x0") < 160)).select(
        *keys, strip("text").alias("program_code"), F.col("y0").alias("code_y"), F.col("x0").alias("code_x")
    )
    labels = words.filter(F.col("x0").between(560, 670)).select(*keys, F.col("y0").alias("label_y"))
    near = band_join(codes, labels, keys, "code_y", "label_y", 40.0)
    anchor = [*keys, "program_code", "code_y", "code_x"]
    lines = gap_clusters(near, anchor, "label_y", 1.2).select(*anchor, F.col("mean").alias("line_y"))

    def first_value(lo: float, hi: float, name: str) -> DataFrame:
        values = words.filter(F.col("x0").between(lo, hi)).select(
            *keys, F.col("y0").alias("value_y"), F.col("x0").alias("value_x"), "text"
        )
        hit = band_join(lines, values, keys, "line_y", "value_y", 2.0)
        return hit.groupBy(*anchor, "line_y").agg(F.min_by("text", "value_x").alias(name))

    full = lines.join(first_value(690, 760, "t1"), [*anchor, "line_y"], "left").join(
        first_value(770, 820, "t2"), [*anchor, "line_y"], "left"
    )
    items = F.sort_array(F.collect_list(F.struct("line_y", value_token("t1").alias("v1"), value_token("t2").alias("v2"))))
    return (
        full.groupBy(*anchor)
        .agg(items.alias("_i"))
        .select(
            *keys,
            "program_code",
            F.col("program_code").substr(1, 3).alias("school_code"),
            F.col("code_y").alias("pos"),
            F.transform("_i", lambda x: x["v1"]).alias("round1"),
            F.transform("_i", lambda x: x["v2"]).alias("round2"),
        )
    )


