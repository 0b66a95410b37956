"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.llm import negatives, queries

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, anchor):
    """All by the contract's words, in Python integers."""
    first = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        first[i] = min(first.get(i, (label, list(v))), (label, list(v)))
    whole = {i: (label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (label, v) in first.items()}
    out = set()
    for i, (label, v) in whole.items():
        if not anchor(i):
            continue
        others = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, own) for j, (own, w) in whole.items() if j != i and len(w) == len(v)))
        for high, j, own in [o for o in others if o[2] == label][:5]:
            inside = [(-s, k) for s, k, o in others if o != label and 50 * -high <= 100 * -s <= 95 * -high][:3]
            out |= {(i, j, rank, k, -high, s) for rank, (s, k) in enumerate(inside, 1)}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force_in_small_blocks(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(4)), np.round(rng.normal(0, 0.3, 6), 2).tolist()) for i in range(120)]
    rows += [(i, label, [0.0] * 6) for i, label in ((1000, 1), (1001, 2), (1002, 1), (1010, 3))]  # scores of zero
    rows += rows[:5] + [(3, 0, [0.5] * 6), (50, None, [0.1] * 6), (60, 1, None), (None, 1, [0.1] * 6), (70, 1, [None] * 6), (80, 2, [float("nan")] * 6)]
    rows += [(90, 1, [float("inf")] * 6), (500, 1, [0.3] * 3), (510, 2, [0.3] * 3), (520, 1, [0.4] * 3), (530, 1, []), (-10, 2, [0.2] * 6)]
    rows += [(2000 + k, 1 + k % 2, [1.0] * 6) for k in range(40)]  # equal vectors
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    clashing = df.withColumns({"id": F.lit(1), "score": F.lit("old"), "block": F.lit(2)})
    found = negatives.mine(clashing, F.col("vec_id") % 10 == 0, block_bytes=700, anchor_bytes=200)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert {tuple(r) for r in found.collect()} == brute(rows, lambda i: i % 10 == 0)


def test_large_components_and_wide_vectors(spark):
    rows = [(10, 1, [3e6] * 4000), (11, 1, [3e6] * 4000), (12, 2, [2e6] * 4000), (20, 1, [1e30, 1.0]), (21, 1, [1.0, 1.0])]
    found = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()
    assert [tuple(r) for r in found] == [(10, 11, 1, 12, (256 * 3 * 10**6) ** 2 * 4000 // 1, 256 * 3 * 10**6 * 256 * 2 * 10**6 * 4000)] or (256 * 3 * 10**6) ** 2 * 4000 >= 2**63


def test_no_rows_no_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(1, 1, [0.1])], SCHEMA)
    assert negatives.mine(one, F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(one, F.lit(True)).count() == 0


def test_query_equals_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in table]
    found = {tuple(r) for r in queries.QUERIES["op12_hard_negatives"](spark, sf).collect()}
    assert found == brute(rows, lambda i: i % 50 == 0)
