"""Connected components over edge tables that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import written


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for the ends of (a, b) edges: ``comp`` is the smallest id that can be reached.

    Each round takes the smallest label among neighbours and then the label of that label, so
    long chains shorten by half; labels are written to the shared folder after every round and
    the loop ends when none changes. Neighbours' labels are combined before they are shuffled.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        jumped = lower.join(labels.select(F.col("id").alias("comp"), F.col("comp").alias("far")), "comp")
        after = written(jumped.select("id", F.least("comp", "far").alias("comp"), "old"), "labels")
        labels = after.select("id", "comp")
        if not after.filter("comp != old").take(1):
            return labels
