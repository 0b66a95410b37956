"""Event-time clusters in append mode: closed ones leave the state, late rows get a table of their own.

The watermark of a batch is the greatest event time of the batches before it, less ``delay``. A row
older than that is late: it is written to ``late`` and changes no cluster. All other rows join the
open clusters of their key. A cluster whose end lies more than the gap before the next watermark
can get no further row; it is written to ``closed`` once and leaves the state, so the state holds
the clusters of the last ``delay`` + gap only, however long the stream runs.

Every batch writes its own folders in ``closed``, ``late``, ``open`` and ``mark``, and starts from the
newest ones before its number, so a replayed batch writes the same again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import coalesce_intervals
from ..session import cut_lineage
from .versions import VersionedState


class EventTimeClusters:
    """Clusters of rows whose event times are at most ``gap_us`` apart, per key.

    ``ts`` is a timestamp column of the rows; rows without an event time are late. ``slice_us`` is the
    width of the slices in which a key's axis is scanned, so that no key is one task.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], ts: str, gap_us: int, delay_us: int, slice_us: int = 86_400_000_000):
        self.spark, self.path, self.keys, self.ts = spark, path, list(keys), ts
        self.gap_us, self.delay_us, self.slice_us = gap_us, delay_us, slice_us
        self.open, self.mark = VersionedState(spark, f"{path}/open"), VersionedState(spark, f"{path}/mark")
        self.closed, self.late = VersionedState(spark, f"{path}/closed"), VersionedState(spark, f"{path}/late")

    def watermark(self, below: int | None = None) -> int | None:
        """Microseconds since 1970; None before the first batch with an event time."""
        newest = self.mark.latest(below)
        return newest.first()["us"] if newest is not None else None

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch."""
        before = self.watermark(batch_id)
        us = F.unix_micros(F.col(self.ts).cast("timestamp"))
        on_time = us.isNotNull() if before is None else F.coalesce(us >= before, F.lit(False))
        self.late.write(batch.filter(~on_time), batch_id)
        newest = batch.agg(F.max(us).alias("us")).first()["us"]
        marks = [m for m in (before, None if newest is None else newest - self.delay_us) if m is not None]
        after = max(marks) if marks else None

        key = F.struct(*self.keys).alias("_key")  # never null itself, so null keys are a key of their own
        points = batch.filter(on_time).select(key, us.alias("start"), us.alias("end"), F.lit(1).cast("bigint").alias("n"))
        known = self.open.latest(batch_id)
        spans = points if known is None else known.select(key, "start", "end", "n").unionByName(points)
        merged = coalesce_intervals(spans, ["_key"], "start", "end", self.gap_us, self.slice_us, weight="n")
        clusters = cut_lineage(merged.select("_key.*", "start", "end", "n"))
        done = F.lit(False) if after is None else F.col("end") + self.gap_us < after
        self.closed.write(clusters.filter(done), batch_id)
        self.open.write(clusters.filter(~done), batch_id)
        self.mark.write(self.spark.createDataFrame([(after,)], "us bigint").coalesce(1), batch_id)
        self.open.keep_newest(2, batch_id)
        self.mark.keep_newest(2, batch_id)

    def start(self, stream: DataFrame, checkpoint: str):
        """Run a stream through ``add`` until its input is used up."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
