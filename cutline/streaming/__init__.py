"""ST1-ST3: incremental forms of keep-best, status counts and gap clusters."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import gap_clusters
from ..session import shared_dir
from .event_time import EventTimeClusters
from .state import SortedRuns
from .versions import VersionedState

__all__ = ["EventTimeClusters", "SortedRuns", "VersionedState", "keep_best_stream", "read_stream", "sessions", "status_counts", "stream_dir"]


def stream_dir(spark: SparkSession, name: str) -> str:
    """Checkpoint folder of a stream, inside the shared folder."""
    return os.path.join(shared_dir(spark), "streams", name)


def read_stream(spark: SparkSession, path: str, schema, pattern: str | None = None, max_files: int = 1000) -> DataFrame:
    """Files of a folder as a stream; a backlog is cut into batches of ``max_files`` files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def keep_best_stream(stream: DataFrame, state: SortedRuns, checkpoint: str):
    """ST1: best record per key over everything seen; arrival order does not matter.

    Each micro-batch appends its own best rows to ``state`` (see ``SortedRuns``), so it costs what
    the batch costs, not what the store has grown to.
    """
    return stream.writeStream.foreachBatch(state.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(stream: DataFrame, status: str) -> DataFrame:
    """ST2: running counts per state (update or complete mode)."""
    return stream.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, watermark: str | None = None) -> DataFrame:
    """ST3: gap clusters on event time; events exactly one gap apart stay together.

    A stream uses session windows with a watermark; set
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` to merge a
    hot key's sessions before its shuffle. A batch uses the sliced gap clusters, so a
    key that holds most of the rows is still spread over tasks.
    """
    if events.isStreaming:
        gap = f"{gap_seconds} seconds"
        w = F.session_window(ts, gap)
        marked = events.withWatermark(ts, watermark or gap)
        return marked.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(
            *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
        )
    micros = 1_000_000
    points = events.select(*keys, F.unix_micros(ts).alias("_us"))
    found = gap_clusters(points, keys, "_us", gap_seconds * micros, width=86_400 * micros)
    return found.select(
        *keys,
        F.timestamp_micros("start").alias("start"),
        F.timestamp_micros(F.col("end") + gap_seconds * micros).alias("end"),
        "n",
    )
