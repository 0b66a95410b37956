"""Streaming forms over the event files, drained with ``availableNow``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming import EventTimeClusters, SortedRuns, VersionedState, keep_best_stream, read_stream, sessions, status_counts, stream_dir
from . import query
from .lookups import KEEP_BEST_SQL, event_order, event_records_of


GAP_US = 90 * 60 * 1_000_000
DELAY_US = 3 * 3600 * 1_000_000
STEPS = 6
"""Parts of the time axis that reach the session stream one after another."""


def _events(spark: SparkSession, sf_dir: str, folder: str, batches: int = 3) -> DataFrame:
    """The events as a stream of several files, one per micro-batch."""
    events = table(spark, sf_dir, "events")
    events.repartition(batches, "event_id").write.parquet(f"{folder}/input")
    return read_stream(spark, f"{folder}/input", events.schema, max_files=1)


def _drain(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run the stream to its end into parquet versions and return the last one (no input: no row)."""
    spark = df.sparkSession
    state = VersionedState(spark, f"{folder}/out")
    q = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(lambda batch, i: state.write(batch, i))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    latest = state.latest()
    return spark.createDataFrame([], df.schema) if latest is None else latest


def _folder(spark: SparkSession, name: str) -> str:
    return stream_dir(spark, f"{name}-{uuid.uuid4().hex}")


@query("stream_status", "select event_type, count(*) as n from events group by 1")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2."""
    folder = _folder(spark, "status")
    return _drain(status_counts(_events(spark, sf_dir, folder), "event_type"), "complete", folder)


@query("stream_keep_best", KEEP_BEST_SQL)
def stream_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: ten batches of sorted runs, the last of them replayed, equal the batch result."""
    folder = _folder(spark, "best")
    events = event_records_of(_events(spark, sf_dir, folder, batches=10))
    state = SortedRuns(spark, f"{folder}/state", ["user_id"], event_order(), least_bytes=4096)
    keep_best_stream(events, state, f"{folder}/checkpoint").awaitTermination()
    _forget_last_commit(spark, f"{folder}/checkpoint")
    keep_best_stream(events, state, f"{folder}/checkpoint").awaitTermination()
    best = state.read()
    best = spark.createDataFrame([], events.schema) if best is None else best
    return best.select("user_id", "event_id", "status")


def _forget_last_commit(spark: SparkSession, checkpoint: str) -> None:
    """As if the driver had died before it noted the last batch: the next start replays it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [p for p in names if p.getName().isdigit()]
    if done:
        fs.delete(max(done, key=lambda p: int(p.getName())), False)


SESSIONS_SQL = """
with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) > interval 90 minutes then 1 else 0 end as brk from events),
i as (select *, sum(brk) over (partition by user_id order by ts, event_id) as isl from g)
select user_id, cast(floor(epoch(min(ts))) as bigint) as start_s, count(*) as n from i group by user_id, isl
"""


@query(
    "stream_sessions",
    f"""
with b as (select min(epoch_us(ts)) as lo, (max(epoch_us(ts)) - min(epoch_us(ts))) // {STEPS} + 1 as width from events),
e as (select user_id, event_id, epoch_us(ts) as us,
        least({STEPS - 1}, (epoch_us(ts) - lo) // width + case when event_id % 97 = 5 then 2 else 0 end) as step from events, b),
m as (select s.step, (select max(us) from e where e.step < s.step) - {DELAY_US} as mark from (select unnest(range(0, {STEPS + 1})) as step) s),
t as (select e.*, coalesce(us < mark, false) as late from e join m using (step)),
g as (select *, case when us - lag(us) over (partition by user_id order by us) > {GAP_US} then 1 else 0 end as brk from t where not late),
i as (select *, sum(brk) over (partition by user_id order by us, event_id) as isl from g),
c as (select user_id, min(us) as lo, max(us) as hi, count(*) as n from i group by user_id, isl)
select case when hi + {GAP_US} < (select mark from m where step = {STEPS}) then 'closed' else 'open' end as kind,
  user_id, lo // 1000000 as start_s, n from c
union all select 'late', user_id, us // 1000000, 1 from t where late
""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: sessions of a stream in order of time but for known rows that come two steps late."""
    folder = _folder(spark, "sessions")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    us = F.unix_micros("ts")
    ends = events.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    late_by = F.when(F.col("event_id") % 97 == 5, 2).otherwise(0)
    if ends["lo"] is None:
        stepped = events.withColumn("step", F.lit(0))
    else:
        width = (ends["hi"] - ends["lo"]) // STEPS + 1
        stepped = events.withColumn("step", F.least(F.lit(STEPS - 1), F.floor((us - ends["lo"]) / width) + late_by))
    clusters = EventTimeClusters(spark, f"{folder}/state", ["user_id"], "ts", GAP_US, DELAY_US)
    for step in range(STEPS):
        stepped.filter(F.col("step") == step).drop("step").write.mode("append").parquet(f"{folder}/input")
        clusters.start(read_stream(spark, f"{folder}/input", events.schema), f"{folder}/checkpoint").awaitTermination()
    closed, still_open, late = clusters.closed.all(), clusters.open.latest(), clusters.late.all()
    parts = [part.select(F.lit(kind).alias("kind"), "user_id", F.timestamp_micros("start").alias("start"), "n") for kind, part in (("closed", closed), ("open", still_open))]
    parts.append(late.select(F.lit("late").alias("kind"), "user_id", F.col("ts").alias("start"), F.lit(1).cast("bigint").alias("n")))
    return _session_rows(parts[0].unionByName(parts[1]).unionByName(parts[2]), "kind")


@query("session_clusters", SESSIONS_SQL)
def session_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3 in batch form: sessions from sliced gap clusters."""
    ev = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _session_rows(sessions(ev, ["user_id"], "ts", 90 * 60))


def _session_rows(out: DataFrame, *more: str) -> DataFrame:
    shift = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(start as timestamp_ntz))")
    return out.select(*more, "user_id", shift.alias("start_s"), "n")

