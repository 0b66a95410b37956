"""What the driver holds for the pipeline: tasks, plans and filters it ships stay few and small."""

from pyspark.sql import functions as F

from cutline.llm import frames, mixing, neardup, toxicity


def test_sample_is_read_by_few_tasks(spark, sf, monkeypatch):
    """Trees read the bounded sample again and again, however many partitions a keyed shuffle is given."""
    frame, sc = type(spark.range(0)), spark.sparkContext
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: plain(self, max(n, 100) if cols else n, *cols))
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    sc.setJobGroup("toxicity-fit", "tasks of a fit")
    try:
        model = toxicity.fit(docs, labels, F.lit(True))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert model.trees is not None
    tracker = sc.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("toxicity-fit") for s in tracker.getJobInfo(job).stageIds}
    assert sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info) < 2500


def test_plan_of_a_mix_is_small(spark, sf):
    """Sources and shards are rows of small tables, not plans that every use repeats."""
    mixed = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))
    assert mixed._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 2


def test_filter_is_as_large_as_its_ids(spark, monkeypatch):
    assert [frames.filter_words(n, 1 << 18) for n in (0, 4000, 8192, 1 << 30)] == [1024, 1024, 4096, 1 << 18]
    sizes = []
    plain = neardup.bit_filter
    monkeypatch.setattr(neardup, "bit_filter", lambda hashes, column, words: sizes.append(words) or plain(hashes, column, words))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, f"{text} x"), (3, "other words here now too")], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in neardup.link(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and sizes == [1024, 1024]
