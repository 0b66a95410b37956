"""Readers, writers and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cutline.operators import dedupe, lookup, records
from cutline.plans.texts import latin_majors
from cutline.session import shared_dir
from cutline.sources import readers, writers
from cutline.streaming import EventTimeClusters, SortedRuns, keep_best_stream, read_stream, sessions, status_counts


def dump(path, doc):
    path.write_text(json.dumps(doc, ensure_ascii=False, indent=1), encoding="utf-8")
    return str(path)


def test_regions_and_institutions(spark, tmp_path):
    doc = {"data": [{"areaName": "北京", "schools": [{"id": 1, "code": "01", "name": "甲", "yxtx": "理工", "zsjz": "u"}, {"id": 2, "name": "乙"}]}, {"schools": []}]}
    rows = sorted(tuple(r) for r in readers.read_regions(spark, dump(tmp_path / "r.json", doc)).collect())
    assert rows == [("1", "01", "甲", "理工", "北京", "u"), ("2", None, "乙", "", "北京", None)]
    arr = dump(tmp_path / "s.json", [{"id": 7, "name": "甲"}, {"id": " ", "name": "乙"}])
    assert [r["id"] for r in readers.read_institutions(spark, arr).collect()] == ["7"]


def test_result_store_round_trip(spark, tmp_path):
    store = {"last_updated": "x", "schools": {"5": {"school_name": "甲", "status": "success", "raw_text_length": 3, "extraction": {"found": True, "majors": ["法学"]}}}}
    df = readers.read_results(spark, dump(tmp_path / "results.json", store))
    row = df.first()
    assert (row["school_id"], row["extraction"]["majors"]) == ("5", ["法学"])
    writers.write_store(df, str(tmp_path / "v1"))
    again = spark.read.parquet(str(tmp_path / "v1")).first()
    assert again["last_updated"] is not None and again["school_name"] == "甲"
    with pytest.raises(Exception):
        writers.write_store(df, str(tmp_path / "v1"))


def test_program_store_and_documents(spark, tmp_path):
    store = {"programs": {"00101": {"school_code": "001", "apply_code": "001012", "star_current": {"requirements": {"國文": "均標"}}, "star_history": {"113": {"page": 2, "kind": "eight"}}}}}
    programs = readers.read_programs(spark, dump(tmp_path / "p.json", store))
    assert programs.first()["star_current"]["requirements"] == {"國文": "均標"}
    long = readers.history_long(programs, "star_history").collect()
    assert [(r["program_code"], r["year"], r["kind"]) for r in long] == [("00101", 113, "eight")]
    base = programs.select("program_code", "apply_code")
    star = spark.createDataFrame([("00101", 113, 4.0), ("00101", 112, 5.0)], "program_code string, year int, cutoff double")
    app = spark.createDataFrame([("001012", 113, "國12")], "apply_code string, year int, dist string")
    doc = json.loads(writers.program_documents(base, star, app).first()["document"])
    assert doc["star_history"] == {"112": {"cutoff": 5.0}, "113": {"cutoff": 4.0}}
    assert doc["apply_history"] == {"113": {"dist": "國12"}}


def test_fragments_are_partitioned_and_replaced(spark, tmp_path):
    root = str(tmp_path / "cache")
    rows = spark.createDataFrame([(112, "001", "a"), (113, "002", "b")], "year int, school_code string, v string")
    writers.write_fragments(rows, root)
    writers.write_fragments(spark.createDataFrame([(113, "002", "c")], "year int, school_code string, v string"), root)
    got = readers.read_fragments(spark, root, "v string").collect()
    assert sorted(r["v"] for r in got) == ["a", "c"] and all("year=" in r["fragment"] for r in got)


def text_of(folder):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("part-*")))


def test_csv_forms(spark, tmp_path):
    df = spark.createDataFrame([("甲", 'a "q", b', None)], "name string, note string, x string").coalesce(1)
    writers.write_csv(df, str(tmp_path / "c1"), ["name", "note"])
    assert text_of(tmp_path / "c1").startswith("﻿name,note\n")
    writers.write_csv(df, str(tmp_path / "c2"), ["note", "name"], quote_all=True, bom=False)
    assert text_of(tmp_path / "c2") == '"note","name"\n"a ""q"", b","甲"\n'
    writers.write_names(df.union(df), "name", str(tmp_path / "n"))
    assert text_of(tmp_path / "n") == "甲\n"


def test_retry_summary(spark):
    cols = "school_id string, school_name string, source_url string, raw_text_length int, status string, low_quality_host string"
    rows = [("1", "a", "u", 5, "not_found", "yes"), ("2", "b", "v", 9, "not_found", "no"), ("3", "c", "w", 1, "failed", "no")]
    unresolved = spark.createDataFrame(rows, cols)
    results = unresolved.select("status").union(spark.createDataFrame([("success",)], ["status"]))
    doc = json.loads(writers.retry_summary(unresolved, results).first()["value"])
    assert doc["status"] == {"success": 1, "not_found": 2, "failed": 1}
    assert [s["name"] for s in doc["not_found_samples"]] == ["b", "a"] and doc["low_quality_not_found_count"] == 1
    empty = json.loads(writers.retry_summary(unresolved.filter("false"), results).first()["value"])
    assert empty["not_found_samples"] == []
    one = json.loads(writers.report_row(results, n=F.count(F.lit(1))).first()["value"])
    assert one == {"n": 4}


def test_history_payload(spark, tmp_path):
    rows = spark.createDataFrame([(112, "00101")], "year int, program_code string")
    summary = spark.createDataFrame([(112, "success")], "year int, status string")
    writers.write_history(rows, summary, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h" / "rows")).count() == 1


def test_canonical_json_has_fixed_order(spark):
    a = spark.range(1).select(records.canonical_json(F.struct(F.lit(1).alias("x"), F.lit("y").alias("y"))).alias("j"))
    assert a.first()["j"] == '{"x":1,"y":"y"}'


def test_overlay_keeps_both_sides(spark):
    old = spark.createDataFrame([("a", 112, 1), ("a", 113, 2)], "k string, year int, v int")
    new = spark.createDataFrame([("a", 113, None), ("b", 112, 4)], "k string, year int, v int")
    got = sorted(tuple(r) for r in lookup.overlay_years(old, new, ["k", "year"], ["v"]).collect())
    assert got == [("a", 112, 1), ("a", 113, None), ("b", 112, 4)]


# ---- streams ---------------------------------------------------------------------------


def versions(n=300):
    rnd = random.Random(11)
    return [(rnd.choice([0, 0, 1, 2, 3]), i, rnd.randint(0, 20)) for i in range(n)]


def test_keep_best_stream_over_batches_equals_one_batch(spark, tmp_path):
    rows = versions()
    schema = "k int, i int, q int"
    for b in range(3):
        spark.createDataFrame(rows[b::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    order = [F.col("q").desc(), F.col("i").asc()]
    state = SortedRuns(spark, str(tmp_path / "state"), ["k"], order)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keep_best_stream(source, state, str(tmp_path / "cp")).awaitTermination()
    want = sorted(map(tuple, dedupe.keep_best(spark.createDataFrame(rows, schema), ["k"], order).collect()))
    assert sorted(map(tuple, state.read().collect())) == want
    # A replayed batch writes its own run anew; rows that came before are not applied twice.
    state.append(spark.createDataFrame(rows[2::3], schema), 2)
    assert sorted(map(tuple, state.read().collect())) == want
    assert sorted(map(tuple, state.lookup(spark.createDataFrame([(0,), (3,), (99,)], "k int")).collect())) == [w for w in want if w[0] in (0, 3)]


def test_status_counts_stream(spark, sf, tmp_path):
    events = read_stream(spark, sf, spark.read.parquet(f"{sf}/events.parquet").schema, "events.parquet")
    q = (
        status_counts(events, "event_type").writeStream.outputMode("complete").format("memory").queryName("counts")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_session_stream_matches_batch(spark, tmp_path):
    rows = [(1, t) for t in (0, 50, 110, 300, 1000)] + [(2, 0), (9, 90000)]
    df = spark.createDataFrame(rows, "k int, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = (
        sessions(source, ["k"], "ts", 60).writeStream.outputMode("append").format("memory").queryName("sess")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    batch = {(r["k"], r["n"], str(r["start"]), str(r["end"])) for r in sessions(df, ["k"], "ts", 60).collect()}
    got = {(r["k"], r["n"], str(r["start"]), str(r["end"])) for r in spark.table("sess").collect()}
    assert {n for k, n, *_ in batch if k == 1} == {3, 1}
    # The newest session stays open until the watermark passes it; all others are out.
    assert got == {b for b in batch if b[0] != 9}


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)


# ---- X8 against a plain walk ---------------------------------------------------------------


def walk(text, span=220, slack=10, short=1500, cap=400):
    """Plain reading of the list rules with the Latin words used by the query."""
    lines = [x.strip() for x in text.replace("\r\n", "\n").split("\n") if x.strip()]
    hints = [i for i, x in enumerate(lines) if "the" in x]
    if not hints and len(text) >= short:
        return []
    spans = []
    for i in hints or [0]:
        end = min(i + span, len(lines))
        if spans and i <= spans[-1][1] + slack:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([i, end])
    found, run = [], []

    def add(name):
        if len(name) >= 9 and name not in found:
            found.append(name)

    def flush():
        if len(run) >= 2:
            add("".join(run).rstrip(".,;"))
        run.clear()

    for a, b in spans:
        seen = False
        for line in lines[a:b]:
            if seen and "and" in line and "A" <= line[0] <= "M":
                break
            if "with" in line:
                seen = True
                flush()
                continue
            for token in line.split(" "):
                if token.isdigit():
                    flush()
                    continue
                seen = True
                name = token.rstrip(".,;")
                if len(name) >= 9:
                    flush()
                    add(name)
                elif len(name) == 2:
                    run.append(name)
                    if len(run) == 6:
                        flush()
                else:
                    flush()
        flush()
    return found[:cap]


def test_major_lists_equal_the_walk(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = ["the\n" + "\n".join(f"line{i:04d}xx {i}" for i in range(600)), "x\n" * 5 + "abcdefghij kl mn op", "the ab cd ef gh ij kl mn op qr"]
    docs = docs.union(spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    want = {r["doc_id"]: walk(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: r["majors"] for r in latin_majors(docs).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_bytes_written_follow_the_batch_not_the_state(spark, tmp_path):
    """40 batches of as many new keys each: late batches write what early ones wrote, merges add a few times that in all."""
    state = SortedRuns(spark, str(tmp_path / "state"), ["k"], [F.col("n").desc()], least_bytes=8192)
    seen, written = set(), []
    for i in range(40):
        batch = spark.range(i * 400, i * 400 + 400, 1, 2).select(F.col("id").alias("k"), (F.col("id") * 7 % 11).alias("n"), F.md5(F.col("id").cast("string")).alias("text"))
        state.append(batch, i)
        new = [r for r in state.runs() if (r.first, r.last) not in seen]
        seen |= {(r.first, r.last) for r in new}
        written.append((next(r.size for r in new if r.first == r.last == i), sum(r.size for r in new if r.first != r.last)))
    own, merged = [w[0] for w in written], [w[1] for w in written]
    assert max(own) < 1.2 * min(own)
    assert sum(merged) < 4 * sum(own)
    assert sum(1 for m in merged[20:] if m) <= 10  # most batches merge nothing
    assert len(state.current()) <= 12
    assert state.read().count() == 16_000


def test_buckets_split_by_bytes(spark, tmp_path):
    state = SortedRuns(spark, str(tmp_path / "state"), ["k"], [F.col("n").desc()], fanout=2, bucket_bytes=20_000, least_bytes=1)
    for i in range(4):
        state.append(spark.range(i * 500, i * 500 + 1000).select(F.col("id").alias("k"), F.lit(i).alias("n"), F.md5(F.col("id").cast("string")).alias("text")), i)
    runs = state.current()
    files = [len(list((tmp_path / "state" / r.name).glob("part-*.parquet"))) for r in runs]
    assert max(files) == -(-sum(r.size for r in state.runs() if r.last < 3) // 20_000) or max(files) >= 3
    found = {r["k"]: r["n"] for r in state.read().collect()}
    assert found == {k: min(3, k // 500) for k in range(2500)}


def test_runs_that_keep_every_row(spark, tmp_path):
    """With a rule of its own the state keeps the losers, so the result is that of all rows together."""
    rows = [(k, n, f"v{n}") for k in range(5) for n in range(9)]
    rule = lambda df: df.groupBy("k").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("v")).alias("v"))
    state = SortedRuns(spark, str(tmp_path / "state"), ["k"], [], best=rule, fanout=2, least_bytes=1)
    assert state.read() is None and state.lookup(spark.createDataFrame([(1,)], "k long")) is None
    for i in range(5):
        state.append(spark.createDataFrame(rows[i::5], "k long, n long, v string"), i)
    want = sorted(map(tuple, rule(spark.createDataFrame(rows, "k long, n long, v string")).collect()))
    assert sorted(map(tuple, state.read().collect())) == want


def _stamped(spark, rows):
    return spark.createDataFrame(rows, "k int, s long").select("k", F.timestamp_seconds("s").alias("ts"))


def test_event_time_clusters_evict_and_set_late_rows_aside(spark, tmp_path):
    clusters = EventTimeClusters(spark, str(tmp_path / "state"), ["k"], "ts", 60 * 10**6, 120 * 10**6, slice_us=100 * 10**6)
    kept, late, open_rows, newest = [], [], [], None
    for i in range(12):
        base = i * 1000
        rows = [(k, base + k * 7 + 50 * j) for k in range(4) for j in range(15) if (k + j) % 5]
        rows += [(9, base + 3)] * 40 + ([(1, base - 900), (None, base), (2, None)] if i else [])
        for row in rows:
            (late if row[1] is None or (newest is not None and row[1] < newest - 120) else kept).append(row)
        newest = max(s for _, s in rows if s is not None)
        clusters.add(_stamped(spark, rows), i)
        if i == 5:  # a replay of the batch
            clusters.add(_stamped(spark, rows), i)
        open_rows.append(clusters.open.latest().count())
    assert clusters.watermark() == (newest - 120) * 10**6
    assert max(open_rows[3:]) <= max(open_rows[:3])  # bounded however long the stream
    assert len(clusters.open.versions()) <= 3
    found = clusters.closed.all().unionByName(clusters.open.latest())
    got = sorted(((-1 if r["k"] is None else r["k"]), r["start"] // 10**6, r["end"] // 10**6, r["n"]) for r in found.collect())
    want = []
    for k in {r[0] for r in kept}:
        times = sorted(s for q, s in kept if q == k)
        runs = [[times[0]]]
        for t in times[1:]:
            runs[-1].append(t) if t - runs[-1][-1] <= 60 else runs.append([t])
        want += [(-1 if k is None else k, r[0], r[-1], len(r)) for r in runs]
    assert got == sorted(want)
    assert clusters.late.all().count() == len(late) and clusters.closed.all().filter(F.col("end") + 60 * 10**6 >= clusters.watermark()).count() == 0


def test_streams_without_input(spark, tmp_path):
    from cutline.plans import streams

    (tmp_path / "in").mkdir()
    source = read_stream(spark, str(tmp_path / "in"), "event_type string")
    assert streams._drain(status_counts(source, "event_type"), "complete", str(tmp_path / "out")).count() == 0


def test_documents_of_a_store_stay_small(spark, tmp_path):
    from cutline.plans import stores

    rows = spark.range(400_000)
    path = stores._write_shards(stores._sharded(rows, "id", rows), F.to_json(F.collect_list("id")), str(tmp_path / "store"))
    sizes = [r["n"] for r in spark.read.text(path).select(F.json_array_length("value").alias("n")).collect()]
    assert sum(sizes) == 400_000 and max(sizes) < 1.1 * stores.SHARD_ROWS
